"""Scalar functions on columns: hashing, identifiers, labels, URLs and status rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import documents

# fixed values
TIERS = {
    1: ("official_documentation", "official_api", "repository", "filing", "paper", "original_dataset"),
    2: ("github_issue", "product_review", "reddit", "hacker_news", "interview", "community_post"),
    3: ("news", "analyst_report", "blog"),
    4: ("aggregator", "secondary_summary"),
}
QUANTITATIVE = ("feature", "traction", "review")
FRESH_DAYS = {"github_metrics": 7, "pricing": 30, "product_features": 30, "market_reports": 365}
BUCKETS = {"market": "market", "technical": "technology", "solution": "competitors"}
TEMPORAL = "(?i)(growth|momentum|trend|change|delta|30d|90d)"

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def cc(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def strip(s: str | Column) -> Column:
    """All white space off both ends."""
    return F.regexp_replace(cc(s), r"^\s+|\s+$", "")


def normalize_label(s: str | Column) -> Column:
    return F.lower(strip(s))


def sha(s: Column) -> Column:
    return F.sha2(s, 256)


def canonical_value_hash(**fields: Column) -> Column:
    """`sha256:` and the digest of canonical JSON: names sorted at every level, nulls written out."""
    body = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    return documents.json_hash(F.to_json(body, {"ignoreNullFields": "false"}))


def artifact_content_hash(content_hash_field: str = "content_hash", **fields: Column) -> Column:
    """The canonical hash of a document without its own hash."""
    return canonical_value_hash(**{k: v for k, v in fields.items() if k != content_hash_field})


def _digest_id(prefix: str, length: int, sep: Column, parts: tuple[Column, ...]) -> Column:
    joined = parts[0]
    for x in parts[1:]:
        joined = F.concat(joined, sep, x)
    return F.concat(F.lit(prefix), F.upper(F.substring(sha(joined), 1, length)))


def claim_id(*parts: Column) -> Column:
    return _digest_id("CL-COMP-", 16, F.lit("|"), parts)


def evidence_id(*parts: Column) -> Column:
    return _digest_id("EV-COMP-", 16, F.lit("|"), parts)


def competitor_fact_id(*parts: Column) -> Column:
    """The id of a fact bound to a field: of its origin, pointer and content hash."""
    return _digest_id("FACT-COMP-", 20, F.expr("chr(0)"), parts)


def fact_id(*parts: Column) -> Column:
    return _digest_id("FACT-", 20, F.expr("chr(0)"), parts)


def artifact_ref(artifact_id: Column, version: Column) -> Column:
    return F.concat(artifact_id, F.lit("@"), version.cast("string"))


def parse_artifact_ref(ref: Column) -> tuple[Column, Column]:
    return F.regexp_extract(ref, r"^(.*)@(\d+)$", 1), F.regexp_extract(ref, r"^(.*)@(\d+)$", 2).try_cast("int")


def reliability(tier: Column) -> Column:
    return F.when(tier == 1, "high").when(tier == 2, "medium").otherwise("low")


def freshness_label(status: Column) -> Column:
    return F.when(status == "FRESH", "high").when(status == "STALE", "low").otherwise("unknown")


def quantize6(x: Column) -> Column:
    return F.bround(x, 6)


def to_utc(s: Column) -> Column:
    return F.try_to_timestamp(s)


def min_present(*xs: Column) -> Column:
    return F.least(*xs)


def display_value(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("null"))


def evidence_type(analysis: Column) -> Column:
    return F.when(analysis.isin(*QUANTITATIVE), "quantitative").otherwise("qualitative")


def temporal_name(name: Column) -> Column:
    return name.rlike(TEMPORAL)


def chart_group_id(chart_type: Column) -> Column:
    return F.concat(F.lit("FG-CHART-"), F.replace(F.upper(chart_type), F.lit("_"), F.lit("-")))


def question_bucket(kind: Column) -> Column:
    out = F.lit("users")
    for k, v in BUCKETS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def source_tier(source_type: Column) -> Column:
    out = F.lit(None).cast("int")
    for tier, kinds in TIERS.items():
        out = F.when(source_type.isin(*kinds), tier).otherwise(out)
    return out


def freshness_status(kind: Column, observed: Column, as_of: Column) -> Column:
    days = F.lit(None).cast("int")
    for k, v in FRESH_DAYS.items():
        days = F.when(kind == k, v).otherwise(days)
    return F.when(observed.isNull() | days.isNull(), "UNKNOWN").when(F.datediff(as_of, observed) > days, "STALE").otherwise("FRESH")


def url_parts(url: str | Column) -> dict[str, Column]:
    u = cc(url)
    authority = F.regexp_extract(u, _URL, 2)
    return {
        "scheme": F.lower(F.regexp_extract(u, _URL, 1)),
        "authority": authority,
        "host": F.lower(F.regexp_extract(authority, r"^([^:]*)(:[0-9]*)?$", 1)),
        "port": F.regexp_extract(authority, r"^[^:]*:([0-9]*)$", 1),
        "path": F.regexp_extract(u, _URL, 3),
        "query": F.regexp_extract(u, _URL, 4),
    }


def canonicalize_url(url: str | Column) -> Column:
    """Scheme and host in lower case, without default port and fragment; an empty path is `/`."""
    p = url_parts(url)
    default = ((p["scheme"] == "http") & (p["port"] == "80")) | ((p["scheme"] == "https") & (p["port"] == "443")) | (p["port"] == "")
    port = F.when(default, "").otherwise(F.concat(F.lit(":"), p["port"]))
    return F.concat(p["scheme"], F.lit("://"), p["host"], port, F.when(p["path"] == "", "/").otherwise(p["path"]), p["query"])


def url_problem(url: str | Column) -> Column:
    """Why a URL is refused, or null. A null URL is allowed."""
    u, p = cc(url), url_parts(url)
    port = p["port"].try_cast("int")
    return (
        F.when(u.isNull(), None)
        .when(strip(u) == "", "EMPTY")
        .when(~p["scheme"].isin("http", "https"), "SCHEME")
        .when(p["authority"].contains("@"), "CREDENTIALS")
        .when(p["authority"].rlike(r"^\[|\]"), "IPV6_HOST")
        .when(p["host"] == "", "HOST")
        .when((p["port"] != "") & (port.isNull() | (port < 1) | (port > 65535)), "PORT")
    )


def safe_relative_path(path: str | Column) -> Column:
    """Relative, no `..`, no control character, no drive, no reserved device name."""
    p = cc(path)
    parts = F.split(p, "/")
    bad = F.exists(parts, lambda x: x.isin("", ".", "..") | x.rlike(r"(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])(\..*)?$"))
    return F.coalesce(~bad & ~p.rlike(r"[\x00-\x1f\x7f\\:]"), F.lit(False))


def feature_statement(name: Column, coverage: Column) -> Column:
    return F.format_string("%s covers %.1f%% of the feature taxonomy.", name, coverage * 100)


def json_pointer(doc: Column, pointer: str | Column) -> Column:
    """The value at an RFC 6901 pointer of a JSON text, as a variant; null where it does not resolve.

    Strict: array indexes have no leading zero, `-` is none, nothing is found below a scalar. A pointer
    without its leading slash or with a `~` before anything but 0 and 1 is an error of the caller where it
    is a text; in a column of pointers, one for each row, it resolves to null.
    """
    if isinstance(pointer, Column):
        return F.try_parse_json(documents.value_at(doc, pointer))
    if not pointer.startswith("/") or re.search("~(?![01])", pointer):
        raise ValueError(f"not a JSON pointer: {pointer!r}")
    found = F.try_parse_json(doc)
    for raw in pointer[1:].split("/"):
        token = raw.replace("~1", "/").replace("~0", "~")
        quote = "'" if "'" not in token else '"'
        if quote in token:  # no variant path can name it
            named = F.from_json(F.to_json(found), "map<string, variant>")[token]
        else:
            named = F.try_variant_get(found, f"$[{quote}{token}{quote}]", "variant")
        found = F.coalesce(F.try_variant_get(found, f"$[{token}]", "variant"), named) if re.fullmatch("0|[1-9][0-9]*", token) else named
    return found


def input_fingerprint(skill_ref: Column, input_refs: Column, profile_ref: Column, contract_ref: Column, config: Column, permissions: dict[str, Column], budget: dict[str, Column]) -> Column:
    """Canonical hash of what an attempt runs on. References and write paths are sets; `config` is a struct
    and keeps the order of its lists, names may stand in any order."""
    fields = {
        "budget": F.struct(*(budget[k].alias(k) for k in ("cost_limit", "max_sources", "timeout_minutes", "token_limit"))),
        "input_artifact_refs": F.array_sort(F.array_distinct(input_refs)),
        "permissions": F.struct(permissions["external_access"].alias("external_access"), permissions["secrets"].alias("secrets"), F.array_sort(F.array_distinct(permissions["workspace_write_paths"])).alias("workspace_write_paths")),
        "profile_ref": profile_ref,
        "relevant_config": config,
        "research_contract_ref": contract_ref,
        "skill_ref": skill_ref,
    }
    return canonical_value_hash(**fields)
