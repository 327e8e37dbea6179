"""JSON documents as text columns: canonical form, values by pointer, and their hashes.

Documents are read and written by Python's own `json` in Arrow batches, so work is linear in the text and
rows are judged where they lie, without a shuffle.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKENS = r'"(?:[^"\\]|\\.)*"|[-0-9][-+.0-9eE]*|true|false|null|[{}\[\],:]'
_INDEX = re.compile("0|[1-9][0-9]{0,8}", re.ASCII)
_NOTHING = object()


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def unquoted(token: Column) -> Column:
    """The text of a JSON string token."""
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.when(token.contains("\\"), F.try_variant_get(F.try_parse_json(token), "$", "string")).otherwise(inner)


def _object(pairs: list[tuple[str, Any]]) -> dict:
    told = dict(pairs)
    if len(told) < len(pairs):
        raise ValueError("a name repeats")
    return told


def _refused(constant: str) -> None:
    raise ValueError(constant)


def _reader():
    """Read a text strictly; what is no document is `_NOTHING`."""
    sys.set_int_max_str_digits(0)  # whole numbers are kept at any length
    decode = json.JSONDecoder(object_pairs_hook=_object, parse_constant=_refused).decode

    def read(text: str | None) -> Any:
        try:
            return _NOTHING if text is None else decode(text)
        except (ValueError, RecursionError):
            return _NOTHING

    return read


_write = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"), check_circular=False).encode


def _text(value: Any) -> str | None:
    if value is _NOTHING:
        return None
    try:
        text = _write(value)
    except RecursionError:
        return None
    # half a surrogate pair is no character
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def _without(value: Any, names: list[str]) -> None:
    for name in names[:-1]:
        value = value.get(name) if isinstance(value, dict) else None
    if isinstance(value, dict):
        value.pop(names[-1], None)


def _found(value: Any, pointer: str) -> Any:
    for raw in pointer[1:].split("/"):
        name = raw.replace("~1", "/").replace("~0", "~")
        if isinstance(value, dict):
            value = value.get(name, _NOTHING)
        elif isinstance(value, list) and _INDEX.fullmatch(name) and int(name) < len(value):
            value = value[int(name)]
        else:
            return _NOTHING
    return value


def canonical_json(doc: Column, without: str | None = None) -> Column:
    """Compact JSON with the names of all objects in code-point order, or null for text that is no document.

    Numbers and strings are written in one way each: 1e2 and 100.0 are equal, 100 is not; characters beyond
    ASCII stand for themselves. A name that repeats in an object makes the text no document. `without`
    names a field, as a pointer, that is left out.
    """
    names = without[1:].split("/") if without else []

    @F.pandas_udf("string")
    def canonical(docs: pd.Series) -> pd.Series:
        read, out = _reader(), []
        for text in docs:
            value = read(text)
            if names:
                _without(value, names)
            out.append(_text(value))
        return pd.Series(out, dtype=object)

    return canonical(doc)


def json_names(doc: Column) -> Column:
    """The distinct names of all objects of a document at any depth, as they read without escapes."""
    tokens = F.regexp_extract_all(doc, F.lit(_TOKENS), F.lit(0))
    names = _let(tokens, lambda ts: F.filter(ts, lambda t, i: t.startswith('"') & (F.get(ts, i + 1) == ":")))
    return F.array_distinct(F.transform(names, unquoted))


def pointer_valid(pointer: Column) -> Column:
    """Whether a text is a pointer that may be looked up: it begins with a slash, and 0 or 1 follows every `~`."""
    return F.coalesce(pointer.startswith("/") & ~pointer.rlike("~(?![01])"), F.lit(False))


def value_at(doc: Column, pointer: Column) -> Column:
    """Canonical text of the value at a column's RFC 6901 pointer, or null where it is invalid or leads nowhere.

    Strict: array indexes have no leading zero, `-` is none, nothing is found below a scalar, and the empty
    pointer is refused.
    """

    @F.pandas_udf("string")
    def value(docs: pd.Series, pointers: pd.Series) -> pd.Series:
        read = _reader()
        told = (None if at is None else _text(_found(read(text), at)) for text, at in zip(docs, pointers, strict=True))
        return pd.Series(list(told), dtype=object)

    return value(doc, F.when(pointer_valid(pointer), pointer))


def text_hash(text: Column) -> Column:
    """`sha256:` and the digest of a canonical text."""
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def json_hash(doc: Column, without: str | None = None) -> Column:
    """`sha256:` and the digest of a document's canonical text."""
    return text_hash(canonical_json(doc, without))
