"""Document fingerprints by one-permutation MinHash. DataFrame functions only.

Every shingle is hashed once; the high bits of the hash choose one of 256 bins and each bin keeps its
least hash. An empty bin borrows from a full one, chosen for that bin in the same random order in every
document (optimal densification). The low four bits of each bin are packed into 16 longs, and the share
of equal bins is corrected for the 1 in 16 that agree by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.lines import LOWER, UPPER
from factloom.llm.ordered import id_bounds, range_of

BINS, BITS, PROBES = 256, 4, 8
_NIBBLES = 0x1111111111111111


def _probe(b: Column, j: int) -> Column:
    """The j-th bin that an empty bin b looks at."""
    return F.pmod(F.hash(b, F.lit(j)), F.lit(BINS))


def shingle_hashes(text: Column, k: int) -> tuple[Column, Column]:
    """Word hashes of a text, and from a column `_words` of them the sorted distinct shingle hashes.

    Fewer than k words are one shingle; a text without a word has none.
    """
    words = F.filter(F.split(F.translate(text, UPPER, LOWER), r"[ \t-\r]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    w = F.col("_words")
    n = F.size(w)
    many = F.transform(F.slice(w, 1, F.greatest(n - (k - 1), F.lit(1))), lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, k))))
    return hashed, F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array_sort(many))


def with_fingerprint(df: DataFrame, text: Column, name: str, k: int = 5) -> DataFrame:
    """`df` with the packed fingerprint of `text` as `name`: 16 longs, or null for a text without a word."""
    first, sets = shingle_hashes(text, k)
    out = df.withColumn("_words", first).withColumn("_set", sets).drop("_words")
    top = lambda h: F.shiftright(h, 56)
    # sorted as signed numbers, so the hashes of a bin stand together and its least one comes first
    out = out.withColumn("_least", F.filter("_set", lambda h, i: (i == 0) | (top(F.get("_set", i - 1)) != top(h)))).drop("_set")
    out = out.withColumn("_full", F.transform("_least", lambda h: (top(h) + 128).cast("int")))
    bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    out = out.withColumn("_bins", F.transform(bins, lambda b: F.get("_least", F.array_position("_full", b).cast("int") - 1)))

    def dense(h: Column, b: Column) -> Column:
        # the first full bin of a few probes, else the full bin that comes first in b's own order
        order = F.array_min(F.transform("_full", lambda f, i: F.struct(F.xxhash64(b, f).alias("r"), i.alias("i"))))
        return F.coalesce(h, *(F.get("_bins", _probe(b, j)) for j in range(PROBES)), F.get("_least", order["i"]))

    out = out.withColumn("_low", F.transform("_bins", lambda h, b: dense(h, b).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))))
    words = F.array(*(F.aggregate(F.slice("_low", 16 * j + 1, 16), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x)) for j in range(BINS // 16)))
    return out.withColumn(name, F.when(F.size("_full") > 0, words)).drop("_least", "_full", "_bins", "_low")


def as_hex(packed: Column) -> Column:
    """256 hexadecimal digits, one a bin; empty for a text without a word."""
    return F.coalesce(F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two packed fingerprints. Two texts without a word are alike (1.0),
    one such text is unlike any other (0.0)."""

    def equal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        any_bit = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(F.shiftrightunsigned(d, 3))
        return F.lit(16) - F.bit_count(any_bit.bitwiseAND(F.lit(_NIBBLES).cast("long")))

    same = F.aggregate(F.zip_with(a, b, equal), F.lit(0), lambda acc, x: acc + x) / float(BINS)
    chance = 1.0 / (1 << BITS)
    estimate = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(estimate)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """(doc_id, fingerprint): one row per input row, null texts as empty ones. Equal texts have equal
    fingerprints; an empty table gives no row; other columns are ignored."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return with_fingerprint(base, F.col("text"), "packed", k).select("doc_id", as_hex(F.col("packed")).alias("fingerprint"))


def with_next(docs: DataFrame, bounds: list[int]) -> DataFrame:
    """(doc_id, text, packed, next_text, next_packed): each row beside the next in id order, the last
    beside the first. Work is dealt by id ranges; the first row of each range also stands, marked, at the
    end of the range before, so no window spans the table. Ties are ordered by text; a single row is its
    own next."""
    ranged = docs.withColumn("part", range_of(F.col("doc_id"), bounds))
    first = ranged.groupBy("part").agg(F.min_by(F.struct("doc_id", "text", "packed"), F.struct("doc_id", "text")).alias("r"))
    # one row a range, at most 512
    around = Window.orderBy("part")
    before = F.coalesce(F.lag("part").over(around), F.last("part").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    marks = first.withColumn("to", before).select("r.*", F.col("to").alias("part"), F.lit(True).alias("mark"))
    rows = ranged.withColumn("mark", F.lit(False)).unionByName(marks)
    order = Window.partitionBy("part").orderBy("mark", "doc_id", "text")
    return rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_packed", F.lead("packed").over(order)).where(~F.col("mark")).drop("mark", "part")


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their likeness."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = id_bounds(docs, "doc_id", 2_000)
    rows = with_next(with_fingerprint(docs, F.col("text"), "packed"), bounds)
    n = F.char_length("text")
    m = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - m), F.substring("next_text", F.lit(1), m))
    rows = rows.select("doc_id", "packed", "next_packed", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = with_fingerprint(rows, F.col("edited"), "edited_packed")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_hex(F.col("packed")).alias("fingerprint"),
        as_hex(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
