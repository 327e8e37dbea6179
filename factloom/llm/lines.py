"""Line deduplication over levelled sorted runs of line hashes. DataFrame functions only.

A run is a Parquet table of (h1, h2, n_docs, last_doc), sorted by hash within hash partitions. Each new
batch of documents is aggregated to its distinct line hashes and merge-joined with the runs: hashes that
no run holds become a run of level 0, the others are noted as repeats. When a level holds `fanout` runs
they are merged into one run of the next level, so a look-up reads a number of runs that grows with the
logarithm of the batches. Only repeats are ever counted again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.frames import cut, drop, merge_join

#: The white space stripped from both ends of a line: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without outer white space, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hashes(key: Column) -> tuple[Column, Column]:
    """96 bits of hash in two columns."""
    return F.xxhash64(key).alias("h1"), F.hash(key).alias("h2")


class LineRuns:
    """The state of an incremental line deduplication: sorted runs in levels, and what repeated since.

    Every hash has its row in the one run of the batch that brought it, or in a run compacted from that;
    what later batches say of it is kept beside the runs.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []
        self.repeats: list[DataFrame] = []
        self.stale: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def merged(self) -> DataFrame | None:
        """(h1, h2, n_docs, last_doc) of every line hash; None before the first batch."""
        runs = self.runs()
        if not runs:
            return None
        home = reduce(DataFrame.union, runs)
        if not self.repeats:
            return home
        more = reduce(DataFrame.union, self.repeats).groupBy("h1", "h2").agg(F.sum("n_docs").alias("more"), F.max("last_doc").alias("later"))
        return merge_join(home, more, ["h1", "h2"], "left").select("h1", "h2", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "later").alias("last_doc"))

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch of (doc_id, h1, h2) rows of documents not added before; return its new line hashes,
        to be read before the next batch is added."""
        drop(*self.stale)
        self.stale = []
        own = lines.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        runs = self.runs()
        if runs:
            own = cut(own)
            seen = reduce(DataFrame.union, [r.select("h1", "h2") for r in runs])
            self.repeats.append(cut(own.join(seen.hint("merge"), ["h1", "h2"], "left_semi")))
            fresh = _sorted(own.join(seen.hint("merge"), ["h1", "h2"], "left_anti"))
            drop(own)
        else:
            fresh = _sorted(own)
        self._put(0, fresh)
        return fresh

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, _sorted(reduce(DataFrame.union, full)))
            self.stale += full

    def close(self) -> None:
        """Delete all tables of the state."""
        drop(*self.runs(), *self.repeats, *self.stale)


def _sorted(run: DataFrame) -> DataFrame:
    """A run as it is kept: no hash stands in two runs, so runs are compacted by sorting alone."""
    return cut(run.repartition("h1").sortWithinPartitions("h1", "h2"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4) -> DataFrame:
    """The documents with repeated lines taken out: all columns, and n_lines, n_dropped behind them.

    A line whose key has at least `min_chars` code points and is found in at least `min_docs` documents
    is dropped everywhere but in the largest id that holds it, where all its copies stay. A null text
    stays null, and like an empty one it counts as one empty line. Rows that share an id are one
    document. Rows without an id neither count nor change. Added columns replace others of their name.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).where(F.col("doc_id").isNotNull())
    line = doc.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).where(F.char_length("line") >= min_chars)
    keyed = line.select("doc_id", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    keyed = keyed.select("doc_id", *_hashes(F.col("key"))).distinct()
    keyed = cut(keyed.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))).repartition("batch", "h1").sortWithinPartitions("batch"))
    state = LineRuns(docs.sparkSession)
    for b in range(batches):
        state.add(keyed.where(F.col("batch") == b).drop("batch"))
    common = state.merged().where(F.col("n_docs") >= min_docs).select("h1", "h2", "last_doc")
    gone = keyed.join(common, ["h1", "h2"]).where("doc_id <> last_doc")
    gone = cut(gone.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("gone")))
    drop(keyed)
    state.close()
    # the rows go along as one struct, so that no column of theirs can clash; they are dealt by id at every
    # size, so cost follows the input
    rest = docs.drop("n_lines", "n_dropped", text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(F.lit(True).alias("held"), F.struct(*(rest[c] for c in rest.columns)).alias("rest")).alias("row"))
    joined = merge_join(rows, gone, "doc_id", "left").select("row", "text", "gone", F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1).alias("lines"))

    def stays(line: Column) -> Column:
        key = line_key(line)
        return ~((F.char_length(key) >= min_chars) & F.array_contains(F.col("gone"), F.struct(*_hashes(key))))

    out = joined.withColumn("kept", F.when(F.col("gone").isNotNull(), F.filter("lines", stays)))
    new_text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    n_dropped = F.when(F.col("gone").isNull(), F.lit(0).cast("long")).otherwise((F.size("lines") - F.size("kept")).cast("long"))
    kept_columns = [new_text.alias(c) if c == text_col else F.col(f"row.rest.`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*kept_columns, F.size("lines").cast("long").alias("n_lines"), n_dropped.alias("n_dropped"))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated long lines of all documents, dropped everywhere but in the last document."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last_doc AS gone FROM keyed k LEFT JOIN common c USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
