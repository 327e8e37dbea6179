"""Repeated paragraphs and passages.

Two kinds of unit are compared across documents:

- paragraphs, by MinHash banding on 5-word shingles: every line of at least one shingle, and the lines
  between two blank ones joined into one, so a text wrapped into short lines is compared too. Colliding
  ones are confirmed by their exact Jaccard likeness and closed into components;
- passages, runs of words that stand anywhere, also inside a longer line. Windows of `words` words start
  at anchors, the least shingle hash of every `stride` shingles, so any run of words + stride - 1 words
  that two documents share holds a window that both select. Equal windows are joined, overlapping ones
  of a document are merged, and runs that share a window are closed into components.

Both find what stands in one document only early: of rows with one key a single shuffle keeps those that
two values share. In every component the first occurrence is kept, with what overlaps it, and the others are marked for
removal. A line and the joined lines around it can both be marked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import arrays
from factloom.llm.components import components
from factloom.llm.frames import cut, drop, merge_join, shared, small_batches
from factloom.llm.near import NearParams, banded, near_components


@dataclass(frozen=True)
class PassageParams:
    """words: length of a window; paragraphs have near.k words or more. With 32 words and a stride of 20, a
    shared run of 51 words is always found. The bands miss a pair of paragraphs at 0.8 with probability
    (1 - 0.8**4)**14 < 7e-4, at 0.9 with less than 2e-7."""

    words: int = 32
    stride: int = 20
    near: NearParams = NearParams(k=5, bands=14, rows=4, values=128)


def spans(counts: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of every paragraph, by the words and the document of each line: the lines
    themselves, and two or more that no blank line parts, if they have `least` words."""
    solid = counts > 0
    follows = np.zeros(len(counts), bool)
    follows[1:] = solid[1:] & solid[:-1] & (owner[1:] == owner[:-1])
    first = np.flatnonzero(solid & ~follows)
    last = np.flatnonzero(solid & ~np.append(follows[1:], False))
    joined = last > first
    own = np.arange(len(counts))
    first, last = np.concatenate([own, first[joined]]), np.concatenate([own, last[joined]])
    total = np.concatenate([[0], np.cumsum(counts)])
    enough = total[last + 1] - total[first] >= least
    return first[enough], last[enough]


def _paragraphs(data: np.ndarray, offs: np.ndarray, least: int):
    """Of a block: owner, start and end of the paragraphs in bytes, their ids (a hash of the words), the
    words' hashes, and first and last word of each paragraph."""
    bounds = np.union1d(np.flatnonzero(data == 0x0A) + 1, offs)
    h, woffs = arrays.word_hashes(data, bounds)
    owner = np.searchsorted(offs, bounds[:-1], "right") - 1
    first, last = spans(np.diff(woffs), owner, least)
    at, to = woffs[first], woffs[last + 1]
    ids = arrays.range_hash(arrays.word_prefix(h), at, to).view(np.int64)
    return owner[first], bounds[first], bounds[last + 1], ids, h, at, to


def paragraph_units(least: int):
    """Paragraphs of at least `least` words as the units of near-duplicate search; equal words give one id."""

    def units(part, data, offs):
        *_, ids, h, at, to = _paragraphs(data, offs, least)
        n = to - at
        woffs = np.concatenate([[0], np.cumsum(n)])
        return ids, h[np.repeat(at - woffs[:-1], n) + np.arange(woffs[-1])], woffs

    return units


def _places(docs: DataFrame, p: PassageParams) -> DataFrame:
    """(doc_id, start, end, n_words, id) of the paragraphs; places are byte offsets."""

    def run(batches):
        for part, data, offs in arrays.blocks(batches, "text", arrays.WORD_BYTES):
            doc = part.column(part.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
            owner, start, end, ids, _, at, to = _paragraphs(data, offs, p.near.k)
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(doc[owner], pa.int64()), pa.array(start - offs[owner]), pa.array(end - offs[owner]), pa.array(to - at), pa.array(ids)], ["doc_id", "start", "end", "n_words", "id"])

    return docs.mapInArrow(run, "doc_id long, start long, end long, n_words long, id long")


def windows(hashes: np.ndarray, woffs: np.ndarray, p: PassageParams) -> np.ndarray:
    """First words of the selected windows: where the least shingle hash of some `stride` shingles stands
    (the last of equal ones), if a whole window follows."""
    if len(hashes) < p.words:
        return np.zeros(0, np.int64)
    k = p.near.k
    n = len(hashes)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc *= arrays.U64(0x9E3779B97F4A7C15)
        acc[: n - j] += hashes[j:]
        acc[n - j :] += hashes[:j]
        acc = arrays.mix(acc)
    bits = arrays.U64(int(n).bit_length())
    mask = (arrays.U64(1) << bits) - arrays.U64(1)
    key = (acc >> bits << bits) | (mask - np.arange(n, dtype=np.uint64))
    least, wide = key, 1
    while wide < p.stride:
        step = min(wide, p.stride - wide)
        least, wide = np.minimum(least[:-step], least[step:]), wide + step
    spot = (mask - (least & mask)).astype(np.int64)
    # windows of shingles that lie in one document
    count = np.maximum(np.diff(woffs) - (k - 1) - p.stride + 1, 0)
    at = np.repeat(woffs[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = spot[at]  # ascending, as the windows are
    first = first[np.flatnonzero(np.diff(first, prepend=-1))]
    owner = np.searchsorted(woffs, first, "right") - 1
    return first[first + p.words <= woffs[owner + 1]]


def _windows(docs: DataFrame, p: PassageParams) -> DataFrame:
    """(unit, doc_id, start, bytes, word): hash of each selected window, its place and its first word's number."""

    def run(batches):
        for part, data, offs in arrays.blocks(batches, "text", arrays.WORD_BYTES):
            ids = part.column(part.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
            starts, ends, woffs = arrays.words(data, offs)
            h = arrays.range_hash(arrays.prefix_hash(arrays.LOWER[data]), starts, ends)
            first = windows(h, woffs, p)
            whole = arrays.word_prefix(h)
            unit = arrays.range_hash(whole, first, first + p.words)
            owner = np.searchsorted(woffs, first, "right") - 1
            cols = [unit.view(np.int64), ids[owner].astype(np.int64), starts[first] - offs[owner], ends[first + p.words - 1] - starts[first], first - woffs[owner]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["unit", "doc_id", "start", "bytes", "word"])

    return docs.mapInArrow(run, "unit long, doc_id long, start long, bytes long, word long")


def _marked(rows: DataFrame, kind: str) -> DataFrame:
    """The rows of clusters that reach over documents; the first one is kept, the longest of those that
    start there, and so is what overlaps it."""
    first = rows.groupBy("cluster").agg(F.min(F.struct("doc_id", "start", (-F.col("end")).alias("back"))).alias("f"), F.max("doc_id").alias("last"))
    first = first.where(F.col("f.doc_id") < F.col("last"))
    told = merge_join(rows, first, "cluster")
    kept = (F.col("doc_id") == F.col("f.doc_id")) & (F.col("start") < -F.col("f.back")) & (F.col("end") > F.col("f.start"))
    return told.select("doc_id", F.lit(kind).alias("kind"), "start", "end", "n_words", F.col("f.doc_id").alias("first_doc_id"), "cluster", kept.alias("kept"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: PassageParams = PassageParams()) -> DataFrame:
    """(doc_id, kind, start, end, n_words, first_doc_id, cluster, kept) of every repeated paragraph and passage.

    Places are byte offsets. Words are compared with A-Z lower-cased; white space does not matter. Null,
    empty and texts of under 5 words have no unit. What repeats only inside one document, or under one id, is left
    alone; rows without an id are left out. Repeated rows count as one document. Other columns are ignored.
    """
    p = params
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    units = paragraph_units(p.near.k)
    near = near_components(banded(base, p.near, units), base, p.near, units)
    # a paragraph without a near one is a cluster of its copies
    places = merge_join(_places(base, p).distinct(), near, "id", "left").withColumn("cluster", F.coalesce("comp", "id"))
    paragraphs = cut(_marked(places.drop("id", "comp"), "paragraph"))
    drop(near)

    found = shared(_windows(base, p), "unit", "doc_id").distinct().withColumn("end", F.col("start") + F.col("bytes"))
    along = Window.partitionBy("doc_id").orderBy("start")
    gap = F.col("start") > F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    run = found.withColumn("new", F.when(F.coalesce(gap, F.lit(True)), F.col("start"))).withColumn("at", F.last("new", ignorenulls=True).over(along))
    found = cut(run.select("unit", "doc_id", "end", "word", "at", F.xxhash64("doc_id", "at").alias("run")))
    least = found.groupBy("unit").agg(F.min("run").alias("to"))
    label = components(merge_join(found, least, "unit").select("run", "to").distinct(), "run", "to").select(F.col("node").alias("run"), F.col("component").alias("cluster"))
    runs = found.groupBy("run", "doc_id", F.col("at").alias("start")).agg(F.max("end").alias("end"), (F.max("word") - F.min("word") + p.words).alias("n_words"))
    passages = cut(_marked(merge_join(runs, label, "run").drop("run"), "passage"))
    drop(found)
    return paragraphs.union(passages)


def op2_passage_dedup(spark, sf_dir: str) -> DataFrame:
    """Paragraphs and passages that repeat across the documents."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
