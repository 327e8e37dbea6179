"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel edit distance.

A test item of m bytes may differ in k = floor(rate * m) edits. It is split into k + 1 pieces, of which
one at least must stand unchanged in any leaked copy. One Aho-Corasick pass finds all exact piece hits
of a document; each hit is then verified around its place. Short items are searched exactly, as whole
words.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import arrays
from factloom.llm.frames import small_batches


@dataclass(frozen=True)
class LeakParams:
    """rate: edits allowed per byte of an item. Items under `least` folded bytes must stand unchanged, but
    for white space at their ends, and no word may go on at either end. block: bytes of items searched in one pass; the benchmark is broadcast in blocks
    of this size, so what a task holds does not grow with it."""

    rate: float = 0.05
    least: int = 24
    block: int = 2_000_000


_FOLD = arrays.LOWER.copy()
_FOLD[arrays.SPACE] = 0x20


def fold(data: np.ndarray) -> np.ndarray:
    """Same length: A-Z and Latin-1 capitals to lower case, any ASCII white space to a blank."""
    out = _FOLD[data]
    capital = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    out[capital] += 0x20
    return out


_WORD = np.zeros(256, bool)
_WORD[[0x5F, *range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def whole_words(text: bytes, start: int, end: int) -> bool:
    """Whether no word of a folded text crosses the start or the end of a range."""
    return not (start > 0 and _WORD[text[start - 1]] and _WORD[text[start]]) and not (end < len(text) and _WORD[text[end - 1]] and _WORD[text[end]])


def item_pieces(item: bytes, k: int) -> list[tuple[int, bytes]]:
    """k + 1 nearly equal pieces with their places."""
    ends = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def myers(item: bytes, text: bytes, k: int) -> tuple[int, int] | None:
    """Least edit distance of `item` to a substring of `text`, and where the first such one ends."""
    m = len(item)
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
        if score <= k and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def locate(item: bytes, text: bytes, lo: int, hi: int, k: int) -> tuple[int, int, int] | None:
    """(start, end, distance) of the closest occurrence inside text[lo:hi] within k edits."""
    at = text.find(item, lo, hi)
    if at >= 0:
        return at, at + len(item), 0
    found = myers(item, text[lo:hi], k)
    if found is None:
        return None
    distance, end = found
    head = text[max(lo, lo + end - len(item) - k) : lo + end]
    back = myers(item[::-1], head[::-1], distance)
    return lo + end - back[1], lo + end, distance


def _automaton(items: list[tuple[int, bytes]], p: LeakParams):
    import ahocorasick

    pieces: dict[bytes, list[tuple[int, int]]] = {}
    for n, (_, item) in enumerate(items):
        for at, piece in item_pieces(item, int(p.rate * len(item)) if len(item) >= p.least else 0):
            pieces.setdefault(piece, []).append((n, at))
    found = ahocorasick.Automaton()
    for piece, where in pieces.items():
        found.add_word(piece.decode("latin-1"), (len(piece), where))
    found.make_automaton()
    return found


def _search(text: bytes, automaton, items, p: LeakParams) -> list[tuple[int, int, int, int]]:
    """(item number, start, end, distance) of the leaks in one folded document."""
    hits: dict[int, list[int]] = {}
    for end, (length, where) in automaton.iter(text.decode("latin-1")):
        for n, at in where:
            hits.setdefault(n, []).append(end + 1 - length - at)
    out = []
    for n, places in hits.items():
        item = items[n][1]
        if len(item) < p.least:
            out += [(n, x, x + len(item), 0) for x in places if whole_words(text, x, x + len(item))]
            continue
        k = int(p.rate * len(item))
        places.sort()
        lo = hi = places[0]
        spans = []
        for x in places[1:]:
            if x - hi > 2 * k + 1:
                spans.append((lo, hi))
                lo = x
            hi = x
        for lo, hi in [*spans, (lo, hi)]:
            found = locate(item, text, max(0, lo - k), min(len(text), hi + len(item) + k), k)
            if found and (n, *found) not in out:
                out.append((n, *found))
    return out


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, p: LeakParams, named: bool = True) -> list[list[tuple[int | None, bytes]]]:
    """The folded items in blocks of about p.block bytes; the number of blocks is fixed by their total
    size. Blank items are left out and, if `named`, those without an id."""
    small_batches(benchmark.sparkSession)
    items = benchmark.where(F.col(item_text).isNotNull() & (F.col(item_id).isNotNull() | F.lit(not named))).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // p.block))
    for b in range(n):
        block = [(r.i, fold(np.frombuffer(r.t.encode(), np.uint8)).tobytes()) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).distinct().toLocalIterator()]
        block = [(i, t if len(t) >= p.least else t.strip()) for i, t in block if t.strip()]
        yield sorted(block, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _texts(batch, text: str):
    """Folded bytes of every document of a record batch, block by block."""
    for part, data, offs in arrays.blocks([batch], text):
        raw = fold(data).tobytes()
        yield part, [raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: LeakParams = LeakParams(), item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, distance) of every leak; places are byte offsets.

    Null or blank texts and items leak nothing, and items without an id are not reported. Items of under
    24 folded bytes leak where they stand unchanged as whole words. Equal items are reported one by one, repeated rows each
    time; empty tables give no row. Of overlapping candidates of one item the closest is reported.
    """
    p = params
    schema = "doc_id long, item_id long, start long, end long, distance int"
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = []
    for items in _blocks(benchmark, item_id, item_text, p):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, held=held):
            own = held.value
            automaton = _automaton(own, p) if own else None
            for batch in batches:
                for part, texts in _texts(batch, "text"):
                    ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
                    rows = [(d, own[n][0], s, e, x) for d, t in zip(ids, texts, strict=True) if own for n, s, e, x in _search(t, automaton, own, p)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.int32()], strict=True)], ["doc_id", "item_id", "start", "end", "distance"])

        parts.append(base.mapInArrow(run, schema))
    return reduce(DataFrame.union, parts)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", params: LeakParams = LeakParams(), item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no leak, with all their columns; one pass a benchmark block, no shuffle.

    Short items count as in leaks(), and so do items without an id.
    """
    p = params
    for items in _blocks(benchmark, item_id, item_text, p, named=False):
        if not items:
            continue
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, held=held):
            own = held.value
            automaton = _automaton(own, p)
            for batch in batches:
                for part, texts in _texts(batch, text_col):
                    yield part.filter(pa.array([not _search(t, automaton, own, p) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every occurrence of a benchmark item in any document."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
