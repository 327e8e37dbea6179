"""Exact removal of byte strings that occur twice, by suffix arrays of anchored groups.

1. Every window of `length` bytes selects an anchor: the `gram`-byte string in it with the least hash (the
   last of equal ones). Equal windows select the same anchor at the same place, so only occurrences of
   one anchor can hold equal windows.
2. Rows are dealt by anchor. An occurrence is written as the bytes left of the anchor, one symbol for the
   anchor itself, and the bytes right of it, as far as its own windows reach.
3. A suffix array of the written occurrences brings equal windows next to each other. It is built in
   linear time by grouping suffixes under their Lyndon prefixes, in descending order and with
   previous-smaller pointers, and then emitting each group's order; nothing is renamed recursively.
4. Windows equal to a neighbour are covered; covered bytes are cut out of each document.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import arrays
from factloom.llm.frames import ALONE, LEADS, TOLD, cut, drop, merge_join, shared, small_batches

U64 = np.uint64


@dataclass(frozen=True)
class RepeatParams:
    """length: bytes of a repeated string. gram: bytes of an anchor. hot: occurrences of an anchor above
    which they are dealt again by longer common strings (`fine` window places each), so that no task
    holds one anchor's occurrences. symbols: about how many symbols a suffix array covers at once."""

    length: int = 400
    gram: int = 350
    hot: int = 5_000
    fine: int = 8
    symbols: int = 300_000


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers whose last one is the only smallest.

    A group is a range of `order`, named by its start; groups right of `hi` are final. Each suffix s of
    the highest open group finds p, the nearest suffix to the left in a lower group: s is where the
    Lyndon prefix of p goes on. Every p moves up into a new group just behind its old one, the further
    the more suffixes of the group follow it.
    """
    n = len(text)
    first = np.argsort(text, kind="stable")
    ranked = text[first]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    start = np.repeat(heads, np.diff(np.append(heads, n)))
    order = first.tolist()
    place = np.empty(n, np.int64)
    place[first] = np.arange(n)
    group = np.empty(n, np.int64)
    group[first] = start
    ends = np.zeros(n, np.int64)
    ends[heads] = np.append(heads[1:], n)
    place, group, ends = place.tolist(), group.tolist(), ends.tolist()
    lower = [-1] * n
    hi = n
    while hi:
        lo = group[order[hi - 1]]
        if hi - lo == 1:
            p = order[lo] - 1
            while p >= 0 and group[p] >= lo:
                p = lower[p]
            lower[order[lo]] = p
            if p >= 0:
                a = group[p]
                b = ends[a] - 1
                if b > a:
                    other, at = order[b], place[p]
                    order[at], order[b] = other, p
                    place[other], place[p] = at, b
                    ends[a], group[p], ends[b] = b, b, b + 1
        else:
            follow: dict[int, int] = {}
            for s in sorted(order[lo:hi]):
                p = s - 1
                while p >= 0 and group[p] >= lo:
                    p = lower[p]
                lower[s] = p
                if p >= 0:
                    follow[p] = follow.get(p, 0) + 1
            if follow:
                for times in sorted(set(follow.values()), reverse=True):
                    moved: dict[int, list[int]] = {}
                    for p, t in follow.items():
                        if t == times:
                            moved.setdefault(group[p], []).append(p)
                    for a, members in moved.items():
                        b = top = ends[a]
                        for p in members:
                            b -= 1
                            other, at = order[b], place[p]
                            order[at], order[b] = other, p
                            place[other], place[p] = at, b
                        ends[a] = b
                        ends[b] = top
                        for p in members:
                            group[p] = b
        hi = lo
    out, free, placed = [0] * n, list(range(n)), bytearray(n)
    out[0], placed[n - 1] = n - 1, 1
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not placed[p]:
            a = group[p]
            out[free[a]] = p
            free[a] += 1
            placed[p] = 1
            p = lower[p]
    return np.array(out)


def anchors(data: np.ndarray, offs: np.ndarray, p: RepeatParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a block: owner, hash, place, and the least and greatest distance of an own window's start to it."""
    none = np.zeros(0, np.int64)
    span = p.length - p.gram + 1
    if len(data) < p.length:
        return none, none.astype(U64), none, none, none
    prefix = arrays.prefix_hash(data)
    m = len(data) - p.gram + 1
    at = np.arange(m)
    h = arrays.range_hash(prefix, at, at + p.gram)
    bits = U64(int(m).bit_length())
    mask = (U64(1) << bits) - U64(1)
    key = (h >> bits << bits) | (mask - at.astype(U64))
    rows = -(-m // span)
    padded = np.full(rows * span, ~U64(0))
    padded[:m] = key
    grid = padded.reshape(rows, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: m - span + 1], ahead[span - 1 : m])
    size = np.diff(offs)
    owner = np.flatnonzero(size >= p.length)
    n = size[owner] - p.length + 1
    start = np.repeat(offs[owner], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    spot = (mask - (least[start] & mask)).astype(np.int64)
    own = np.repeat(owner, n)
    if not len(spot):
        return none, none.astype(U64), none, none, none
    edge = np.flatnonzero(np.concatenate([[True], (spot[1:] != spot[:-1]) | (own[1:] != own[:-1])]))
    last = np.append(edge[1:], len(spot)) - 1
    spot = spot[edge]
    return own[edge], h[spot], spot - offs[own[edge]], spot - start[last], spot - start[edge]


def _anchor_rows(docs: DataFrame, p: RepeatParams) -> DataFrame:
    """(anchor, text_key, loc): loc packs place, least and greatest distance."""

    def run(batches):
        for part, data, offs in arrays.blocks(batches, "text"):
            own, h, at, lo, hi = anchors(data, offs, p)
            keys = part.column(part.schema.get_field_index("text_key")).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[own].astype(np.int64)), pa.array(at << 20 | lo << 10 | hi)], ["anchor", "text_key", "loc"])

    return docs.select("text_key", "text").mapInArrow(run, "anchor long, text_key long, loc long")


def _written(affected: DataFrame, p: RepeatParams) -> DataFrame:
    """(key, reach, left, right, text_key, place, state): occurrences as strings around their common middle.

    Of those that a batch holds more than once one leads the others, which are told already to be repeated.
    """
    wide = p.length - p.gram

    def run(batches):
        for batch in batches:
            out = []
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("text_key", "text", "spots")]
            for key, text, spots in zip(*(c.to_pylist() for c in cols), strict=True):
                raw = text.encode()
                for spot in spots:
                    loc, at = spot["loc"], spot["loc"] >> 20
                    lo, hi = loc >> 10 & 1023, loc & 1023
                    if not spot["hot"]:
                        out.append((spot["anchor"], wide, raw[at - hi : at], raw[at + p.gram : at - lo + p.length], key, at))
                        continue
                    for a in range(lo - lo % p.fine, hi + 1, p.fine):
                        b = a + p.fine - 1
                        x, y = max(a, lo), min(b, hi)
                        middle = raw[at - a : at - b + p.length]
                        code = int.from_bytes(hashlib.blake2b(middle, digest_size=8, key=(spot["anchor"] & 2**64 - 1).to_bytes(8, "little") + bytes([a // p.fine, b - a])).digest(), "little", signed=True)
                        out.append((code, b - a, raw[at - y : at - a], raw[at - b + p.length : at - x + p.length], key, at - a))
            if out:
                times = Counter(row[:4] for row in out)
                led: set[tuple] = set()
                for i, row in enumerate(out):
                    context = row[:4]
                    out[i] = (*row, ALONE if times[context] == 1 else TOLD if context in led else LEADS)
                    led.add(context)
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int8()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "reach", "left", "right", "text_key", "place", "state"])

    return affected.mapInArrow(run, "key long, reach int, left binary, right binary, text_key long, place long, state byte")


def _equal_windows(contexts: list[tuple[int, int, bytes, bytes]]) -> list[np.ndarray]:
    """For each distinct (key, reach, left, right), the offsets in `left` whose windows occur in another one."""
    names = {k: i for i, k in enumerate(dict.fromkeys(c[:2] for c in contexts))}
    parts, begins, at = [], [], 0
    for key, reach, left, right in contexts:
        begins.append(at)
        parts += [np.frombuffer(left, np.uint8).astype(np.int64) + 2, np.array([258 + names[key, reach]]), np.frombuffer(right, np.uint8).astype(np.int64) + 2, np.array([1])]
        at += len(left) + len(right) + 2
    text = np.concatenate([*parts, [0]])
    order = suffix_array(text)
    n = np.array([len(c[2]) + 1 for c in contexts])
    begins, reach = np.array(begins), np.array([c[1] for c in contexts])
    owner = np.repeat(np.arange(len(n)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    index = np.full(len(text), -1)
    index[begins[owner] + offset] = np.arange(len(owner))
    # windows that would run past the right end were never this occurrence's own
    fits = offset + reach[owner] + 1 <= np.array([len(c[2]) + 1 + len(c[3]) for c in contexts])[owner]
    chosen = index[order]
    chosen = chosen[chosen >= 0]
    chosen = chosen[fits[chosen]]
    value = np.zeros(len(text) + 1, U64)
    power = arrays._powers(len(text))
    np.cumsum(arrays.mix(text.astype(U64) + U64(77)) * power[0][: len(text)], out=value[1:])
    s = begins[owner[chosen]] + offset[chosen]
    window = arrays.mix((value[s + reach[owner[chosen]] + 1] - value[s]) * power[1][s])
    same = window[1:] == window[:-1]
    # equal hashes only propose: the symbols decide
    same &= reach[owner[chosen[1:]]] == reach[owner[chosen[:-1]]]
    for r in np.unique(reach[owner[chosen[1:][same]]]).tolist() if same.any() else []:
        view = np.lib.stride_tricks.sliding_window_view(text, r + 1)
        spots = np.flatnonzero(same & (reach[owner[chosen[1:]]] == r))
        for lo in range(0, len(spots), 20_000):
            some = spots[lo : lo + 20_000]
            same[some] = (view[s[some]] == view[s[some + 1]]).all(1)
    covered = np.zeros(len(owner), bool)
    covered[chosen[1:][same]] = True
    covered[chosen[:-1][same]] = True
    return np.split(covered, np.cumsum(n)[:-1])


def _covered(written: DataFrame, p: RepeatParams) -> DataFrame:
    """(text_key, start, end): bytes of windows that occur twice, from rows dealt and sorted by key."""

    def run(batches):
        held: list[tuple] = []  # distinct contexts: (key, reach, left, right), text_key, place, repeated
        size = 0

        def spans(contexts):
            out = []
            if len(contexts) > 1:
                for c, hit in zip(contexts, _equal_windows([c[0] for c in contexts]), strict=True):
                    if not c[3] and hit.any():
                        flips = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                        base = c[2] - len(c[0][2])
                        out += [(c[1], base + int(a), base + int(b) - 1 + p.length) for a, b in zip(flips[::2], flips[1::2], strict=True)]
            return out

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["text_key", "start", "end"])

        def whole(c):
            _, reach, left, right = c[0]
            return c[1], c[2] - len(left), c[2] - (reach - len(right)) + p.length

        def close(all_of_it: bool):
            """Leave the last key open unless all is to be closed; keys of one context need no array."""
            nonlocal held, size
            last = held[-1][0][0] if held and not all_of_it else None
            ready = [c for c in held if all_of_it or c[0][0] != last]
            held = [c for c in held if not all_of_it and c[0][0] == last]
            size = sum(len(c[0][2]) + len(c[0][3]) + 2 for c in held)
            many: dict[int, int] = {}
            for c in ready:
                many[c[0][0]] = many.get(c[0][0], 0) + 1
            return spans([c for c in ready if many[c[0][0]] > 1])

        for batch in batches:
            rows = []
            for key, reach, left, right, text_key, place, state in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                context = (key, reach, left, right)
                if state == TOLD:
                    rows.append(whole((context, text_key, place)))
                    continue
                if held and held[-1][0] == context:
                    if not held[-1][3]:
                        rows.append(whole(held[-1]))
                        held[-1] = (*held[-1][:3], True)
                    rows.append(whole((context, text_key, place)))
                    continue
                if size > p.symbols and held[-1][0][0] != key:
                    rows += close(True)
                held.append((context, text_key, place, state == LEADS))
                if state == LEADS:
                    rows.append(whole(held[-1]))
                size += len(left) + len(right) + 2
            if rows:
                yield table(rows)
        if held and (rows := close(True)):
            yield table(rows)

    # what is told needs no neighbour, so copies of one passage don't gather in its task
    place = F.when(F.col("state") == TOLD, F.xxhash64("text_key", "place")).otherwise(F.col("key"))
    dealt = written.repartition(place).sortWithinPartitions("key", "reach", "left", "right")
    return dealt.mapInArrow(run, "text_key long, start long, end long")


def _cut_out(rows: DataFrame) -> DataFrame:
    """(text_key, n_removed, n_spans, kept_text) of texts with covered spans, overlapping ones joined."""

    def run(batches):
        for batch in batches:
            out = []
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("text_key", "text", "spans")]
            for key, text, spans in zip(*(c.to_pylist() for c in cols), strict=True):
                raw, kept, at, removed, n = text.encode(), [], 0, 0, 0
                reach = -1
                for s, e in sorted((x["start"], x["end"]) for x in spans):
                    if s > reach:
                        n += 1
                        kept.append(raw[at:s])
                    if e > reach:
                        removed += e - max(s, reach)
                        reach = at = e
                kept.append(raw[at:])
                out.append((key, removed, n, b"".join(kept)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.binary()], strict=True)], ["text_key", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, "text_key long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: RepeatParams = RepeatParams()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): `kept` holds the bytes left, null where nothing was removed.

    Every byte covered by a `length`-byte string that also starts anywhere else in any text, the same one
    included, is removed; strings are judged on the input. A null text is empty. Repeated rows are each
    other's copies, also under one id. What is left may end inside a character. Other columns are
    ignored; an empty table gives no row.
    """
    p = params
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("text_key", F.xxhash64("text", F.octet_length("text")))
    long_texts = base.where(F.octet_length("text") >= p.length)
    found = cut(shared(_anchor_rows(long_texts, p).withColumn("row", F.monotonically_increasing_id()), "anchor", "row").drop("row"))
    hot = found.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > p.hot)
    spots = merge_join(found, hot, "anchor", "left").select("text_key", F.struct("anchor", "loc", F.col("n").isNotNull().alias("hot")).alias("s"))
    # copies of a text give each spot as often; the text itself comes that often too
    spots = spots.groupBy("text_key").agg(F.collect_set("s").alias("spots"))
    affected = cut(long_texts.select("text_key", "text").join(spots, "text_key"))
    spans = _covered(_written(affected, p), p).groupBy("text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    texts = affected.select("text_key", "text").dropDuplicates(["text_key"])
    done = cut(_cut_out(texts.join(spans, "text_key")))
    drop(affected, found)
    out = base.select("doc_id", "text_key", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    out = out.select("doc_id", "text_key", "n_bytes", F.sha2("text", 256).alias("whole_sha256"))
    out = out.join(done, "text_key", "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), "kept", "whole_sha256")


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes of all documents covered by 400-byte strings that start more than once."""
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kept = F.coalesce(F.sha2("kept", 256), F.col("whole_sha256")).alias("kept_sha256")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", kept, (F.col("n_removed") > 0).alias("repeats"))
