"""Order-preserving packing of documents into token sequences by dynamic programming.

Documents are laid end to end in the order of their partition and cut into windows of at most `length`
tokens. A cut costs nothing at a document's end, `sentence` after a sentence and `hard` elsewhere; a
window costs its padding plus `opening`. The best cuts are found with one monotone queue: the cheapest
window start within reach is a sliding minimum of cost + position, and unpadded windows (a power of two)
are a few exact look-ups beside it.
"""

from __future__ import annotations

import base64
import json
import re
from collections import deque
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import arrays
from factloom.llm.frames import small_batches


@dataclass(frozen=True)
class PackParams:
    """ranks_path: byte-level BPE ranks (None: the public 50k file). Penalties are counted in tokens.

    Windows are chosen within blocks of about `block` tokens, so that memory does not grow with a
    partition; only a block's last window is padded for that reason. Inside a sentence of over `dense`
    tokens a hard cut is offered every `every` tokens.
    """

    ranks_path: str | None = None
    length: int = 1024
    sentence: int = 2
    hard: int = 12
    opening: int = 16
    dense: int = 48
    every: int = 16
    least_power: int = 64
    block: int = 1 << 20


#: Bytes that may follow a blank without joining it to other white space: no ASCII space or control
#: character and no lead byte of a Unicode space.
_OPENS = np.ones(256, bool)
_OPENS[:0x21] = False
_OPENS[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False


@lru_cache(maxsize=2)
def _encoding(ranks_path: str | None):
    import public_tokenizers
    import tiktoken

    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    added = {}
    if ranks_path is None:
        with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            added = {t["content"].encode(): t["id"] for t in json.load(f)["added_tokens"]}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    size = max([*ranks.values(), *added.values()]) + 1
    lengths, ends, opens = np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size, bool)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
        ends[rank] = token.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?") or token.endswith(b"\n")
        opens[rank] = token[:1].isspace()
    return encoding, lengths, ends, opens, added


def token_ids(data: np.ndarray, offs: np.ndarray, ranks_path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of a block of documents and their n+1 offsets.

    No pre-token crosses the place before a blank that a visible character follows. Texts are split
    there, each distinct part of the block is encoded once, and the ids are gathered back. Added tokens
    of the vocabulary stand for themselves wherever they are written, and text ends before them.
    """
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    encoding, lengths, _, _, added = _encoding(ranks_path)
    cut = np.zeros(len(data), bool)
    cut[:-1] = (data[:-1] == 0x20) & _OPENS[data[1:]]
    raw = data.tobytes()
    special = {m.start(): m.end() for m in re.finditer(b"|".join(map(re.escape, sorted(added, key=len, reverse=True))), raw)} if added else {}
    # not over the end of a document
    special = {a: b for a, b in special.items() if offs[np.searchsorted(offs, a, "right")] >= b}
    for a in special:
        cut[max(a - 1, 0)] = False
    joined = cut.copy()
    cut[offs[:-1][offs[1:] > offs[:-1]]] = True
    for a, b in special.items():
        cut[a + 1 : b], joined[a + 1 : b] = False, False
        cut[a] = True
        cut[min(b, len(data) - 1)] |= b < len(data)
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    # equal parts are found by their bytes
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)])
    which = parts.dictionary_encode().indices.to_numpy().astype(np.int64)
    first = np.unique(which, return_index=True)[1]
    plain = joined[starts[first]]
    begin, n = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    pool, size = [], 0
    s, e = starts[first], ends[first]
    together = np.flatnonzero(plain)
    ids = np.array(encoding.encode_ordinary(b"".join(raw[a:b] for a, b in zip(s[together].tolist(), e[together].tolist(), strict=True)).decode()), np.uint32)
    at, to = np.cumsum(lengths[ids]), np.cumsum(e[together] - s[together])
    last = np.searchsorted(at, to)
    if len(to) and not (last < len(at)).all() or (len(to) and not (at[last] == to).all()):
        together = together[:0]
    else:
        n[together] = np.diff(last + 1, prepend=0)
        begin[together] = np.append(0, last[:-1] + 1)[: len(together)]
        pool, size = [ids], len(ids)
    rest = np.setdiff1d(np.arange(len(first)), together)
    for i in [i for i in rest.tolist() if s[i] in special]:
        begin[i], n[i] = size, 1
        pool.append(np.array([added[raw[s[i] : e[i]]]], np.uint32))
        size += 1
    rest = np.array([i for i in rest.tolist() if s[i] not in special], np.int64)
    for i, own in zip(rest, encoding.encode_ordinary_batch([raw[a:b].decode() for a, b in zip(s[rest].tolist(), e[rest].tolist(), strict=True)], num_threads=1), strict=True):
        begin[i], n[i] = size, len(own)
        pool.append(np.array(own, np.uint32))
        size += len(own)
    pool = np.concatenate(pool) if pool else np.zeros(0, np.uint32)
    count = n[which]
    total = np.concatenate([[0], np.cumsum(count)])
    out = pool[np.repeat(begin[which] - total[:-1], count) + np.arange(total[-1])]
    return out, total[np.searchsorted(starts, offs)]


def cut_points(ids: np.ndarray, offs: np.ndarray, p: PackParams) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, and what a cut there costs. `offs` ends documents."""
    _, _, ends, opens, _ = _encoding(p.ranks_path)
    after = np.flatnonzero(ends[ids[:-1]] & opens[ids[1:]]) + 1 if len(ids) > 1 else np.zeros(0, np.int64)
    soft = np.union1d(after, offs[1:][offs[1:] > 0])
    gaps = np.diff(soft, prepend=0)
    wide = np.flatnonzero(gaps > p.dense)
    hard = [np.arange(soft[i] - gaps[i] + p.every, soft[i], p.every) for i in wide]
    points = np.union1d(soft, np.concatenate(hard)) if hard else soft
    cost = np.full(len(points), p.hard, np.int64)
    cost[np.searchsorted(points, soft)] = p.sentence
    cost[np.searchsorted(points, offs[1:][offs[1:] > 0])] = 0
    return points, cost


def best_cuts(points: np.ndarray, cost: np.ndarray, p: PackParams) -> np.ndarray:
    """Window ends with the least total of padding, cut costs and openings; the last point ends one."""
    place = np.concatenate([[0], points])
    exact: dict[int, list[int]] = {}
    size = p.least_power
    while size < p.length:
        at = np.searchsorted(place, place - size)
        for j in np.flatnonzero((place[at] == place - size) & (place >= size)).tolist():
            exact.setdefault(j, []).append(int(at[j]))
        size *= 2
    spots, extra = place.tolist(), [0, *cost.tolist()]
    best, back = [0] * len(spots), [0] * len(spots)
    queue: deque = deque([(0, 0)])  # (cost + place, index), rising from the left
    for j in range(1, len(spots)):
        here = spots[j]
        while spots[queue[0][1]] < here - p.length:
            queue.popleft()
        least, i = queue[0]
        least += p.length - here
        if j in exact:
            for x in exact[j]:
                if best[x] < least:
                    least, i = best[x], x
        least += extra[j] + p.opening
        best[j], back[j] = least, i
        key = least + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    ends, j = [], len(spots) - 1
    while j:
        ends.append(spots[j])
        j = back[j]
    return np.array(ends[::-1], np.int64)


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, ids binary"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: PackParams = PackParams()) -> DataFrame:
    """Pieces of documents and their places in the packed sequences; `ids` are packed 32-bit integers.

    A document is its token ids and then id 0, so a null or empty text is one token. Each task packs its
    own partition in the order it is read and nothing is shuffled; sequence ids hold the partition's
    number. Repeated rows are packed each time. Memory is bounded by a block or the longest document.
    Other columns are ignored; an empty table gives no piece.
    """
    p = params
    small_batches(docs.sparkSession)

    def pieces(ids: np.ndarray, offs: np.ndarray, names: pa.Array, base: int):
        ends = best_cuts(*cut_points(ids, offs, p), p)
        marks = np.union1d(ends, offs[1:])
        start = np.concatenate([[0], marks[:-1]])
        owner = np.searchsorted(offs, start, "right") - 1
        window = np.searchsorted(ends, start, "right")
        opened = np.concatenate([[0], ends])
        raw = ids.tobytes()
        cols = [start - offs[owner], marks - start, offs[owner + 1] - offs[owner], base + window, start - opened[window], opened[window + 1] - opened[window]]
        parts = [raw[4 * a : 4 * b] for a, b in zip(start.tolist(), marks.tolist(), strict=True)]
        arrs = [names.take(pa.array(owner)), *(pa.array(c, pa.int64()) for c in cols), pa.array(parts, pa.binary())]
        return pa.RecordBatch.from_arrays(arrs, [c.split()[0] for c in PIECES.split(", ")]), len(ends)

    def run(batches):
        base = TaskContext.get().partitionId() << 40
        held, counts, names = [], [], []

        def flush():
            nonlocal base
            offs = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            out, n = pieces(np.concatenate(held), offs, pa.concat_arrays(names), base)
            base += n
            for x in (held, counts, names):
                x.clear()
            return out

        for batch, data, offs in arrays.blocks(batches, "text"):
            ids, toffs = token_ids(data, offs, p.ranks_path)
            held.append(np.insert(ids, toffs[1:], 0))
            counts.append(np.diff(toffs) + 1)
            names.append(batch.column(batch.schema.get_field_index("doc_id")))
            if sum(map(len, held)) >= p.block:
                yield flush()
        if held:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
