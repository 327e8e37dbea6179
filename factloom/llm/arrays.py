"""Numpy views of Arrow text columns: whole batches of words and byte ranges are hashed at once.

All functions work on one block of documents: `data` holds their UTF-8 bytes one after another and
`offs` the n+1 byte offsets. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
BLOCK_BYTES = 2_000_000
#: Blocks for work on single words: their arrays stay in the processor's cache.
WORD_BYTES = 120_000

_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_POW = np.ones(1, U64)
_INV = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    global _POW, _INV
    if len(_POW) <= n:
        size = max(n + 1, len(_POW) * 3 // 2, BLOCK_BYTES + 1)
        base = np.full(size, _BASE, U64)
        base[0] = 1
        inverse = np.full(size, pow(_BASE, -1, 2**64), U64)
        inverse[0] = 1
        _POW, _INV = np.cumprod(base), np.cumprod(inverse)
    return _POW, _INV


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    h = h ^ (h >> U64(30))  # a new array, changed in place from here on
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def strings(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, values = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def blocks(batches, text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut record batches into runs of rows with at most `limit` text bytes, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = strings(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to
    pa.default_memory_pool().release_unused()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; differences of it give the hash of any byte range."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_TABLE[data] * _powers(len(data))[0][: len(data)], out=out[1:])
    return out


def word_prefix(hashes: np.ndarray) -> np.ndarray:
    """prefix_hash of a sequence of word hashes: differences of it give the hash of any run of words."""
    out = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * _powers(len(hashes))[0][: len(hashes)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of bytes or words, equal wherever those are equal."""
    return mix((prefix[ends] - prefix[starts]) * _powers(len(prefix))[1][starts])


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the n+1 offsets of each document's words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    full = offs[1:] > offs[:-1]
    before[offs[:-1][full]] = False
    after[offs[1:][full] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    return starts, np.flatnonzero(solid & ~after) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z lower-cased, and word offsets of the documents."""
    starts, ends, woffs = words(data, offs)
    return range_hash(prefix_hash(LOWER[data]), starts, ends), woffs


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on where as many follow, as shingles() has them."""
    n = len(hashes) - k + 1
    acc = np.full(n, k, U64) * U64(0xD6E8FEB86659FD93)
    for j in range(k):
        acc *= U64(_BASE)
        acc += hashes[j : j + n]
        acc = mix(acc)
    return acc


def shingles(hashes: np.ndarray, woffs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles and their offsets; 1 to k-1 words are one shingle."""
    n = np.diff(woffs)
    m = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    soffs = np.concatenate([[0], np.cumsum(m)])
    owner = np.repeat(np.arange(len(n)), m)
    first = woffs[:-1][owner] + np.arange(soffs[-1]) - soffs[:-1][owner]
    if len(n) and n.min() >= k:
        return run_hashes(hashes, k)[first], soffs
    length = np.minimum(n, k)[owner]
    acc = length.astype(U64) * U64(0xD6E8FEB86659FD93)
    for j in range(k):
        w = hashes[np.minimum(first + j, len(hashes) - 1)] if len(hashes) else hashes
        acc = np.where(j < length, mix(acc * U64(_BASE) + w), acc)
    return acc, soffs
