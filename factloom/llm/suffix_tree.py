"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are all words of the training texts and the end of a document. Contexts of up to `depth` words
are kept where their next-symbol distribution diverges from that of the context one word shorter by
enough evidence (count times Kullback-Leibler divergence); every context that does is kept. Each kept
distribution is smoothed with the shorter context's, down to discounted word counts whose discount is
the probability of the unknown. A token is scored in the longest kept suffix of the words before it. All
words that training did not see are one token, as in the base score.

Words, contexts and (context, symbol) pairs are 64-bit hashes. All contexts that end in one word meet in
one task, with all tokens behind them, so a task counts its part of the tree, scores its tokens and writes
neither: only sums of texts leave it. Contexts with very many tokens are dealt in parts by the word before
them, which a task judges one by one, and by which the most frequent ones go to several tasks; each of those
tasks gets the context's own counts first, summed up where the texts are read.
The corpus is dealt in slices, one after the other, so the disk holds the tokens of one slice at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import arrays
from factloom.llm.frames import bit_set, cut, drop, forgotten_shuffles, maybe, merge_join, small_batches

U64 = np.uint64
END = U64(0x5851F42D4C957F2D)
BASE = U64(0x9E3779B97F4A7C15)
#: Words and contexts of a block that stand before less than this share of its tokens are not thought of as very frequent.
SHARE = 1024
#: Rows that are judged together, where contexts allow it: their arrays stay in the processor's cache.
CHUNK = 30_000
#: What comes before the parts of the tokens, which are numbered from 0: counts of rare words and of frequent contexts.
RARE, COUNTS = -2, -1


@dataclass(frozen=True)
class TreeParams:
    """gain: least evidence in nats of a kept context. prior: pseudo-count of the shorter context's
    distribution for each kind of successor. hot: most words whose counts are broadcast; the rest is
    joined. symbols: tokens of a context from which on it is dealt in parts. task: tokens that a task shall
    score. spread: no task shall score more than this share of one context. slices: most parts of the corpus that are dealt one after the other. None of these
    changes a result. bits: log2 of the size of the bit set of words that are not broadcast."""

    depth: int = 3
    symbols: int = 500_000
    gain: float = 10.0
    prior: float = 1.0
    hot: int = 150_000
    bits: int = 25
    task: int = 400_000
    spread: int = 128
    slices: int = 5


@dataclass(frozen=True)
class Deal:
    """slices and tasks (of a slice); often: hashes and counts of the contexts of each length from 1 that are
    dealt in parts of some `symbols` tokens; most: tokens of such a context from which on it goes to several
    tasks."""

    slices: int
    tasks: int
    often: list[tuple[np.ndarray, np.ndarray]]
    symbols: int
    most: int

    def slice(self, first: np.ndarray) -> np.ndarray:
        """Of contexts of one word."""
        return ((first >> U64(40)) % U64(self.slices)).astype(np.int64)

    def places(self, ctx: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of tokens with their contexts of 1, 2, ... words: the task, the part of its tokens, the length of
        the longest context that is dealt in parts and whose shorter ones all are, and the tasks of the
        shortest context, as their first one and their number."""
        first = (ctx[0] % U64(self.tasks)).astype(np.int64)
        many, task, part, level = np.ones(len(first), np.int64), first.copy(), np.zeros(len(first), np.int64), np.zeros(len(first), np.uint8)
        spread, parts, at = ctx[0].copy(), many.copy(), np.arange(len(first))
        for d, (keys, counts) in enumerate(self.often, 1):
            spot, hit = _find(ctx[d - 1][at], keys)
            at, spot = at[hit], spot[hit]
            if d == 1:
                parts[at] = -(-counts[spot] // self.symbols)
                many[at] = np.minimum(np.minimum(-(-counts[spot] // self.most), parts[at]), self.tasks)
            level[at] = d
            spread[at] = ctx[d][at] if d < len(ctx) else arrays.mix(ctx[d - 1][at] + at.astype(U64))
        at = np.flatnonzero(level)
        turn = (spread[at] % parts[at].astype(U64)).astype(np.int64)
        task[at], part[at] = (first[at] + turn % many[at]) % self.tasks, 1 + turn // many[at]
        return task, part, level, first, many


def first_contexts(tokens: np.ndarray) -> np.ndarray:
    """Hash of the token before every token. Before a document stands an END, as behind it."""
    out = np.empty(len(tokens), U64)
    out[:1] = END
    out[1:] = tokens[:-1]
    return arrays.mix(out + U64(1))


def contexts(tokens: np.ndarray, offs: np.ndarray, depth: int, at: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """Hashes of the 1 to `depth` tokens before those at `at`, which stand in the documents `text`. Before
    a document stand ENDs."""
    since = at - offs[text]
    out, own = [], np.zeros(len(at), U64)
    for back in range(1, depth + 1):
        before = tokens[at - back]
        before[since < back] = END
        own = arrays.mix(own * BASE + before + U64(back))
        out.append(own)
    return out


def pair_keys(ctx: np.ndarray, sym: np.ndarray) -> np.ndarray:
    return arrays.mix((ctx ^ END) * BASE + sym)


def _tokens(h: np.ndarray, woffs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with an END behind each document, and their offsets."""
    return np.insert(h, woffs[1:], END), woffs + np.arange(len(woffs))


def _counted(parts, most: int = 1_000_000):
    """Distinct values of a stream of (values, counts), merged until about `most` are held."""
    keys, counts, size = [], [], 0

    def merged():
        u, which = np.unique(np.concatenate(keys), return_inverse=True)
        return u, np.bincount(which, np.concatenate(counts), len(u)).astype(np.int64)

    for k, c in parts:
        keys.append(k)
        counts.append(c)
        size += len(k)
        if size > 2 * most:
            k, c = merged()
            keys, counts, size = [k], [c], len(k)
            if size > most:
                yield k, c
                keys, counts, size = [], [], 0
    if keys:
        yield merged()


def _learned(part: pa.RecordBatch) -> np.ndarray:
    return part.column(part.schema.get_field_index("learned")).to_numpy(zero_copy_only=False).astype(bool)


def _gathered(batches, most: int = 300_000):
    """Tokens of some `most` of texts that follow one another, their offsets, and whether each was learned from."""
    parts, size = [], 0

    def whole():
        tokens, toffs, learned = zip(*parts, strict=True)
        starts = np.cumsum([0, *map(len, tokens)])
        return np.concatenate(tokens), np.concatenate([[0], *(o[1:] + at for o, at in zip(toffs, starts[:-1], strict=True))]), np.concatenate(learned)

    for part, data, offs in arrays.blocks(batches, "text", arrays.WORD_BYTES):
        tokens, toffs = _tokens(*arrays.word_hashes(data, offs))
        parts.append((tokens, toffs, np.repeat(_learned(part), np.diff(toffs))))
        size += len(tokens)
        if size >= most:
            yield whole()
            parts, size = [], 0
    if parts:
        yield whole()


def census(docs: DataFrame, depth: int) -> DataFrame:
    """(length, key, n) of texts with the column `learned`. Length 0: hash and count of every word of the
    training texts. 1 to depth: contexts that are frequent in some block of texts, and how many tokens
    stand behind them in such blocks. -1: all tokens."""

    def run(batches):
        often, tokens_seen = [], 0

        def words():
            nonlocal tokens_seen
            for tokens, toffs, learned in _gathered(batches):
                tokens_seen += len(tokens)
                word, which = _ids(tokens)
                n = np.bincount(which[learned], minlength=len(word))
                some = (n > 0) & (word != END)
                yield word[some].view(np.int64), n[some]
                n = np.bincount(which)
                some = n * SHARE >= len(tokens)
                often.append((1, arrays.mix(word[some] + U64(1)), n[some]))
                at = np.flatnonzero(some[which[:-1]]) + 1
                for d in range(2, depth + 1):
                    ctx, which = _ids(contexts(tokens, toffs, d, at, np.searchsorted(toffs, at, "right") - 1)[-1])
                    n = np.bincount(which, minlength=len(ctx))
                    some = n * SHARE >= len(tokens)
                    often.append((d, ctx[some], n[some]))
                    at = at[some[which]]

        for k, c in _counted(words()):
            yield _census_rows(0, k, c)
        for d, k, n in often:
            yield _census_rows(d, k.view(np.int64), n)
        yield _census_rows(-1, np.zeros(1, np.int64), np.array([tokens_seen]))

    return docs.select("text", "learned").mapInArrow(run, "length int, key long, n long").groupBy("length", "key").agg(F.sum("n").alias("n"))


def _census_rows(length: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), length, np.int32)), pa.array(keys), pa.array(n.astype(np.int64))], ["length", "key", "n"])


def _hottest(rows: DataFrame, key: str, n: str, most: int):
    """Least count of the at most `most` rows with the highest counts, all of each count, and those rows
    by ascending key."""
    shape = rows.groupBy(F.least(n, F.lit(most)).alias("n")).count().orderBy(F.col("n").desc()).toArrow()
    fits = np.flatnonzero(np.cumsum(shape["count"].to_numpy()) <= most)
    least = int(shape["n"][int(fits[-1])].as_py()) if len(fits) else 1 << 62
    return least, rows.where(F.col(n) >= least).toArrow().sort_by(key)


def _find(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and whether each key stands there."""
    if not len(among):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return at, among[at] == keys


def _ids(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the number of each key among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    head = np.ones(len(keys), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    ids = np.empty(len(keys), np.int64)
    ids[order] = np.cumsum(head) - 1
    return ordered[head], ids


def _chunks(order: np.ndarray, keys: np.ndarray):
    """Parts of `order`, by which keys ascend, of CHUNK rows or more, so that no key stands in two."""
    ordered, lo = keys[order], 0
    while lo < len(order):
        hi = int(np.searchsorted(ordered, ordered[min(lo + CHUNK, len(order)) - 1], "right"))
        yield order[lo:hi]
        lo = hi


def _packed(*columns: np.ndarray) -> bytes:
    return b"".join([np.array([len(c) for c in columns], np.int64).tobytes(), *(np.ascontiguousarray(c).tobytes() for c in columns)])


def _unpacked(data: memoryview, *kinds) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _joined(parts: list[list[np.ndarray]], *kinds) -> list[np.ndarray]:
    """The columns of all parts, each as one array."""
    return [np.concatenate([p[i] for p in parts] or [np.zeros(0, kind)]) for i, kind in enumerate(kinds)]


PACKS = "task int, part int, data binary"


def _packs(part: np.ndarray | int, tasks: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each task and part, which holds its rows of the columns, by ascending values of the first
    one. Parts are numbers from 0, or all rows have one."""
    width = int(tasks.max(initial=0)) + 1
    place = tasks if isinstance(part, int) else tasks + width * part
    order = np.argsort(columns[0])
    order = order[np.argsort((place.astype(np.uint16) if place.max(initial=0) < 1 << 16 else place)[order], kind="stable")]
    place, columns = place[order], [c[order] for c in columns]
    at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    data = [_packed(*(c[lo:hi] for c in columns)) for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(place)], strict=True)]
    parts = np.full(len(at), part) if isinstance(part, int) else place[at] // width
    return pa.RecordBatch.from_arrays([pa.array((place[at] % width).astype(np.int32)), pa.array(parts.astype(np.int32)), pa.array(data, pa.binary())], ["task", "part", "data"])


def _dealt(docs: DataFrame, number: int, deal: Deal, depth: int, most: int) -> DataFrame:
    """PACKS of the tokens of one slice, at most `most` in each, and of the counts of frequent contexts."""
    held = docs.sparkSession.sparkContext.broadcast(deal)

    def packs(parts):
        deal = held.value
        *ctx, sym, key = (np.concatenate(x) for x in zip(*parts, strict=True))
        task, part, level, first, many = deal.places(ctx)
        yield _packs(part, task, [*ctx, sym, level, key])
        learned = (key & 1).astype(bool)
        for d in range(1, depth + 1):
            at = np.flatnonzero((level >= d) & learned)
            if not len(at):
                return
            _, lead, n = np.unique(pair_keys(ctx[d - 1][at], sym[at]), return_index=True, return_counts=True)
            at = at[lead]
            row = np.repeat(np.arange(len(at)), many[at])
            turn = np.arange(len(row)) - np.repeat(np.cumsum(many[at]) - many[at], many[at])
            at = at[row]
            own = [*(c[at] for c in ctx[:d]), *(np.zeros(len(at), U64) for _ in ctx[d:])]
            yield _packs(COUNTS, (first[at] + turn) % deal.tasks, [*own, sym[at], np.full(len(at), d, np.uint8), n[row]])

    def run(batches):
        deal, parts, size = held.value, [], 0
        for part, data, offs in arrays.blocks(batches, "text", arrays.WORD_BYTES):
            tokens, toffs = _tokens(*arrays.word_hashes(data, offs))
            of_slice = np.flatnonzero(deal.slice(first_contexts(tokens)) == number)
            key = part.column(part.schema.get_field_index("key")).to_numpy()
            for lo in range(0, len(of_slice), most):  # a text may be very long
                at = of_slice[lo : lo + most]
                if size + len(at) > most and parts:
                    yield from packs(parts)
                    parts, size = [], 0
                text = np.searchsorted(toffs, at, "right") - 1
                parts.append((*contexts(tokens, toffs, depth, at, text), tokens[at], key[text]))
                size += len(at)
        if parts:
            yield from packs(parts)

    return docs.select("text", "key").mapInArrow(run, PACKS)


def _rare_words(docs: DataFrame, rest: DataFrame, hot: np.ndarray, deal: Deal, params: TreeParams) -> DataFrame:
    """(place, sym, c) for every task, numbered through all slices, that needs the count of a word of
    `rest`, which holds all words but the broadcast ones. Rows may repeat."""
    held = docs.sparkSession.sparkContext.broadcast((hot, bit_set(rest, "key", params.bits), deal))

    def run(batches):
        hot, known, deal = held.value
        got = []

        def rows():
            sym, place = (np.concatenate(x) for x in zip(*got, strict=True))
            which = _ids(pair_keys(sym, place.astype(U64)))[1]
            one = np.empty(int(which.max()) + 1, np.int64)
            one[which] = np.arange(len(which))
            return pa.RecordBatch.from_arrays([pa.array(place[one].astype(np.int32)), pa.array(sym[one].view(np.int64))], ["place", "key"])

        for _, data, offs in arrays.blocks(batches, "text", arrays.WORD_BYTES):
            tokens, toffs = _tokens(*arrays.word_hashes(data, offs))
            at = np.flatnonzero(maybe(tokens, known))
            at = at[~_find(tokens[at].view(np.int64), hot)[1]]
            if not len(at):
                continue
            ctx = contexts(tokens, toffs, params.depth, at, np.searchsorted(toffs, at, "right") - 1)
            *_, first, many = deal.places(ctx)
            row = np.repeat(np.arange(len(at)), many)
            turn = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            got.append((tokens[at][row], deal.slice(ctx[0][row]) * deal.tasks + (first[row] + turn) % deal.tasks))
            if sum(len(x) for x, _ in got) > 1_000_000:
                yield rows()
                got = []
        if got:
            yield rows()

    # each word of the rest stands once, so a task's share of them is small and no row need be sorted
    told = docs.select("text").mapInArrow(run, "place int, key long").join(rest.select("key", "n").hint("shuffle_hash"), "key")
    return cut(told.withColumn("slice", F.expr(f"place div {deal.tasks}").cast("int")), "slice")


def _rare_packs(rare: DataFrame, number: int, tasks: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            place, sym, c = (batch.column(i).to_numpy() for i in range(3))
            if len(place):
                yield _packs(RARE, place - number * tasks, [sym.view(U64), c])

    return rare.where(F.col("slice") == number).select("place", "key", "n").mapInArrow(run, PACKS)


def _smoothed(seen: np.ndarray, of: np.ndarray, size: np.ndarray, up: np.ndarray, m: np.ndarray, below: np.ndarray, params: TreeParams) -> tuple[np.ndarray, np.ndarray]:
    """log10 probabilities of pairs behind their contexts, and for each context what it gives to the shorter
    one, 0 if it is not kept.

    seen, of: count and context of each pair; size: tokens of each context; up, m, below: count of each pair,
    tokens and log10 probability in the context one word shorter.
    """
    told = np.flatnonzero(seen)
    evidence = seen[told] * (np.log(seen[told] / size[of[told]]) - np.log(up[told] / m[told]))
    gain, kinds = np.bincount(of[told], evidence, len(size)), np.bincount(of[told], minlength=len(size))
    extra = np.where((size > 0) & (gain >= params.gain), params.prior * kinds, 0.0)
    kept = np.flatnonzero(extra[of])
    more = extra[of[kept]]
    mass, lp = size[of[kept]] + more, below.copy()
    lp[kept] = np.log10(seen[kept] / mass + more / mass * 10 ** below[kept])
    return lp, extra


class Given:
    """Pairs and contexts of one length whose counts a task is given."""

    def __init__(self, pairs=None, seen=None, lp=None, ctx=None, size=None, extra=None):
        self.pairs, self.seen, self.lp, self.ctx, self.size, self.extra = pairs, seen, lp, ctx, size, extra

    def look(self, ctx: np.ndarray, sym: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probabilities, counts, and tokens of the contexts; below: log10 probabilities in the context
        one word shorter."""
        lp, up, m = below.copy(), np.zeros(len(sym)), np.zeros(len(sym))
        if self.pairs is None:
            return lp, up, m
        spot, known = _find(ctx, self.ctx)
        m[known] = self.size[spot[known]]
        extra = np.where(known, self.extra[spot], 0)
        lp[extra > 0] += np.log10(extra[extra > 0] / (m + extra)[extra > 0])
        spot, hit = _find(pair_keys(ctx, sym), self.pairs)
        lp[hit], up[hit] = self.lp[spot[hit]], self.seen[spot[hit]]
        return lp, up, m


def given(ctx: list[np.ndarray], sym: np.ndarray, own: np.ndarray, n: np.ndarray, c: np.ndarray, lp: np.ndarray, total: int, params: TreeParams) -> list[Given]:
    """Of each length: from counts n of symbols behind contexts of `own` words, which stand here as a whole and
    with their shorter ones. c, lp, total: as in log_probabilities."""
    out = []
    for d in range(1, len(ctx) + 1):
        at = np.flatnonzero(own == d)
        if not len(at):
            out.append(Given())
            continue
        pairs, pair = _ids(pair_keys(ctx[d - 1][at], sym[at]))
        seen, one = np.bincount(pair, n[at]), np.empty(len(pairs), np.int64)
        one[pair] = at
        keys, of = _ids(ctx[d - 1][one])
        size = np.bincount(of, seen)
        below, up, m = (lp[one], c[one], np.full(len(one), float(total))) if d == 1 else out[-1].look(ctx[d - 2][one], sym[one], below_of(ctx, sym, one, d - 2, lp, out))
        smooth, extra = _smoothed(seen, of, size, up, m, below, params)
        out.append(Given(pairs, seen, smooth, keys, size, extra))
    return out


def below_of(ctx: list[np.ndarray], sym: np.ndarray, at: np.ndarray, depth: int, lp: np.ndarray, known: list[Given]) -> np.ndarray:
    """log10 probabilities of rows in given contexts of `depth` words."""
    below = lp[at]
    for d in range(depth):
        below = known[d].look(ctx[d][at], sym[at], below)[0]
    return below


def log_probabilities(ctx: list[np.ndarray], sym: np.ndarray, n: np.ndarray, level: np.ndarray, c: np.ndarray, lp: np.ndarray, total: int, known: list[Given], params: TreeParams) -> np.ndarray:
    """log10 probability of every row's symbol behind its contexts. Those of up to `level` words are given,
    the longer ones stand here with all their rows.

    A row counts n times. c and lp: count and log10 probability of its symbol without a context; total: of all
    symbols. A context of n tokens gains at most n log(m / n) on a shorter one of m tokens, so contexts longer
    than one with m < e gain are not looked at.
    """
    p = params
    least = p.gain * math.e * (1 - 1e-9)
    lp, up, m = lp.copy(), c.astype(np.float64), np.full(len(sym), float(total))
    active = np.arange(len(sym))
    for d, own in enumerate(ctx, 1):
        if d > 1:
            active = active[m[active] >= least]
        if not len(active):
            break
        at = active[level[active] >= d]
        if len(at):
            lp[at], up[at], m[at] = known[d - 1].look(own[at], sym[at], lp[at])
        at = active[level[active] < d] if len(at) else active
        if not len(at):
            continue
        group = _ids(own[at])[1]
        pair = _ids(pair_keys(own[at], sym[at]))[1]
        size, seen = np.bincount(group, n[at]), np.bincount(pair, n[at])
        one = np.empty(len(seen), np.int64)
        one[pair] = np.arange(len(at))
        of, one = group[one], at[one]  # pairs are judged, not rows
        below = _smoothed(seen, of, size, up[one], m[one], lp[one], p)[0]
        lp[at], up[at], m[at] = below[pair], seen[pair], size[group]
    return lp


def _summed(parts: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """Counts of pairs as one part, each pair once."""
    *ctx, sym, own, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    pair = _ids(pair_keys(np.choose(own - 1, ctx), sym) + own.astype(U64))[1]
    one = np.empty(int(pair.max()) + 1, np.int64)
    one[pair] = np.arange(len(pair))
    return [[*(c[one] for c in ctx), sym[one], own[one], np.bincount(pair, n).astype(np.int64)]]


def score_documents(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", params: TreeParams = TreeParams()) -> DataFrame:
    """Score every row under a tree and a unigram base, both learned from the rows where `learn` holds.

    Returns doc_id, learned, n_tokens, n_known, train_tokens, base_score and score. A null text is empty:
    one end token. Repeated rows, and rows that share an id, are scored one by one. With nothing to learn
    from every word is unknown and both scores are those of the unknown. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    with forgotten_shuffles(docs.sparkSession):
        return _score_documents(docs, learn, id_col, text_col, params)


def _score_documents(docs: DataFrame, learn: Column, id_col: str, text_col: str, p: TreeParams) -> DataFrame:
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learned"))
    # texts are told apart by a hash, of which the last bit says whether they were learned from
    base = base.withColumn("key", F.xxhash64("text").bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(F.col("learned").cast("long")))
    found = cut(census(base, p.depth))
    counts = found.where("length = 0").select("key", "n")
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = base.where("learned").count()
    total, kinds = size.n + ends, size.v + (ends > 0)
    once = {r.n: r["count"] for r in counts.where("n <= 2").groupBy("n").count().collect()}
    discount = once.get(1, 0) / max(1, once.get(1, 0) + 2 * once.get(2, 0))
    discount = min(0.95, max(0.05, discount))

    some = max(1, total)
    unknown = float(np.log10(max(discount * kinds, 0.5) / some))
    end_root = float(np.log10(max(ends - discount, 0.5) / some))
    divide = float(np.log10(total + 0.5 * (kinds + 1)))
    least, hot = _hottest(counts, "key", "n", p.hot)
    hot, c_hot = hot["key"].to_numpy(), hot["n"].to_numpy()
    tokens = found.where("length = -1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    often = found.where((F.col("length") > 0) & (F.col("n") > p.symbols)).toArrow()
    length, key, n = (often[c].to_numpy() for c in ("length", "key", "n"))
    order = np.argsort(key.view(U64))
    length, key, n = length[order], key.view(U64)[order], n[order]
    slices = max(1, min(p.slices, -(-tokens // p.task)))
    deal = Deal(slices, max(1, -(-tokens // (slices * p.task))), [(key[length == d], n[length == d]) for d in range(1, p.depth + 1)], p.symbols, max(p.symbols, -(-tokens // p.spread)))
    rest = counts.where(F.col("n") < least)
    rare = _rare_words(base, rest, hot, deal, p) if size.v > len(hot) else None
    held = spark.sparkContext.broadcast((hot, c_hot))
    token_kinds = [*[U64] * (p.depth + 1), np.uint8, np.int64]

    def judge(batches):
        """From all rows of a task, counts first and then part by part, to sums of its texts."""
        counts, rare, tokens, known, here, size = [], [], [], None, 0, 0

        def words(sym):
            """Of every row's symbol without a context: its count, log10 probability and base score."""
            word, which = _ids(sym)
            c = np.zeros(len(word), np.int64)
            for keys, n, own in ((*held.value, word.view(np.int64)), (*rare, word)):
                spot, hit = _find(own, keys)
                c[hit] = n[spot[hit]]
            lp = np.full(len(word), unknown)
            lp[c > 0] = np.log10((c[c > 0] - discount) / some)
            c[word == END], lp[word == END] = ends, end_root
            return c[which], lp[which], (np.log10(c + 0.5) - divide)[which]

        def judged():
            nonlocal rare, known
            if known is None:
                keys, n = _joined(rare, U64, np.int64)
                order = np.argsort(keys)
                rare = (keys[order], n[order])
                *ctx, sym, own, n = _joined(_summed(counts) if counts else [], *token_kinds)
                known = given(ctx, sym, own, n, *words(sym)[:2], total, p)
                counts.clear()
            *ctx, sym, level, key = _joined(tokens, *token_kinds)
            out, gained, seen = np.empty(len(sym)), np.empty(len(sym)), np.empty(len(sym), bool)
            for at in _chunks(np.argsort(ctx[0]), ctx[0]):
                c, lp, gained[at] = words(sym[at])
                out[at] = log_probabilities([x[at] for x in ctx], sym[at], key[at] & 1, level[at], c, lp, total, known, p)
                seen[at] = c > 0
            text, at = _ids(key)
            sums = [np.bincount(at, x) for x in (out, gained)] + [np.bincount(at, x, len(text)).astype(np.uint32) for x in (seen, None, sym == END)]
            return _packs(0, (arrays.mix(text.view(U64)) % U64(sum_tasks)).astype(np.int64), [text, *sums])

        for batch in batches:
            for part, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if part == RARE:
                    rare.append(_unpacked(data.as_buffer(), U64, np.int64))
                elif part == COUNTS:
                    counts.append(_unpacked(data.as_buffer(), *token_kinds))
                    size += len(counts[-1][-1])
                    if size > 2_000_000 and len(counts) > 1:
                        counts = _summed(counts)
                        size = len(counts[0][-1]) // 2  # merged again when as much has come anew
                else:
                    if tokens and part != here:
                        yield judged()
                        tokens = []
                    here = part
                    tokens.append(_unpacked(data.as_buffer(), *token_kinds))
        if tokens:
            yield judged()

    def add(batches):
        parts = [_unpacked(data.as_buffer(), *sum_kinds) for batch in batches for data in batch.column(2)]
        key, *sums = _joined(parts, *sum_kinds)
        if len(key):
            text, at = _ids(key)
            sums = [np.bincount(at, x).astype(np.int64 if kind is np.uint32 else kind) for x, kind in zip(sums, sum_kinds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (text, *sums)], ["key", "score", "base", "known", "tokens", "ends"])

    sum_tasks, sum_kinds = -(-deal.tasks // 4), [np.int64, np.float64, np.float64, np.uint32, np.uint32, np.uint32]
    scored = []
    for number in range(deal.slices):
        rows = _dealt(base, number, deal, p.depth, p.task)
        if rare is not None:
            rows = rows.union(_rare_packs(rare, number, deal.tasks))
        sums = rows.repartitionById(deal.tasks, "task").sortWithinPartitions("part").mapInArrow(judge, PACKS)
        scored.append(cut(sums.repartitionById(sum_tasks, "task").mapInArrow(add, "key long, score double, base double, known long, tokens long, ends long")))
    drop(found, *([rare] if rare is not None else []))
    sums = scored[0]
    for more in scored[1:]:
        sums = sums.union(more)
    sums = sums.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("score", "base", "known", "tokens", "ends")))
    return merge_join(base.select("doc_id", "learned", "key"), sums, "key").select(
        "doc_id",
        "learned",
        (F.col("tokens") / F.col("ends")).cast("long").alias("n_tokens"),
        (F.col("known") / F.col("ends")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("ends")).alias("base_score"),
        (F.col("score") / F.col("ends")).alias("score"),
    )


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """All documents, scored by models of four fifths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    return score_documents(docs, ~held_out).withColumn("held_out", ~F.col("learned")).drop("learned")
