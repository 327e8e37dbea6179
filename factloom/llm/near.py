"""Near-duplicate groups by min-max hashing.

Each permutation of the shingle hashes is evaluated once and yields two signature values, its minimum
and its maximum over a unit. Bands of those values propose pairs; every proposed pair whose signature
does not rule it out is confirmed on the full shingle sets, and confirmed links are closed into
components. A unit is a whole text, or what another module cuts texts into.

How large groups stay cheap without losing a link:

1. Units with equal shingle sets collapse into one node.
2. A node is first tested with one hub, the most connected member of its buckets, so a group of N near
   copies costs N tests, not N*N.
3. What that leaves apart is tested with the hubs of its other buckets.
4. Members that no hub joined are compared with the rest of their bucket, in blocks of bounded size. An
   exact bound from the overlap with the hub drops pairs that cannot reach the threshold; the others are
   confirmed inside the block, the likeliest first, unless links have joined them meanwhile.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import arrays
from factloom.llm.components import components
from factloom.llm.frames import bit_set, cut, drop, maybe, merge_join, shared, small_batches

#: A block of texts to its units: ids, word hashes and the n+1 offsets of each unit's words.
Units = Callable[[pa.RecordBatch, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class NearParams:
    """k words a shingle; linked if 100 * intersection >= percent * union.

    values / 2 permutations give `values` signature values; the first bands x rows of them make the
    bands. With 30 bands of 5 a pair at 0.8 is missed with probability (1 - 0.8**5)**30 < 7e-6. `sure`
    signature standard deviations below the threshold, a pair is dropped unread (4.4: less than 6e-6 of
    the pairs at the threshold; None reads every proposed pair). bits: log2 of the size of the bit set of nodes whose
    sets are written.
    """

    k: int = 5
    percent: int = 80
    bands: int = 30
    rows: int = 5
    values: int = 400
    sure: float | None = 4.4
    block: int = 4096
    bits: int = 25
    seed: int = 7

    @property
    def least_equal(self) -> int:
        t = self.percent / 100
        return 0 if self.sure is None else int(self.values * t - self.sure * (self.values * t * (1 - t)) ** 0.5)


def _constants(p: NearParams, n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    made = -(-p.values // 2)
    return (rng.integers(1, 2**63, made, dtype=np.uint64) * arrays.U64(2) + arrays.U64(1))[:n], rng.integers(0, 2**63, made, dtype=np.uint64)[:n]


def signatures(hashes: np.ndarray, offs: np.ndarray, p: NearParams, values: int | None = None) -> np.ndarray:
    """(units, values) minima and maxima, of the first `values` if told; only for units with a shingle."""
    n = -(-(values or p.values) // 2)
    mult, add = _constants(p, n)
    out = np.empty((len(offs) - 1, 2 * n), np.uint64)
    lo = 0
    while lo < len(out):
        # as many units at once as the processor's cache holds
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + (1 << 14), "right")) - 1)
        own, at = hashes[offs[lo] : offs[hi]], offs[lo:hi] - offs[lo]
        h, found = np.empty_like(own), np.empty((2 * n, hi - lo), np.uint64)
        for j in range(n):
            np.multiply(own, mult[j], out=h)
            h += add[j]
            np.minimum.reduceat(h, at, out=found[2 * j])
            np.maximum.reduceat(h, at, out=found[2 * j + 1])
        out[lo:hi] = found.T
        lo = hi
    return out


def band_keys(sig: np.ndarray, p: NearParams) -> np.ndarray:
    acc = np.broadcast_to(np.arange(p.bands, dtype=np.uint64), (len(sig), p.bands)).copy()
    for i in range(p.rows):
        acc = arrays.mix(acc * arrays.U64(0x9E3779B97F4A7C15) + sig[:, i : p.bands * p.rows : p.rows])
    return acc.view(np.int64)


def whole_texts(part: pa.RecordBatch, data: np.ndarray, offs: np.ndarray):
    """Every text is one unit, named by its `id`."""
    return part.column(part.schema.get_field_index("id")), *arrays.word_hashes(data, offs)


class _Seen:
    """Keys that a task has met lately: a table of fixed size that forgets, but never invents one."""

    def __init__(self, bits: int = 18):
        self.held = np.zeros((1 << bits, 2), np.uint64)

    def fresh(self, keys: np.ndarray) -> np.ndarray:
        """Mask of the first occurrences of (n, 2) keys that the table doesn't hold; it holds them afterwards."""
        _, first = np.unique(keys, axis=0, return_index=True)
        slot = (keys[first, 0] & arrays.U64(len(self.held) - 1)).astype(np.int64)
        new = (self.held[slot] != keys[first]).any(1)
        self.held[slot] = keys[first]
        out = np.zeros(len(keys), bool)
        out[first[new]] = True
        return out


def features(texts: DataFrame, p: NearParams, units: Units = whole_texts) -> DataFrame:
    """(id, n, set_key, keys) of every unit: its distinct shingles, a digest of them and its band keys.

    n = 0 and null keys without a word; null keys too where the task gave those of an equal set before.
    """

    def run(batches):
        seen = _Seen()
        for part, data, offs in arrays.blocks(batches, "text"):
            ids, wh, woffs = units(part, data, offs)
            sh, soffs = arrays.shingles(wh, woffs, p.k)
            m = len(woffs) - 1
            if not m:
                continue
            full = np.flatnonzero(soffs[1:] > soffs[:-1])
            sets = [np.unique(sh[soffs[i] : soffs[i + 1]]) for i in full]
            digests = [xxhash.xxh3_128_digest(own.tobytes()) for own in sets]
            n, digest, keys = np.zeros(m, np.int64), np.full(m, None, object), np.full(m, None, object)
            n[full], digest[full] = [len(own) for own in sets], digests
            if len(full):
                new = np.flatnonzero(seen.fresh(np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)))
                if len(new):
                    soff = np.concatenate([[0], np.cumsum([len(sets[i]) for i in new])])
                    rows = band_keys(signatures(np.concatenate([sets[i] for i in new]), soff, p, p.bands * p.rows), p)
                    for at, i in enumerate(full[new]):
                        keys[i] = rows[at]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(digest.tolist(), pa.binary()), pa.array(keys.tolist(), pa.list_(pa.int64()))], ["id", "n", "set_key", "keys"])

    return texts.mapInArrow(run, "id long, n long, set_key binary, keys array<long>")


def _picked(hashes: np.ndarray, woffs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of some units, and their offsets."""
    size = woffs[at + 1] - woffs[at]
    offs = np.concatenate([[0], np.cumsum(size)])
    return hashes[np.repeat(woffs[at] - offs[:-1], size) + np.arange(offs[-1])], offs


def banded(texts: DataFrame, p: NearParams, units: Units) -> DataFrame:
    """(id, keys) of the units with a word, where equal ids stand for equal words: a unit whose id the task
    met lately is left out. Signatures don't ask how often a shingle stands, so no set is built."""

    def run(batches):
        seen = _Seen()
        for part, data, offs in arrays.blocks(batches, "text", arrays.WORD_BYTES):
            ids, wh, woffs = units(part, data, offs)
            ids = np.asarray(ids, np.int64)
            full = np.flatnonzero(woffs[1:] > woffs[:-1])
            full = full[seen.fresh(np.stack([ids[full].view(np.uint64)] * 2, 1))]
            if len(full):
                sh, soffs = arrays.shingles(*_picked(wh, woffs, full), p.k)
                keys = band_keys(signatures(sh, soffs, p, p.bands * p.rows), p)
                ends = pa.array(np.arange(len(full) + 1, dtype=np.int32) * p.bands)
                yield pa.RecordBatch.from_arrays([pa.array(ids[full]), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], ["id", "keys"])

    return texts.mapInArrow(run, "id long, keys array<long>")


def shingle_sets(texts: DataFrame, p: NearParams, wanted: np.ndarray, units: Units = whole_texts) -> DataFrame:
    """(id, n, sig, shingles) of the units whose id may be in the bit set `wanted`: their number of
    distinct shingles, the low byte of each signature value, and the sorted hashes as packed 64-bit integers.
    Units of equal id and equal words come once or a few times."""
    held = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        seen = _Seen()
        for part, data, offs in arrays.blocks(batches, "text", arrays.WORD_BYTES):
            ids, wh, woffs = units(part, data, offs)
            named = pa.array(ids, pa.int64())
            ids = named.fill_null(0).to_numpy()
            full = np.flatnonzero((woffs[1:] > woffs[:-1]) & maybe(ids.view(np.uint64), held.value) & named.is_valid().to_numpy(zero_copy_only=False))
            if not len(full):
                continue
            wh, woffs = _picked(wh, woffs, full)
            whole = arrays.range_hash(arrays.word_prefix(wh), woffs[:-1], woffs[1:])
            new = np.flatnonzero(seen.fresh(np.stack([whole, ids[full].view(np.uint64)], 1)))
            if not len(new):
                continue
            sh, soffs = arrays.shingles(*_picked(wh, woffs, new), p.k)
            sets = [np.unique(sh[soffs[i] : soffs[i + 1]]) for i in range(len(new))]
            size = np.array([len(own) for own in sets])
            sig = arrays.mix(signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]), p)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(ids[full[new]]), pa.array(size), pa.array([r.tobytes() for r in sig], pa.binary()), pa.array([own.tobytes() for own in sets], pa.binary())], ["id", "n", "sig", "shingles"])

    return texts.mapInArrow(run, "id long, n long, sig binary, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, p: NearParams) -> DataFrame:
    """(a, b, na, nb, common) of the pairs (a, b) whose sizes and signatures may reach the threshold."""
    names = {"a": ("na", "sa"), "b": ("nb", "sb")}
    sized = pairs
    for end, (n, sig) in names.items():
        sized = merge_join(sized, sets.select(F.col("id").alias(end), F.col("n").alias(n), F.col("sig").alias(sig)), end)
    sized = sized.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * p.percent)

    def plausible(batches):
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                s = [np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb")]
                yield from t.select(["a", "b"]).filter(pa.array((s[0] == s[1]).sum(1) >= p.least_equal)).to_batches()

    likely = sized.select("a", "b", "sa", "sb").mapInArrow(plausible, "a long, b long")
    for end, own in (("a", "xa"), ("b", "xb")):
        likely = merge_join(likely, sets.select(F.col("id").alias(end), F.col("shingles").alias(own)), end)

    def run(batches):
        for batch in batches:
            xa, xb = (batch.column(i).to_pylist() for i in (2, 3))
            rows = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(xa, xb, strict=True)]
            common = [int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) for x, y in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x, _ in rows], pa.int64()), pa.array([len(y) for _, y in rows], pa.int64()), pa.array(common, pa.int64())], ["a", "b", "na", "nb", "common"]
            )

    return likely.select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long, na long, nb long, common long")


def _linked(tested: DataFrame, p: NearParams) -> DataFrame:
    return tested.where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * p.percent)


class _Merged:
    """Components that links found by one task have joined."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, c: int) -> int:
        while (up := self.parent.get(c, c)) != c:
            self.parent[c] = self.parent.get(up, up)
            c = up
        return c

    def roots(self, codes: np.ndarray) -> np.ndarray:
        return np.array([self.root(c) for c in codes.tolist()], np.int64)


def _residual(rows: DataFrame, sets: DataFrame, p: NearParams) -> DataFrame:
    """Links (a, b) that join the members of a bucket which are not yet in one component.

    rows: key, id, n, comp, hub_comp, common (overlap with the bucket's hub or null), keys (all buckets
    of the id). Members outside the hub's component are queries against all members, in blocks of at most
    `block` rows or 64 MB of sets. A block confirms its plausible pairs, the likeliest first, in the least
    bucket that they share, and skips those that links have joined meanwhile: no pair leaves it but links.
    """
    split = rows.withColumn("query", F.col("comp") != F.col("hub_comp"))
    held = lambda n, rows: F.ceil(F.greatest(rows / p.block, n / (8 << 20))).cast("int")
    own = F.when(F.col("query"), F.col("n"))
    counts = split.groupBy("key").agg(held(F.sum("n"), F.count("*")).alias("nm"), held(F.coalesce(F.sum(own), F.lit(0)), F.count(own)).alias("nq")).where("nq > 0")
    split = merge_join(split, counts, "key").withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 30)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["id", "comp", "common", "keys"]
    members = split.select("key", (F.col("h") % F.col("nm")).cast("int").alias("mb"), every("nq").alias("qb"), F.lit(False).alias("query"), *cols)
    asked = split.where("query").select("key", every("nm").alias("mb"), (F.col("h") % F.col("nq")).cast("int").alias("qb"), F.lit(True).alias("query"), *cols)
    dealt = merge_join(members.union(asked), sets, "id").repartition("key", "mb", "qb").sortWithinPartitions("key", "mb", "qb", "query")

    def compare(t: pa.Table, merged: _Merged):
        """Links of whole groups; in each group the members come first, then the queries."""
        ids, n, key = (t.column(c).to_numpy() for c in ("id", "n", "key"))
        labels, comp = np.unique(t.column("comp").to_numpy(), return_inverse=True)
        root = merged.roots(labels)
        common, query = t.column("common").fill_null(-1).to_numpy(), t.column("query").to_numpy(zero_copy_only=False).astype(bool)
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        held = t.column("shingles").to_pylist()
        at = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("key", "mb", "qb")], 1)
        start = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(1)]))
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(at))))
        members = np.bincount(group, ~query, len(start)).astype(np.int64)
        lists = t.column("keys").to_pylist()
        buckets = np.full((len(ids), max(map(len, lists))), np.iinfo(np.int64).max)
        for row, own in enumerate(lists):
            buckets[row, : len(own)] = own
        asked = np.flatnonzero(query)
        ends = np.cumsum(members[group[asked]])
        links, lo = [], 0
        while lo < len(asked):
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + 1_000_000, "right")))
            rows = asked[lo:hi]
            lo, reps = hi, members[group[rows]]
            x = np.repeat(rows, reps)
            y = np.repeat(start[group[rows]] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
            near = (root[comp[x]] != root[comp[y]]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * p.percent)
            x, y = x[near], y[near]
            # with the hub's set h: |x & y| <= min(|x & h|, |y & h|) + min(|x - h|, |y - h|)
            told = (common[x] >= 0) & (common[y] >= 0)
            bound = np.where(told, np.minimum(common[x], common[y]) + np.minimum(n[x] - common[x], n[y] - common[y]), np.minimum(n[x], n[y]))
            near = bound * 100 >= (n[x] + n[y] - bound) * p.percent
            x, y = x[near], y[near]
            equal = np.concatenate([(sig[x[i : i + 50_000]] == sig[y[i : i + 50_000]]).sum(1) for i in range(0, len(x), 50_000)]) if len(x) else np.zeros(0, np.int64)
            order = np.flatnonzero(equal >= p.least_equal)
            order = order[np.argsort(-equal[order], kind="stable")]
            for i in range(0, len(order), 1000):
                x_now, y_now = x[order[i : i + 1000]], y[order[i : i + 1000]]
                near = root[comp[x_now]] != root[comp[y_now]]
                x_now, y_now = x_now[near], y_now[near]
                both = (buckets[x_now][:, :, None] == buckets[y_now][:, None, :]).any(2)
                least = np.where(both, buckets[x_now], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
                for a, b in zip(*(z[least == key[x_now]].tolist() for z in (x_now, y_now)), strict=True):
                    if root[comp[a]] == root[comp[b]]:
                        continue
                    u, v = np.frombuffer(held[a], np.uint64), np.frombuffer(held[b], np.uint64)
                    same = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
                    if same * 100 >= (len(u) + len(v) - same) * p.percent:
                        links.append((int(ids[a]), int(ids[b])))
                        into, gone = root[comp[a]], root[comp[b]]
                        merged.parent[int(gone)] = int(into)
                        root[root == gone] = into
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    def run(batches):
        merged, held = _Merged(), []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.nbytes for b in held) < 32 << 20:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            open_rows = np.ones(len(t), bool)
            for c in ("key", "mb", "qb"):
                open_rows &= t.column(c).to_numpy() == t.column(c)[len(t) - 1].as_py()
            whole = int(np.argmax(open_rows))
            if whole:
                yield from compare(t.slice(0, whole), merged)
            held = t.slice(whole).to_batches()
        if held:
            yield from compare(pa.Table.from_batches(held).combine_chunks(), merged)

    return dealt.mapInArrow(run, "a long, b long")


def _ends(x: str, y: str) -> list:
    """An unordered pair of nodes as one row (a, b) with a < b."""
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """The node labels (id, comp) after some more links (a, b)."""
    for end in ("a", "b"):
        links = merge_join(links, comp.select(F.col("id").alias(end), F.col("comp").alias("c" + end)), end)
    edges = cut(links.select("ca", "cb").where("ca <> cb").distinct())
    if edges.isEmpty():
        drop(edges)
        return comp
    label = components(edges, "ca", "cb").withColumnsRenamed({"node": "comp", "component": "least"})
    out = cut(merge_join(comp, label, "comp", "left").select("id", F.coalesce("least", "comp").alias("comp")))
    drop(edges, comp)
    return out


def near_components(keyed: DataFrame, texts: DataFrame, p: NearParams, units: Units = whole_texts) -> DataFrame:
    """(id, comp): the least node that each node of a shared bucket reaches.

    keyed: id and band keys of every node, also more than once. texts: the rows whose units give the
    nodes' shingle sets.
    """
    bucket = cut(shared(keyed.select(F.col("keys").alias("key"), "id"), "key", "id").distinct())
    size = bucket.groupBy("key").agg(F.count("*").alias("m"))
    weight = merge_join(bucket, size, "key").groupBy("id").agg(F.sum("m").alias("w"))
    hubs = merge_join(bucket, weight, "id").groupBy("key").agg(F.max(F.struct("w", F.bitwise_not("id").alias("i"))).alias("h"), F.count("*").alias("m"))
    starred = cut(merge_join(bucket, hubs, "key").select("key", "id", F.bitwise_not("h.i").alias("hub"), F.col("h.w").alias("w"), "m"))
    drop(bucket)
    nodes = starred.select("id").distinct()
    # tasks give the set of one node each
    sets = cut(shingle_sets(texts, p, bit_set(nodes, "id", p.bits), units).dropDuplicates(["id", "n", "sig"]))
    comp = cut(nodes.select("id", F.col("id").alias("comp")))
    tested: list[DataFrame] = []

    def test(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        for old in tested:
            pairs = pairs.join(old.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        tested.append(cut(_confirmed(pairs, sets, p)))
        return _joined(comp, _linked(tested[-1], p).select("a", "b"))

    def apart(comp: DataFrame) -> DataFrame:
        told = merge_join(starred, comp, "id")
        return merge_join(told, comp.select(F.col("id").alias("hub"), F.col("comp").alias("hub_comp")), "hub")

    best = starred.where("id <> hub").groupBy("id").agg(F.max_by("hub", F.struct("w", F.bitwise_not("hub"))).alias("hub"))
    comp = test(best.select(*_ends("id", "hub")).distinct(), comp)
    comp = test(apart(comp).where("comp <> hub_comp").select(*_ends("id", "hub")).distinct(), comp)
    overlap = tested[0].union(tested[1]).select("a", "b", "common").distinct()
    overlap = overlap.select(F.col("a").alias("id"), F.col("b").alias("hub"), "common").union(overlap.select(F.col("b").alias("id"), F.col("a").alias("hub"), "common"))
    # a bucket of two is its hub's test
    told = apart(comp).where("m > 2")
    split = told.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    told = told.join(split.hint("merge"), "key", "left_semi").join(overlap.hint("merge"), ["id", "hub"], "left")
    rows = merge_join(told, sets.select("id", "n"), "id").withColumn("common", F.when(F.col("id") == F.col("hub"), F.col("n")).otherwise(F.col("common")))
    rows = cut(rows.select("key", "id", "n", "comp", "hub_comp", "common"))
    every = rows.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    comp = _joined(comp, _residual(merge_join(rows, every, "id"), sets, p))
    drop(rows)
    drop(starred, sets, *tested)
    return comp


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: NearParams = NearParams()) -> DataFrame:
    """One row per input row: (id, n_shingles, component), the least id of the near-duplicate group.

    Null, empty or blank texts have no shingle and are linked with nothing. Texts shorter than k words
    count as one shingle. Rows that share an id are one node; repeated rows give repeated output rows. A
    row without an id has the component of a row with an equal set, null if there is none. Other columns
    of `docs` are ignored; an empty table gives no row.
    """
    p = params
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    feat = cut(features(texts, p))
    classes = feat.where("n > 0").groupBy("set_key").agg(F.min("id").alias("cls"))
    members = cut(merge_join(feat.select("id", "n", "set_key"), classes, "set_key", "left").select("id", "n", F.coalesce("cls", "id").alias("cls")))
    keyed = merge_join(feat.where("keys IS NOT NULL").select("set_key", "keys"), classes, "set_key").select(F.col("cls").alias("id"), "keys")
    comp = near_components(keyed.where("id IS NOT NULL"), texts, p)
    out = cut(merge_join(members, comp.withColumnRenamed("id", "cls"), "cls", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("comp", "cls").alias("component")))
    drop(feat, members, comp)
    return out


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents on 2-word shingles at 0.8."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_groups(docs, params=NearParams(k=2))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a
), comp AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, comp.component_id, d.doc_id = comp.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN comp ON comp.doc_id = d.doc_id
"""
