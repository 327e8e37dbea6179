"""Operators against brute force on a small corpus, and on odd rows."""

import pathlib
import random
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import arrays, decontamination, fingerprints, languages, lines, near, packing, passages, sharding, suffix_tree, suffixes
from factloom.llm.components import components
from factloom.llm.frames import shared

SYLLABLES = {"aa": ["lo", "mi", "ka", "ten", "sur", "pel"], "bb": ["grü", "zen", "ost", "wir", "hab", "ne"]}


def corpus():
    rng = random.Random(5)

    def sentence(lang, n):
        return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."

    texts = ["\n".join(sentence(lang, rng.randint(5, 25)) for _ in range(rng.randint(2, 6))) for lang in ("aa", "bb") * 15]
    langs = ["aa", "bb"] * 15
    shared = sentence("aa", 60)
    for i in (3, 8, 13):
        texts[i] = texts[i][:40] + " " + shared + " " + texts[i][40:]
    common = "This line stands in very many documents of ours"
    for i in range(0, 30, 4):
        texts[i] += "\n  " + common.upper() + "\t\n" + common
    texts += [texts[5], texts[5], texts[7].replace("lo", "ka", 1), None, "", " \n ", "x", "x", texts[2] * 30]
    langs += ["bb", "bb", "bb", None, None, "aa", "aa", "aa", "aa"]
    return [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]


ROWS = corpus()
TEXT = {r[0]: r[1] or "" for r in ROWS}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3, "doc_id")
    # columns whose names the operators use inside
    for c in ("id", "n", "key", "start", "score", "_gone", "shard", "part", "text_key", "packed"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return t.encode().lower().split()


def shingle_set(t, k):
    w = words(t)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("k", [2, 5])
def test_near_groups(docs, k):
    sets = {i: shingle_set(t, k) for i, t in TEXT.items()}
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((group[a], group[b]))
                group = {i: lo if g == hi else g for i, g in group.items()}
    got = near.near_groups(docs, params=near.NearParams(k=k)).collect()
    assert {r.id: (r.n_shingles, r.component) for r in got} == {i: (len(sets[i]), group[i]) for i in sets}


@pytest.mark.parametrize("block", [3, 500_000])
def test_components(spark, block):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 120)]
    label = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(130):
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(pairs + pairs[::2] + [(None, 1), (1, None)], "a long, b long").repartition(5), block=block).collect()
    assert {r.node: r.component for r in got} == label and len(got) == len(label)


def test_packing_round_trip(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in TEXT.items():
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist()
        assert ids == tokenizer.encode(t, add_special_tokens=False).ids + [0]
        assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
    for seq in by_seq.values():
        seq.sort(key=lambda r: r.offset)
        assert [r.offset for r in seq] == np.cumsum([0] + [r.length for r in seq])[:-1].tolist()
        assert sum(r.length for r in seq) == seq[0].sequence_tokens <= 1024


@pytest.mark.parametrize("text", ["", " ", "a  b\n\n c", "don't  stop now   x", "日本 語。 é\t\tz", "x" * 5000 + " y", "<|endoftext|>", "hello <|endoftext|> world", "a  <|endoftext|><|endoftext|>  b", "x\n\n<|endoftext|>\n y<|endoftext|>", "q <|endoftext"])
def test_token_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    raw = np.frombuffer((text * 2).encode(), np.uint8)
    ids, offs = packing.token_ids(raw, np.array([0, len(text.encode()), len(raw)]))
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert ids[: offs[1]].tolist() == ids[offs[1] :].tolist() == want


def test_best_cuts_are_best():
    rng = np.random.default_rng(2)
    p = packing.PackParams(length=16, least_power=2, opening=1)
    for _ in range(50):
        points = np.unique(np.cumsum(rng.integers(1, 9, 8)))
        cost = rng.integers(0, 4, len(points))
        place, extra = [0, *points.tolist()], [0, *cost.tolist()]
        best = [0] + [10**9] * len(points)
        for j in range(1, len(place)):
            for i in range(j):
                n = place[j] - place[i]
                if n <= 16:
                    pad = 0 if n & (n - 1) == 0 and n > 1 else 16 - n
                    best[j] = min(best[j], best[i] + pad + extra[j] + 1)
        ends = packing.best_cuts(points, cost, p).tolist()
        at, total = 0, 0
        for e in ends:
            n = e - at
            assert n <= 16
            total += (0 if n & (n - 1) == 0 and n > 1 else 16 - n) + extra[place.index(e)] + 1
            at = e
        assert total == best[-1]


def test_suffix_array():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = np.append(rng.integers(1, rng.integers(2, 5), rng.integers(1, 40)), 0)
        assert suffixes.suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i, x=x: x[i:].tolist())


@pytest.mark.parametrize("hot", [5000, 2])
def test_repeats_are_exact(docs, hot):
    p = suffixes.RepeatParams(length=60, gram=40, hot=hot, fine=4)
    raw = {i: t.encode() for i, t in TEXT.items()}
    seen = Counter(b[k : k + 60] for b in raw.values() for k in range(len(b) - 59))
    got = {r.doc_id: r for r in suffixes.without_repeats(docs, params=p).collect()}
    for i, b in raw.items():
        cover = np.zeros(len(b), bool)
        for k in range(len(b) - 59):
            if seen[b[k : k + 60]] > 1:
                cover[k : k + 60] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~cover])
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), int(cover.sum()), spans)
        assert (bytes(r.kept) if r.kept is not None else b) == kept


def test_lines(docs):
    blanks = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(blanks))
    holders = {}
    for i, t in TEXT.items():
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(i)
    for r in lines.dedup_lines(docs).collect():
        own = TEXT[r.doc_id].split("\n")
        kept = [x for x in own if not (len(holders.get(key(x), ())) >= 5 and max(holders[key(x)]) != r.doc_id)]
        assert (r.n_lines, r.n_dropped, r.text or "") == (len(own), len(own) - len(kept), "\n".join(kept))


def test_line_runs_compact(spark):
    state = lines.LineRuns(spark, fanout=2)
    fresh = []
    for b in range(5):
        batch = spark.createDataFrame([(10 * b + i, i * (b + 1) % 7, 0) for i in range(6)], "doc_id long, h1 long, h2 int")
        fresh.append({r.h1 for r in state.add(batch).collect()})
    assert sum(map(len, fresh)) == len(set().union(*fresh)) == state.merged().count()
    assert len(state.runs()) <= 3
    assert state.merged().agg(F.sum("n_docs")).first()[0] == 30


def test_leaks(spark, docs):
    item = TEXT[4][10:130]
    edited = item[:50] + "zz" + item[52:]
    rows = [(1, "start " + item.upper() + " end"), (2, "other " + edited + " tail"), (3, TEXT[9]), (4, None), (5, "")]
    found = decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, None), (9, ""), (7, item)], "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r for r in found.collect()}
    assert set(got) == {(1, 7), (2, 7)}
    assert got[1, 7].distance == 0 and got[1, 7].start == 6 and 1 <= got[2, 7].distance <= 2
    clean = decontamination.without_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted(r.doc_id for r in clean.collect()) == [3, 4, 5]


def test_myers():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (8, 14))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        best = min(row[1:])
        got = decontamination.myers(a.encode(), b.encode(), len(a))
        assert got == (best, row.index(best, 1))


def test_fingerprints(spark, docs):
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    assert got[5] == got[30] == got[31] and got[33] == got[34] == got[35] == "" and got[36] == got[37] != ""
    long = [" ".join(f"w{i}" for i in range(s, s + 400)) for s in (0, 100, 5000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(long)], "doc_id long, text string")
    fp = fingerprints.with_fingerprint(df, F.col("text"), "f").select("doc_id", "f")
    pairs = fp.alias("a").join(fp.alias("b"), F.col("a.doc_id") < F.col("b.doc_id")).select("a.doc_id", F.col("b.doc_id").alias("o"), fingerprints.likeness(F.col("a.f"), F.col("b.f")).alias("x"))
    near_to = {(r.doc_id, r.o): r.x for r in pairs.collect()}
    assert abs(near_to[0, 1] - 0.6) < 0.15 and near_to[0, 2] < 0.15


def test_next_rows(docs):
    rows = fingerprints.with_fingerprint(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), F.col("text"), "packed")
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(rows, [4, 5, 20]).collect()}
    assert got == {i: TEXT[(i + 1) % len(TEXT)] for i in TEXT}


def test_languages(docs):
    model = languages.train_languages(docs.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in languages.identify(docs, model).collect()}
    assert len(got) == len(ROWS) and all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (33, 34, 35))
    judged = [r for r in ROWS if r[2] and r[1] and len(r[1]) > 50]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in judged]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_probabilities_sum_to_one():
    text = "lomi kaka suten lo mimi".encode()
    sym, offs = languages.symbols(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 4)
    k, c = np.unique(languages.packed(sym, 4)[3:], return_counts=True)
    model = languages.kneser_ney({"x": (k, c)}, 4)
    alphabet = np.unique(sym)
    tests = np.concatenate([np.append(np.array([0, 0, 0] + [ord("l"), ord("o")], np.uint32), a) for a in alphabet])
    total = 0.0
    for a in alphabet:
        s = np.array([0, 0, 0, ord("l"), ord("o"), a], np.uint32)
        m = model.log_probabilities(s, np.array([0, 6]))[0, 0] * 3
        short = model.log_probabilities(s[:5], np.array([0, 5]))[0, 0] * 2
        total += np.exp(m - short)
    assert 0.8 < total < 1.01 and len(tests)


def test_scores(docs):
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    train = [i for i in TEXT if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for i in train for w in words(TEXT[i]))
    c[None] = len(train)
    n, v = sum(c.values()), len(c)
    for params in (suffix_tree.TreeParams(), suffix_tree.TreeParams(hot=10, symbols=5)):
        for r in suffix_tree.score_documents(docs, learn, params=params).collect():
            own = [*words(TEXT[r.doc_id]), None]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c[w] > 0 for w in own), n)
            assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
            assert np.isfinite(r.score) and r.score < 0


def test_shards(docs):
    rows = sharding.shard(docs, 4, range_rows=7).collect()
    assert len(rows) == len(ROWS)
    for s in range(4):
        own = sorted((r.slot, r.doc_id) for r in rows if r.shard == s)
        assert [x for x, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)
    assert all(r.grown_shard in (r.shard, 4) and r["size"] == len(TEXT[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(TEXT[r.doc_id].encode()) for r in rows)
    keys = np.arange(20_000)
    for k in range(1, 12):
        a, b = sharding.jump(keys, k), sharding.jump(keys, k + 1)
        assert set(b[a != b]) <= {k} and abs((a != b).mean() - 1 / (k + 1)) < 0.02


def test_passages(docs):
    got = passages.repeated_passages(docs).collect()
    seen = {}
    for i, t in TEXT.items():
        w = words(t)
        for k in range(len(w) - 50):
            seen.setdefault(tuple(w[k : k + 51]), set()).add(i)
    need = {i for ids in seen.values() if len(ids) > 1 for i in ids}
    assert need <= {r.doc_id for r in got}
    passage = [r for r in got if r.kind == "passage" and r.doc_id in (3, 8, 13)]
    assert {r.first_doc_id for r in passage if r.doc_id != 3} == {3} and [r.kept for r in passage if r.doc_id == 3] == [True]
    for r in passage:
        assert len(words(TEXT[r.doc_id].encode()[r.start : r.end].decode())) == r.n_words >= 32


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    frames = [
        near.near_groups(empty),
        packing.pack(empty),
        suffixes.without_repeats(empty),
        lines.dedup_lines(empty),
        decontamination.leaks(empty, bench),
        decontamination.without_leaks(empty, bench),
        fingerprints.fingerprints(empty),
        languages.identify(empty, languages.train_languages(empty)),
        suffix_tree.score_documents(empty, F.lit(True)),
        sharding.shard(empty),
        passages.repeated_passages(empty),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def suffix_scores(texts, learned, depth=3, gain=10.0):
    """The suffix tree's scores of all texts with every passing context, by plain counting."""
    own = {i: [*words(t), None] for i, t in texts.items()}
    before = lambda w, at, d: tuple(w[at - b] if at >= b else None for b in range(1, d + 1))
    dist = [{} for _ in range(depth + 1)]
    for i in learned:
        for at, x in enumerate(own[i]):
            for d in range(depth + 1):
                dist[d].setdefault(before(own[i], at, d), Counter())[x] += 1
    c = dist[0][()]
    once = Counter(n for w, n in c.items() if w is not None)
    discount = min(0.95, max(0.05, once[1] / max(1, once[1] + 2 * once[2])))
    n, v = sum(c.values()), len(c)
    kept = {}
    for d in range(1, depth + 1):
        for ctx, own_n in dist[d].items():
            up, total = dist[d - 1][ctx[:-1]], sum(own_n.values())
            m = sum(up.values())
            if sum(k * (np.log(k / total) - np.log(up[x] / m)) for x, k in own_n.items()) >= gain:
                kept[ctx] = (own_n, total)

    def probability(ctx, x):
        if not ctx:
            return (max(c[x] - discount, 0.5) if x is None else c[x] - discount) / n if c[x] else max(discount * v, 0.5) / n
        below = probability(ctx[:-1], x)
        if ctx not in kept:
            return below
        own_n, total = kept[ctx]
        return (own_n[x] + len(own_n) * below) / (total + len(own_n))

    return {i: sum(np.log10(probability(before(w, at, depth), x)) for at, x in enumerate(w)) for i, w in own.items()}, kept


def many_contexts():
    """Texts of words that are always followed by one other word, or by one of two after a third word."""
    rng = random.Random(11)
    return {i: " ".join(f"{rng.choice('xyz')} a{k} b{k} c{k}{rng.choice('pq')}" for k in (rng.randint(0, 2500) for _ in range(150))) for i in range(100)}


@pytest.mark.parametrize("broadcast", [40, 500_000])
def test_scores_keep_every_passing_context(spark, broadcast):
    texts = many_contexts()
    learned = [i for i in texts if i % 5]
    want, kept = suffix_scores(texts, learned)
    assert sum(len(ctx) == 1 for ctx in kept) > 4000 and any(len(ctx) == 2 for ctx in kept)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = suffix_tree.score_documents(df, F.col("doc_id") % 5 != 0, params=suffix_tree.TreeParams(symbols=broadcast, hot=broadcast)).collect()
    assert {r.doc_id: r.score for r in got} == pytest.approx(want)


def test_scores_of_words_beyond_the_frequent(spark):
    filler = [f"w{k} w{k} w{k}" for k in range(4200)]
    texts = [" ".join(filler[i::20]) for i in range(20)] + ["w1 zig zag w2", "w5 zig zag w9"]
    df = spark.createDataFrame([*enumerate(texts), (100, "zig zag"), (101, "zag zig")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in suffix_tree.score_documents(df, F.col("doc_id") < 100).collect()}
    want, kept = suffix_scores({**dict(enumerate(texts)), 100: "zig zag", 101: "zag zig"}, range(len(texts)))
    assert (b"zig",) in kept and got[100] - got[101] > 2
    assert got == pytest.approx(want)


def test_scores_of_contexts_that_several_tasks_share(spark, monkeypatch):
    deals = []
    monkeypatch.setattr(suffix_tree, "_dealt", lambda docs, number, deal, *more, own=suffix_tree._dealt: deals.append(deal) or own(docs, number, deal, *more))
    texts = many_contexts()
    texts |= {200 + i: f"head{i} " + "to be or not to be that is " * 40 + f"xyz a{i}" for i in range(30)}
    texts |= {300: texts[3], 301: texts[3], 302: texts[5], 303: "", 304: "", 305: "new1 to be or not new2"}
    learned = [i for i in texts if i % 5]
    want, _ = suffix_scores(texts, learned)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = suffix_tree.score_documents(df, F.col("doc_id") % 5 != 0, params=suffix_tree.TreeParams(hot=300, symbols=100, task=3000, slices=3)).collect()
    assert len(got) == len(texts) and {r.doc_id: r.score for r in got} == pytest.approx(want)
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(words(t)) + 1 for i, t in texts.items()}
    assert deals[0].slices == 3 and deals[0].tasks > 5 and all(len(keys) for keys, _ in deals[0].often)


def test_scoring_leaves_neither_tree_nor_shuffled_tokens_on_the_disk(spark):
    texts = many_contexts()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).localCheckpoint()
    shared_folder = pathlib.Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))

    def held():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        files = [pathlib.Path(blocks.apply(i).getPath()) for i in range(blocks.length())]
        return sum(f.stat().st_size for f in [*(f for f in files if f.name.startswith("shuffle_")), *shared_folder.rglob("*.parquet")] if f.exists())

    before = held()
    suffix_tree.score_documents(df, F.col("doc_id") % 5 != 0)
    more = [held() - before]
    for _ in range(50):  # files are deleted beside what runs
        if more[-1] > 0.5 * sum(map(len, texts.values())):
            time.sleep(0.2)
            more.append(held() - before)
    assert more[-1] <= 0.5 * sum(map(len, texts.values()))


def test_short_and_wrapped_paragraphs(spark):
    rng = random.Random(3)
    line = lambda n: " ".join("".join(rng.choice(SYLLABLES["aa"]) for _ in range(3)) for _ in range(n))
    short, long = line(12), line(40).split()
    edited = [*long[:-1], "other"]
    wrapped = "\n".join(" ".join(edited[i : i + 4]) for i in range(0, 40, 4))
    texts = {1: f"{line(9)}\n{short}\n{line(8)}", 2: f"{line(7)}\n{short.upper()}", 3: f"{line(9)}\n\n{' '.join(long)}\n", 4: f"{line(11)}\n\n{wrapped}\n\n{line(6)}"}
    got = passages.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    found = {(r.doc_id, texts[r.doc_id][r.start : r.end].strip(), r.first_doc_id, r.kept) for r in got if r.kind == "paragraph"}
    assert {(1, short, 1, True), (2, short.upper(), 1, False), (3, " ".join(long), 3, True), (4, wrapped, 3, False)} <= found
    # what overlaps the kept occurrence is not marked for removal
    both = {7: f"tiny head\n{line(40)}", 8: ""}
    both[8] = both[7].split("\n")[1]
    got = passages.repeated_passages(spark.createDataFrame(list(both.items()), "doc_id long, text string")).collect()
    assert {r.kept for r in got if r.doc_id == 7 and r.kind == "paragraph"} == {True} and {r.kept for r in got if r.doc_id == 8} == {False}


def test_short_and_unnamed_leaks(spark):
    texts = {1: "so: WHAT is\n17 * 23? Well", 2: "what is 17 * 234", 3: "the concatenation", 4: "a cat, sat", 5: "scat cat", 6: None, 7: "What is 17 * 2", 8: "an item without any id stands here"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "What is 17 * 23"), (2, " cat "), (3, " \n"), (None, "item without any id stands here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start, r.end, r.distance) for r in decontamination.leaks(rows, bench).collect()}
    assert got == {(1, 1, 4, 19, 0), (4, 2, 2, 5, 0), (5, 2, 5, 8, 0)}
    assert sorted(r.doc_id for r in decontamination.without_leaks(rows, bench).collect()) == [2, 3, 6, 7]


def test_shared_keys(spark):
    rng = random.Random(8)
    rows = [(7, i, i) for i in range(3000)] + [(rng.randint(100, 2000), rng.randint(0, 40), i) for i in range(3000)] + [(5, 1, i) for i in range(50)] + [(None, 1, 0), (7, None, 0)]
    df = spark.createDataFrame(rows, "k long, o long, more long").repartition(6)
    others = {}
    for k, o, _ in rows:
        others.setdefault(k, set()).add(o)
    want = sorted(r for r in rows if None not in r and len(others[r[0]]) > 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        assert sorted(tuple(r) for r in shared(df, "k", "o").collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    many = df.where("k IS NOT NULL AND o IS NOT NULL").groupBy("o").agg(F.collect_list("k").alias("k"))
    assert {(r.k, r.o) for r in shared(many, "k", "o").collect()} == {r[:2] for r in want}


def test_large_near_groups(spark):
    """A hub with edited copies, copies too far from it that are close to each other, and chains."""
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(60)]
    texts = {}
    for i in range(250):
        own = list(base)
        for at in rng.sample(range(60), rng.randint(0, 9)):
            own[at] = f"e{rng.randint(0, 30)}"
        texts[1000 - i] = " ".join(own)
    for i in range(40):
        texts[2000 + i] = " ".join(base[i // 4 :] + [f"c{j}" for j in range(i // 4)])
    texts |= {3000 + i: texts[1000 - i] for i in range(30)}
    sets = {i: shingle_set(t, 2) for i, t in texts.items()}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                lo, hi = sorted((group[a], group[b]))
                group = {i: lo if g == hi else g for i, g in group.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    for p in (near.NearParams(k=2), near.NearParams(k=2, sure=None, block=16)):
        got = {r.id: r.component for r in near.near_groups(df, params=p).collect()}
        assert got == group


def test_paragraph_clusters(spark):
    """Whole result for paragraphs against plain Python: clusters, the kept occurrence and nothing else."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(SYLLABLES["bb"]) for _ in range(3))
    pool = [[word() for _ in range(rng.randint(5, 30))] for _ in range(12)]
    pool += [[*x[:-1], word()] for x in pool if len(x) > 15]
    texts = {i: "\n".join(" ".join(rng.choice(pool) if rng.random() < 0.5 else [word() for _ in range(8)]) for _ in range(4)) for i in range(25)}
    spots = []
    for i, t in texts.items():
        at = 0
        for x in t.split("\n"):
            spots.append((i, at, min(at + len(x.encode()) + 1, len(t.encode())), shingle_set(x, 5)))
            at += len(x.encode()) + 1
        spots.append((i, 0, len(t.encode()), shingle_set(t, 5)))
    label = list(range(len(spots)))
    for a in range(len(spots)):
        for b in range(a):
            if 100 * len(spots[a][3] & spots[b][3]) >= 80 * len(spots[a][3] | spots[b][3]) and label[a] != label[b]:
                label = [label[b] if x == label[a] else x for x in label]
    want = set()
    for c in set(label):
        own = [spots[i] for i in range(len(spots)) if label[i] == c]
        if len({x[0] for x in own}) > 1:
            first = min((x[0], x[1], -x[2]) for x in own)
            want |= {(x[0], x[1], x[2], first[0], x[0] == first[0] and x[1] < -first[2] and x[2] > first[1]) for x in own}
    got = passages.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).where("kind = 'paragraph'")
    assert {(r.doc_id, r.start, r.end, r.first_doc_id, r.kept) for r in got.collect()} == want


def test_repeated_and_missing_ids(spark):
    long = "lomi katen sur pelmi " * 300
    rows = [(1, long), (1, long), (1, "one two three four five six"), (None, long), (None, None), (2, "One two three four five six"), (3, "<|endoftext|>"), (None, "seven eight nine ten eleven")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near_rows = near.near_groups(df).collect()
    assert len(near_rows) == 8 and {r.component for r in near_rows if r.id in (1, 2)} == {1}
    assert packing.pack(df).groupBy("doc_id").agg(F.sum("length").alias("n")).count() == 4
    repeats = suffixes.without_repeats(df).collect()
    assert sorted(r.n_removed for r in repeats) == [0] * 5 + [len(long)] * 3
    assert lines.dedup_lines(df, min_docs=2, min_chars=5).where("doc_id IS NULL").agg(F.sum("n_dropped")).first()[0] == 0
    assert fingerprints.fingerprints(df).count() == languages.identify(df, None).count() == 8
    assert suffix_tree.score_documents(df, F.col("doc_id") == 1).count() == 8
    shards = sharding.shard(df, 4).collect()
    assert len(shards) == 8 and all(r.shard is not None for r in shards)
    assert {r.doc_id for r in passages.repeated_passages(df).collect()} == {1, 2}


def test_signatures_and_windows_of_many_units_at_once():
    rng = np.random.default_rng(5)
    p = near.NearParams(k=5, values=6)
    h = rng.integers(0, 2**63, 1_000_000, dtype=np.uint64)
    offs = np.concatenate([[0], np.sort(rng.choice(np.arange(1, 900_000), 200, replace=False)), [len(h)]])
    tracemalloc.start()
    got = near.signatures(h, offs, p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    mult, add = near._constants(p, 3)
    for i in (0, 1, 77, 200):
        own = h[offs[i] : offs[i + 1], None] * mult + add
        assert (got[i, ::2] == own.min(0)).all() and (got[i, 1::2] == own.max(0)).all()
    # the longest unit at a time, not all of them once for each permutation
    assert peak < 1_000_000 + int(np.diff(offs).max()) * 8
    before = h[:100].copy()
    arrays.mix(h[:100])
    assert (h[:100] == before).all()
    woffs = np.array([0, 7, 12, 40, 90])
    short, soffs = arrays.shingles(h[:90], np.array([0, 3, *woffs[1:]]), 5)
    whole, own = arrays.shingles(h[:90], woffs, 5)
    assert (whole[own[1] :] == short[soffs[2] :]).all()
    wp = passages.PassageParams()
    words_at = np.array([0, 300, 310, 700, 1000])
    key = [tuple(h[i : i + 5]) for i in range(996)]
    hashed = {}
    for i, x in enumerate(key):
        acc = np.zeros(1, np.uint64)
        for w in x:
            acc = arrays.mix(acc * arrays.U64(0x9E3779B97F4A7C15) + w)
        hashed[i] = int(acc[0]) >> 10
    want = set()
    for lo, hi in zip(words_at[:-1].tolist(), words_at[1:].tolist(), strict=True):
        for s in range(lo, hi - 4 - wp.stride + 1):
            at = min(range(s, s + wp.stride), key=lambda i: (hashed[i], -i))
            want |= {at} if at + wp.words <= hi else set()
    assert passages.windows(h[:1000], words_at, wp).tolist() == sorted(want)
