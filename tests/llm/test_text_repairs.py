"""Conversation repair, SentencePiece and spelling variants against brute force and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from factloom.llm import conversations, languages, lines, packing, sentencepieces, spellings

SF = "/root/testdata/sf0.001"


def same_rows(frame, sql, table, files):
    """Whether a frame has the rows of its SQL on the files."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{files}'")
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    return key(map(tuple, frame.collect())) == key(con.sql(f"SELECT {', '.join(frame.columns)} FROM ({sql})").fetchall())


# conversations


def all_repairs(codes):
    """Every (cost, audit) of a short conversation, inserting at most two turns in one place."""
    found = []

    def go(i, roles, cost, audit, inserted):
        if i == len(codes) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, audit))
        if inserted < 2:
            for r in "ua":
                go(i, roles + r, cost + 3, audit + "I", inserted + 1)
        if i < len(codes):
            c = codes[i]
            go(i + 1, roles, cost + 4, audit + "D", 0)
            if c != "-":
                extra = 3 if c.isupper() else 0
                go(i + 1, roles + c.lower(), cost + extra, audit + "K", 0)
                for r in "ua":
                    go(i + 1, roles + r, cost + 3 + extra, audit + "R", 0)

    go(0, "", 0, "", 0)
    return min(found)


def test_cheapest_of_all():
    for n in range(4):
        for codes in itertools.product("suaxSUAX-", repeat=n):
            if n < 3 or random.Random("".join(codes)).random() < 0.12:
                assert conversations.cheapest("".join(codes)) == all_repairs("".join(codes)), codes


def forward_only(codes):
    """Least (cost, letters) by reading the turns once."""
    ways = {0: (0, "")}
    for code in [*codes, None]:
        for k in (0, 1, 3, 2):
            if k in ways:
                to, way = conversations.FOLLOW[k][conversations.WRITES[k]], (ways[k][0] + 3, ways[k][1] + "I")
                ways[to] = min(ways.get(to, way), way)
        if code is None:
            return min(ways[k] for k in (0, 3) if k in ways)
        after = {}
        for k, (cost, letters) in ways.items():
            edits = [(k, 4, "D")]
            if code != "-":
                extra = 3 if code.isupper() else 0
                edits.append((conversations.FOLLOW[k][conversations.WRITES[k]], 3 + extra, "R"))
                if code.lower() in conversations.FOLLOW[k]:
                    edits.append((conversations.FOLLOW[k][code.lower()], extra, "K"))
            for to, more, letter in edits:
                way = (cost + more, letters + letter)
                after[to] = min(after.get(to, way), way)
        ways = after


def test_long_conversations():
    rng = random.Random(3)
    for n in (5, 20, 100, 400):
        for _ in range(15):
            codes = "".join(rng.choice("suauauauaxSUA-") for _ in range(n))
            assert conversations.cheapest(codes) == forward_only(codes)
    cost, audit = conversations.cheapest("ua" * 50_000)
    assert cost == 0 and audit == "K" * 100_000


TURNS = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Why?"), (1, 2, "assistant", "So."), (1, 5, "assistant", "And so on"),
    (2, None, "user", None), (2, None, None, "x."), (2, 3, "user", " \t\n"), (2, 3, "user", "a!"), (2, 3, "user", "a!"), (2, 3, "tool", "b?"),
    (None, 1, "user", "Hi."), (None, 2, "user", "Hi again."), (3, None, "", "zz."), (4, 7, "user", "cut off here"), (4, 8, "assistant", "yes ."),
    (5, 1, "user", "word. " * 300_000), (5, 2, "assistant", "Fine.\n"),
]


def test_conversation_query(spark, tmp_path):
    rows = TURNS + [(i, t, random.Random(f"{i}{t}").choice(["user", "assistant", "system"]), random.Random(f"{t}{i}").choice(["Yes.", "No", "", "Well?"])) for i in range(100, 400) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.withColumn("gone", F.lit("clash")).withColumn("step", F.lit(1)).withColumn("held", F.lit("clash")).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    for folder in (tmp_path, SF):
        files = f"{folder}/conversations.parquet" + ("/*.parquet" if folder is tmp_path else "")
        assert same_rows(conversations.op11_conversation_repair(spark, str(folder)), conversations.OP11_SQL, "conversations", files)


def test_repaired_turns(spark):
    rows = spark.createDataFrame(TURNS[:6] + [(9, 1, "user", "gone")], "conv_id long, turn long, role string, text string").withColumn("gone", F.col("conv_id") == 9).fillna({"role": " ", "text": " "})
    plans = conversations.repair_plans(rows)
    audits = {r.conv_id: (r.audit, r.cost, r.gaps, r.truncated) for r in plans.collect()}
    assert audits[1] == ("KKKD", 4, 2, 1) and audits[9] == ("", 0, 0, 0)
    told = [(r.conv_id, r.place, r.edit, r.role, r.text) for r in conversations.repaired_turns(rows, plans).where("conv_id = 1").orderBy("place").collect()]
    assert told == [(1, 0, "K", "system", "Be brief."), (1, 1, "K", "user", "Why?"), (1, 2, "K", "assistant", "So.")]
    assert conversations.repaired_turns(rows, plans).where("conv_id = 9").count() == 0


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert conversations.op11_conversation_repair(spark, str(tmp_path)).count() == 0


# SentencePiece


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def odd_texts():
    rng = random.Random(11)
    parts = [" ", "  ", "   ", " " * 17, " " * 40, "\n", "\t", "▁", "▁▁", "a", "the", "ing", "ing ", "Zoë", "ß", "日本", "語", "😀", "\x00", " ", "​", "<s>", "</s>", "<unk>", "<0x41>", "aaaaaaa", "0123456789", "....", "def f(x):\n    return x\n", "übergröße", "ééé", "\r\n", "é", "\U00012000", "ﬁ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x24F), rng.randint(0x400, 0x4FF), rng.randint(0x4E00, 0x9FFF), rng.randint(0x1F600, 0x1F64F)])) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    return ["", " ", *texts, "ab" * 60_000, "no spaces " * 200_000, "x" * 100_000]


def test_ids_and_texts_as_the_library(spark, library):
    texts = odd_texts()
    rows = [*enumerate(texts), (7, texts[9]), (None, "no id"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("id", F.lit(0)).repartition(3)
    encoded = sentencepieces.encode_documents(docs)
    got = sorted((-1 if r.id is None else r.id, list(r.ids), r.decoded) for r in sentencepieces.decode_documents(encoded.withColumn("decoded", F.lit(1))).collect())
    want = sorted((-1 if i is None else i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in rows)
    assert got == want


def test_all_documents_as_the_library(spark, library):
    got = {r.doc_id: r for r in sentencepieces.op12_sentencepiece(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "")
        row = got[d.doc_id]
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_any_ids_decode_as_the_library(spark, library):
    rng = random.Random(2)
    lists = [[rng.choice([rng.randint(0, 31_999), rng.randint(0, 300)]) for _ in range(rng.randint(0, 12))] for _ in range(800)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(-1, None)], "id long, ids array<int>")
    got = {r.id: r.decoded for r in sentencepieces.decode_documents(rows).collect()}
    assert got.pop(-1) == ""
    assert got == {i: library.decode(x) for i, x in enumerate(lists)}


def test_last_token_of_each_prefix():
    model = sentencepieces._model(None)
    unit = "▁international"
    assert all([model.pieces[t] for t in model.unit_ids(unit[:n])] == model._merged(unit[:n])[0] for n in range(1, len(unit) + 1))
    assert [model.pieces[model.last_tokens(unit)[n]] for n in range(1, len(unit) + 1)] == [model._merged(unit[:n])[0][-1] for n in range(1, len(unit) + 1)]


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sentencepieces.decode_documents(sentencepieces.encode_documents(empty)).count() == 0
    assert spellings.spelling_groups(spellings.word_counts(empty)).count() == 0


# spelling variants


def counted(rows, slip):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += len(run) >= 5
    return +found


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    return any((a[:i] + b[i] + a[i:] if len(a) < len(b) else a[:i] + b[i] + a[i + 1 :]) == b for i in range(len(b)))


@pytest.mark.parametrize("slip", [None, 3])
def test_word_counts(spark, slip):
    texts = ["Größe größe ÀÿÉé×÷ straße", None, "", "x" * 200 + " " + "Y" * 70_000, "lemonade, LEMONADE; lemon4de lĀmon", "éééééé\nééééé é", "Zebra_zebra zebra'zebra", "ab" * 40]
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (4, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(5)).repartition(2)
    assert {r.word: r.n for r in spellings.word_counts(docs, slip=slip).collect()} == counted(rows, slip)


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_spelling_groups(spark, hot):
    rng = random.Random(hot)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 8))) for _ in range(260)} | {"chain", "chaim", "chalm", "cholm", "schain", "aaaaaa", "aaaaaaa", "aaaaa"}
    n = {w: rng.choice([3, 3, 6, 6, 12, 30]) for w in words} | {"chain": 100, "chaim": 50, "chalm": 25, "cholm": 12}
    got = {r.word: r for r in spellings.spelling_groups(spark.createDataFrame(list(n.items()), "word string, n long"), hot).collect()}
    assert set(got) == set(n)
    around = {w: [x for x in words if near(w, x) and min(len(w), len(x)) > 1] for w in words}
    form = {w: min(((-n[x], x) for x in around[w]), default=None) for w in words}
    form = {w: f[1] if f and -f[0] >= 2 * n[w] else None for w, f in form.items()}
    for w, r in got.items():
        root = w
        while form[root]:
            root = form[root]
        assert (r.n, r.n_near, r.form, r.form_n, r.root) == (n[w], len(around[w]), form[w], n[form[w]] if form[w] else None, root)
    assert got["cholm"].root == "chain"


def test_spelling_query(spark):
    assert same_rows(spellings.op13_spelling_variants(spark, SF), spellings.OP13_SQL, "documents", f"{SF}/documents.parquet")


def test_run_crcs():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 9000, dtype=np.uint8)
    starts = np.sort(rng.integers(0, 8000, 300))
    ends, before = starts + rng.integers(1, 130, 300), rng.integers(0, 2**32, 300, dtype=np.uint32)
    assert spellings.run_crcs(data, starts, ends, before).tolist() == [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(starts, ends, before, strict=True)]
    assert isinstance(spellings._slices(data[:0], starts[:0], ends[:0]), pa.Array)


# mended operators


def test_parts_of_equal_hash_keep_their_ids():
    """Two texts of 1,024 characters that a polynomial hash modulo 2**64 cannot tell apart."""
    word = "a"
    for _ in range(10):
        word += word.translate({97: 98, 98: 97})
    texts = [word, word.translate({97: 98, 98: 97}), word]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ids, offs = packing.token_ids(data, np.array([0, 1024, 2048, 3072]))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_letters_beyond_the_basic_plane():
    letters = languages._letters()
    assert not letters[[ord(c) for c in "😀🚀𝟘🀄"]].any()
    assert letters[[ord(c) for c in "𠀀𐎠𐤀"]].all() and all(bool(letters[c]) == chr(c).isalpha() for c in range(0, 0x110000, 7))


def test_lines_beside_any_columns(spark):
    """Columns of whatever name stay as they are."""
    text = "a line of more than forty characters, which repeats"
    docs = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string")
    names = ["held by the operator", "held", "rest", "row", "gone", "kept", "lines", "n_lines"]
    wide = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names))
    got = lines.dedup_lines(wide)
    assert got.columns == ["doc_id", "text", *names[:-1], "n_lines", "n_dropped"]
    assert all(r[n] == f"{n}{r.doc_id}" and r.n_dropped == int(r.doc_id < 5) for r in got.collect() for n in names[:-1])
