"""Spelling variants: words one edit apart, found by asymmetric q-chunks and grouped by their frequency.

A word of L code points contributes its two disjoint chunks of L // 2 code points. The longer (or equally
long) word of a pair contributes its positional grams of the chunk lengths that words of its own length
and of one code point less have. One edit leaves one of two disjoint chunks whole and shifts it by one
place at most, so every near pair meets at an equal (length, chunk, gram) within shift one and is then
verified by its edit distance. A chunk that more than `hot` words share would meet too many grams. Its
words are dealt further by what the edit leaves of them, so that only near pairs meet there.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import arrays
from factloom.llm.duck import CRC_TABLE, crc32
from factloom.llm.frames import cut, drop, merge_join, small_batches

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
#: The lead byte of U+00C0 to U+00FF in UTF-8; every continuation byte may follow it.
_LATIN = 0xC3
#: Bytes up to which runs are hashed side by side.
_SHORT = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the maximal runs of A-Z, a-z and U+00C0 to U+00FF."""
    inside = _LETTER[data]
    lead = np.flatnonzero(data == _LATIN)
    inside[lead] = inside[lead + 1] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    full = offs[1:] > offs[:-1]
    first, last = offs[:-1][full], offs[1:][full] - 1
    begins[first], stops[last] = inside[first], inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(offs, starts, "right") - 1


def run_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each byte range, going on from the crc32 in `before`."""
    out = before.astype(np.uint32)
    order = np.argsort(starts - ends, kind="stable")
    length, at = (ends - starts)[order], starts[order]
    state = ~out[order]
    for k in range(min(int(length[0]), _SHORT) if len(length) else 0):
        m = int(np.searchsorted(-length, -k, "left"))
        state[:m] = _CRC[(state[:m] ^ data[at[:m] + k]) & np.uint32(0xFF)] ^ state[:m] >> np.uint32(8)
    out[order] = ~state
    for i in order[: int(np.searchsorted(-length, -_SHORT, "left"))].tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(before[i]))
    return out


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte ranges as an Arrow string column."""
    offs = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offs[1:])
    at = np.arange(offs[-1]) + np.repeat(starts - offs[:-1], ends - starts)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offs), pa.py_buffer(data[at]))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, slip: int | None = None) -> DataFrame:
    """(word, n): the runs of `[A-Za-z\\u00C0-\\u00FF]+` of all texts, A-Z lower-cased, and how often they occur.

    Runs of fewer than `least_chars` code points are left out. With `slip`, a run whose crc32 of
    `<id>:<run>` is divisible by it first loses the code point at crc32 modulo its length. A null text has
    no words, a null id hashes as an empty string. Repeated rows count each time. A run is held whole, so
    memory follows the longest text. Rows are counted before the shuffle, so a frequent word costs one row
    a task.
    """
    small_batches(docs.sparkSession)

    def count(batches):
        for batch, data, offs in arrays.blocks(batches, "text", 8_000_000):
            data = arrays.LOWER[data]
            starts, ends, doc = runs(data, offs)
            latin = np.zeros(len(data) + 1, np.int64)
            np.cumsum(data == _LATIN, out=latin[1:])
            chars = ends - starts - (latin[ends] - latin[starts])
            slipped = np.zeros(len(starts), bool)
            if slip:
                ids = batch.column(0).to_pylist()
                before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
                crc = run_crcs(data, starts, ends, before[doc])
                slipped = crc % np.uint32(slip) == 0
            found = [_slices(data, starts[keep], ends[keep]) for keep in [~slipped & (chars >= least_chars)]]
            changed = []
            for i in np.flatnonzero(slipped & (chars > least_chars)).tolist():
                run, at = data[starts[i] : ends[i]].tobytes().decode(), int(crc[i]) % int(chars[i])
                changed.append(run[:at] + run[at + 1 :])
            found.append(pa.array(changed, pa.large_string()))
            for column in found:
                counts = pc.value_counts(column)
                yield pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts").cast(pa.int64())], ["word", "n"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _gram(length: Column, chunk: int, gram: Column) -> Column:
    """Number of a chunk's place among the words of a length; equal numbers of unequal grams are told apart later."""
    return F.xxhash64(length, F.lit(chunk), gram)


def _chunks(words: DataFrame) -> DataFrame:
    """(key, word, n): the two disjoint chunks of each word."""
    size = F.char_length("word")
    q = F.floor(size / 2).cast("int")
    keys = [_gram(size, c, F.substring(F.col("word"), F.lit(1) + q * c, q)) for c in (0, 1)]
    return words.select(F.explode(F.array(*keys)).alias("key"), "word", "n")


def _grams(words: DataFrame) -> DataFrame:
    """(key, word, n): the positional grams of each word at which a chunk of a word as long can stand, or of
    one that is a code point shorter, in its place or shifted by one."""
    size = F.char_length("word")
    keys = []
    for less in (0, 1):
        q = F.floor((size - less) / 2).cast("int")
        keys += [_gram(size - less, c, F.substring(F.col("word"), F.lit(1 + shift) + q * c, q)) for c in (0, 1) for shift in range(less + 1)]
    return words.select(F.explode(F.array_distinct(F.array(*keys))).alias("key"), "word", "n")


def _left_over(word: Column, at: Column) -> Column:
    """The word without the code point at a place, counted from 1."""
    return F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.char_length(word)))


def _dealt(rows: DataFrame, longer: bool) -> DataFrame:
    """(deal, word, n): what one edit can leave of the words of hot chunks. An equal word but for one place
    leaves the same rest and place, one that is a code point shorter is a rest itself."""
    word, size = F.col("word"), F.char_length("word")
    places = F.transform(F.sequence(F.lit(1), size), lambda i: F.xxhash64(size, i, _left_over(word, i)))
    if longer:
        rest = F.transform(F.sequence(F.lit(1), size), lambda i: F.xxhash64(size - 1, F.lit(0), _left_over(word, i)))
    else:
        rest = F.array(F.xxhash64(size, F.lit(0), word))
    keys = F.concat(places, rest)
    return rows.select(F.explode(F.array_distinct(keys)).alias("deal"), "word", "n")


def near_words(words: DataFrame, hot: int = 48) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words that differ by exactly one inserted, deleted or replaced code
    point, once. `words` is (word, n) with distinct words; null words are near nothing, and so are words of
    one code point, which have no chunk."""
    words = words.where(F.char_length("word") > 1)
    chunks, grams = _chunks(words), _grams(words)
    many = cut(chunks.groupBy("key").agg(F.count("*").alias("sharing")).where(F.col("sharing") > hot).select("key"))
    few = [merge_join(rows, many, "key", "left_anti") for rows in (chunks, grams)]
    met = [few[0].alias("x").join(few[1].alias("y").hint("merge"), F.expr("x.key = y.key"))]
    dealt = [_dealt(merge_join(rows, many, "key", "left_semi").select("word", "n").distinct(), longer) for rows, longer in ((chunks, False), (grams, True))]
    met.append(dealt[0].alias("x").join(dealt[1].alias("y").hint("merge"), F.expr("x.deal = y.deal")))
    pairs = [m.where("(char_length(x.word) < char_length(y.word) OR x.word < y.word) AND levenshtein(x.word, y.word, 1) = 1").select(F.col("x.word").alias("a"), F.col("x.n").alias("a_n"), F.col("y.word").alias("b"), F.col("y.n").alias("b_n")) for m in met]
    return pairs[0].union(pairs[1]).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where each chain of (word, form) ends; a null form ends it. Chains are doubled, so rounds
    grow with the logarithm of the longest one. Chains must not run in circles."""
    at = cut(forms.select("word", F.coalesce("form", "word").alias("root"), F.col("form").isNotNull().alias("moves")))
    while not at.where("moves").isEmpty():
        ends = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = merge_join(at.where("moves"), ends, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moves"))
        further = cut(at.where("NOT moves").unionByName(after))
        drop(at)
        at = further
    return at.select("word", "root")


def spelling_groups(words: DataFrame, hot: int = 48) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of each word of (word, n).

    The form is the near word of largest n (ties: the smallest in code-point order) if that is at least
    twice the word's own, else null; the root is where the forms lead. `hot` changes no result.
    """
    words = cut(words.select("word", F.col("n").cast("long").alias("n")))
    pairs = cut(near_words(words, hot))
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("word")).alias("other")).union(pairs.select(F.col("b"), F.struct((-F.col("a_n")).alias("n"), F.col("a").alias("word"))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    found = merge_join(words, best, "word", "left")
    is_form = -F.col("best.n") >= 2 * F.col("n")
    found = cut(found.select("word", "n", F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")))
    return merge_join(found, roots(found), "word")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Words of all documents that occur three times or more, their near words and forms."""
    words = word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), slip=97).where("n >= 3")
    return spelling_groups(words).select("word", "form", "root", "n", "n_near", "form_n")


OP13_SQL = rf"""
WITH RECURSIVE {CRC_TABLE}, found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), each AS (
  SELECT doc_id, run, count(*) AS n, hex(encode(doc_id::VARCHAR || ':' || run)) AS h FROM found GROUP BY doc_id, run
), crcs AS (
  SELECT run, n, {crc32('h')} AS crc FROM each, tab
), told AS (
  SELECT CASE WHEN crc % 97 = 0 THEN substr(run, 1, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2) ELSE run END AS word, n FROM crcs
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM told WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), rests AS (
  SELECT word, n, i, substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest FROM places
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM rests a JOIN rests b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN rests b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM words a JOIN rests b ON a.word = b.rest
), best AS (
  SELECT word, count(*) AS n_near, min((-other_n, other)) AS b FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * w.n THEN b[2] END AS form, CASE WHEN -b[1] >= 2 * w.n THEN -b[1] END AS form_n FROM words w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root FROM formed WHERE form IS NULL
  UNION ALL SELECT f.word, w.root FROM formed f JOIN walk w ON f.form = w.word
)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN walk w USING (word)
"""
