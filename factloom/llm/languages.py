"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

One table an order holds the hashes of all n-grams that any language has seen, sorted, and beside each
the log probability in every language; a second one holds context hashes and back-off weights. A text is
looked up position by position, all languages at once, and gets the language with the least
cross-entropy per letter. Temperature and rejection limits are calibrated on texts kept out of the counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import arrays
from factloom.llm.frames import small_batches


@dataclass(frozen=True)
class LanguageParams:
    """order: longest n-gram. docs_per_language bounds the labelled sample (in expectation): a language
    with more labelled rows is thinned by a hash of the id. One sampled row in `calibrate` is kept out of
    the counts. slack: how far over the calibration limit, in parts of it, a cross-entropy must be."""

    order: int = 4
    docs_per_language: int = 1500
    calibrate: int = 5
    slack: float = 0.15


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or 0. Beyond the basic plane every letter is one symbol."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    for c in range(0x10000, 0x110000):
        if chr(c).isalpha():
            table[c] = 0xFFFD
    return table


def symbols(data: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Letters of a block as code points, other runs as one 0, and the n+1 offsets of the documents.

    Every document starts with order - 1 zeros, which are contexts but never predicted.
    """
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    letter = _letters()[points]
    starts = np.searchsorted(lead, offs)
    first = np.zeros(len(letter) + 1, bool)
    first[starts[:-1]] = True
    keep = np.ones(len(letter), bool)
    keep[1:] = (letter[1:] != 0) | (letter[:-1] != 0) | first[1:-1]
    kept = np.concatenate([[0], np.cumsum(keep)])[starts]
    n = np.diff(kept) + order - 1
    out_offs = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(out_offs[-1], np.uint32)
    real = np.ones(len(out), bool)
    for i in range(order - 1):
        real[out_offs[:-1] + i] = False
    out[real] = letter[keep]
    return out, out_offs


def packed(sym: np.ndarray, n: int) -> np.ndarray:
    """The last n symbols at every place, 16 bits each; places before n - 1 are padded with zeros."""
    key = np.zeros(len(sym), np.uint64)
    for back in range(n - 1, -1, -1):
        shifted = np.zeros(len(sym), np.uint64)
        shifted[back:] = sym[: len(sym) - back] if back else sym
        key = (key << np.uint64(16)) | shifted
    return key


def _spots(offs: np.ndarray, order: int) -> np.ndarray:
    """Places that are predicted."""
    real = np.ones(offs[-1], bool)
    for i in range(order - 1):
        real[offs[:-1] + i] = False
    return np.flatnonzero(real)


@dataclass
class LanguageModel:
    order: int
    languages: list[str]
    grams: list[np.ndarray]  # by order: sorted hashes
    logp: list[np.ndarray]  # (grams, languages)
    contexts: list[np.ndarray]  # by context length
    backoff: list[np.ndarray]
    temperature: float = 1.0
    limit: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def log_probabilities(self, sym: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(documents, languages): mean natural log probability of a symbol; 0 without one."""
        spots = _spots(offs, self.order)
        total = np.zeros((len(spots), len(self.languages)), np.float32)
        todo = np.arange(len(spots))
        for n in range(self.order, 0, -1):
            key = arrays.mix(packed(sym, n)[spots[todo]])
            at = np.minimum(np.searchsorted(self.grams[n], key), len(self.grams[n]) - 1)
            hit = self.grams[n][at] == key
            total[todo[hit]] += self.logp[n][at[hit]]
            todo = todo[~hit]
            if n == 1:
                total[todo] += self.logp[1].min(0)
            elif len(todo):
                ctx = arrays.mix(packed(sym, n)[spots[todo]] >> np.uint64(16))
                at = np.minimum(np.searchsorted(self.contexts[n], ctx), len(self.contexts[n]) - 1)
                known = self.contexts[n][at] == ctx
                total[todo[known]] += self.backoff[n][at[known]]
        n = np.diff(offs) - (self.order - 1)
        out = np.zeros((len(n), len(self.languages)))
        full = n > 0
        if full.any():
            at = (np.concatenate([[0], np.cumsum(n)])[:-1])[full]
            out[full] = np.add.reduceat(total, at, axis=0, dtype=np.float64) / n[full][:, None]
        return out

    def choose(self, sym: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number or -1, score, rejected) of each document."""
        logp = self.log_probabilities(sym, offs)
        seen = np.concatenate([[0], np.cumsum(sym > 0)])[offs]
        n = np.diff(seen)
        best = logp.argmax(1)
        z = (logp - logp.max(1, keepdims=True)) * (np.minimum(n, 200)[:, None] / self.temperature)
        score = 1 / np.exp(z).sum(1)
        over = -logp.max(1) > self.limit[best] + 3 / np.sqrt(np.maximum(n, 1))
        none = n == 0
        return np.where(none, -1, best), np.where(none, 0.0, score), over | none


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int) -> LanguageModel:
    """Interpolated Kneser-Ney tables from each language's packed n-grams of the highest order."""
    names = sorted(counts)
    mask = [np.uint64((1 << 16 * n) - 1) if n < 4 else np.uint64(2**64 - 1) for n in range(order + 1)]
    per = []  # per language: order -> (packed grams, counts)
    for name in names:
        keys, c = counts[name]
        tables = {order: (keys, c.astype(np.float64))}
        for n in range(order - 1, 0, -1):
            # continuation counts: distinct symbols to the left
            u, left = np.unique(tables[n + 1][0] & mask[n], return_counts=True)
            tables[n] = (u, left.astype(np.float64))
        per.append(tables)
    grams, logp, contexts, backoff, raw = [None] * (order + 1), [None] * (order + 1), [None] * (order + 1), [None] * (order + 1), [None] * (order + 1)
    alphabet = len(np.unique(np.concatenate([t[1][0] for t in per]))) + 1
    for n in range(1, order + 1):
        union = np.unique(np.concatenate([t[n][0] for t in per]))
        ctx = np.unique(union >> np.uint64(16))
        p, gamma = np.zeros((len(union), len(names))), np.ones((len(ctx), len(names)))
        lower = raw[n - 1][np.searchsorted(grams[n - 1], union & mask[n - 1])] if n > 1 else np.full((len(union), len(names)), 1 / alphabet)
        at_ctx = np.searchsorted(ctx, union >> np.uint64(16))
        for i, tables in enumerate(per):
            keys, c = tables[n]
            ones, twos = (c == 1).sum(), (c == 2).sum()
            discount = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            where = np.searchsorted(ctx, keys >> np.uint64(16))
            mass, kinds = np.bincount(where, c, len(ctx)), np.bincount(where, minlength=len(ctx))
            seen = mass > 0
            gamma[seen, i] = discount * kinds[seen] / mass[seen]
            own = np.zeros(len(union))
            own[np.searchsorted(union, keys)] = np.maximum(c - discount, 0) / mass[where]
            p[:, i] = own + gamma[at_ctx, i] * lower[:, i]
        grams[n], raw[n], contexts[n], backoff[n] = union, p, ctx, np.log(gamma)
    for n in range(1, order + 1):
        rank = np.argsort(h := arrays.mix(grams[n]))
        grams[n], logp[n] = h[rank], np.log(raw[n][rank]).astype(np.float32)
        rank = np.argsort(h := arrays.mix(contexts[n]))
        contexts[n], backoff[n] = h[rank], backoff[n][rank].astype(np.float32)
    return LanguageModel(order, names, grams, logp, contexts, backoff, limit=np.full(len(names), np.inf))


def _thinned(train: DataFrame, p: LanguageParams) -> DataFrame:
    """The bounded labelled sample: (doc_id, text, lang, calibrate)."""
    sizes = {r.lang: r["count"] for r in train.select("lang").groupBy("lang").count().toLocalIterator()}
    rate = F.lit(0)
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30))
    for lang, n in sizes.items():
        rate = F.when(F.col("lang") == lang, min(1 << 30, (p.docs_per_language << 30) // n)).otherwise(rate)
    return train.where(h < rate).withColumn("calibrate", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("calibrate")), F.lit(p.calibrate)) == 0)


def train_languages(train: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel | None:
    """Fit on (doc_id, text, lang) rows; null texts and languages are left out. None without any row.

    The driver gets the distinct n-grams of the bounded sample and one row of cross-entropies for each
    calibration text of it.
    """
    p = params
    small_batches(train.sparkSession)
    sample = _thinned(train.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang"), p)

    def count(batches):
        for part, data, offs in arrays.blocks(batches, "text", 1_000_000):
            sym, soffs = symbols(data, offs, p.order)
            if not len(sym):
                continue
            langs = np.array(part.column(part.schema.get_field_index("lang")).to_pylist(), object)
            spots = _spots(soffs, p.order)
            keys, owner = packed(sym, p.order)[spots], np.searchsorted(soffs, spots, "right") - 1
            for lang in sorted(set(langs)):
                k, c = np.unique(keys[langs[owner] == lang], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], ["lang", "gram", "n"])

    grams = sample.where(~F.col("calibrate")).select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    table = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if table.empty:
        return None
    model = kneser_ney({lang: (np.sort(t.gram.to_numpy().view(np.uint64)), t.n.to_numpy()[np.argsort(t.gram.to_numpy().view(np.uint64))]) for lang, t in table.groupby("lang")}, p.order)
    held = sample.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for part, data, offs in arrays.blocks(batches, "text"):
            sym, soffs = symbols(data, offs, p.order)
            logp = held.value.log_probabilities(sym, soffs)
            n = np.diff(np.concatenate([[0], np.cumsum(sym > 0)])[soffs])
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("lang")), pa.array(n.astype(np.int64)), pa.array(list(logp), pa.list_(pa.float64()))], ["lang", "n", "logp"])

    _calibrate(model, sample.where("calibrate").select("text", "lang").mapInArrow(measure, "lang string, n long, logp array<double>").toPandas(), p)
    return model


def _calibrate(model: LanguageModel, rows: pd.DataFrame, p: LanguageParams) -> None:
    """Temperature with the best log likelihood of the labels; limit on the cross-entropy by language."""
    rows = rows[(rows.n > 0) & rows.lang.isin(model.languages)]
    if rows.empty:
        return
    logp, truth = np.stack(rows.logp), np.array([model.languages.index(x) for x in rows.lang])
    n = np.minimum(rows.n.to_numpy(), 200)[:, None]

    def loss(t: float) -> float:
        z = (logp - logp.max(1, keepdims=True)) * n / t
        return float(-(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(1))).mean())

    model.temperature = min((2.0**i for i in range(0, 9)), key=loss)
    own = -logp[np.arange(len(logp)), truth]
    everywhere = np.quantile(own, 0.995)
    model.limit = np.array([(np.quantile(own[truth == i], 0.995) if (truth == i).sum() >= 30 else everywhere) * (1 + p.slack) for i in range(len(model.languages))])


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred, score (0 to 1) and rejected added, replacing columns of those names.

    A null text or one without a letter is `und`, score 0, rejected. A text is rejected too if its
    cross-entropy under the best language is over that language's calibrated limit; it keeps its best
    language. Without a model every row is `und`. Only the text is looked at.
    """
    small_batches(docs.sparkSession)
    names = [*(model.languages if model else []), "und"]
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score", "rejected", "_text").withColumn("_text", F.col(text_col).cast("string"))
    out = kept.drop("_text").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches):
        model = held.value
        for part, data, offs in arrays.blocks(batches, "_text", 1_000_000):
            if model is None:
                lang, score, rejected = np.full(part.num_rows, -1), np.zeros(part.num_rows), np.ones(part.num_rows, bool)
            else:
                lang, score, rejected = model.choose(*symbols(data, offs, model.order))
            columns = [c for c, n in zip(part.columns, part.schema.names, strict=True) if n != "_text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([names[i] for i in lang], pa.string()), pa.array(score), pa.array(rejected)], names=out.names)

    return kept.mapInArrow(run, out)


def held_out(doc_id: Column, folds: int = 3) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 1, F.lit(False))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of the labelled ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", held_out(F.col("doc_id")))
    model = train_languages(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).drop("text")
