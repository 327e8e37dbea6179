"""SentencePiece encoding and decoding with a merge-type (BPE) model.

Merges never cross the place between a visible character and white space behind it, nor a character that
the vocabulary lacks, so texts are cut there into units and each distinct unit of a block is encoded once.

Of each prefix of a unit only the last token is stored. It is the one token that ends there, as an
automaton over all pieces finds it, and that stands beside the last token of what is left before it:
two tokens do so if merging their joined text gives those two again. That makes it unique, and the ids of
the unit are read off backwards, token by token.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import arrays
from factloom.llm.frames import small_batches

MARK = "▁"
#: The mark's bytes, which a text may also hold itself.
_MARK = MARK.encode()
#: Units of up to so many characters are remembered, and so many of them; neither changes a result.
_LONGEST, _MOST = 48, 200_000


class MergeModel:
    """A vocabulary of pieces with merge scores, and what is known of them so far."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model.serialized_model_proto())
        train, norm = proto.trainer_spec, proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if train.model_type != train.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix or norm.precompiled_charsmap or not norm.escape_whitespaces or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or kinds - {1, 2, 3, 6}:
            raise ValueError("only plain BPE models with byte fallback, a leading mark and texts taken as they are")
        self.pieces = [p.piece for p in proto.pieces]
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.surfaces = [b"" if p.type == 3 else train.unk_surface.encode() if p.type == 2 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        self.silent = np.array([p.type == 3 for p in proto.pieces])
        self.plain = np.array([p.type == 1 for p in proto.pieces])
        self.byte_ids = [0] * 256
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[3:5], 16)] = i
            elif p.type == 1:
                self.automaton.add_word(p.piece, (len(p.piece), i))
        self.automaton.make_automaton()
        self.raw = set(self.byte_ids)
        #: ASCII characters that are no piece: nothing merges with them
        self.alone = np.array([b < 128 and b != 0x20 and chr(b) not in self.scores for b in range(256)])
        self.beside: dict[tuple[int, int], bool] = {}
        self.sides: dict[int, tuple[set[str], set[str]]] = {}
        self.units: dict[str, list[int]] = {}

    def _merged(self, text: str) -> tuple[list[str], set[str], set[str]]:
        """The merges of a short text, best score first and leftmost among equals; what stood at its two
        ends meanwhile."""
        parts, scores = list(text), self.scores
        first, last = {parts[0]}, {parts[-1]}
        while len(parts) > 1:
            found = [(-scores[two], i) for i, two in enumerate(map("".join, zip(parts, parts[1:], strict=False))) if two in scores]
            if not found:
                break
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            first.add(parts[0])
            last.add(parts[-1])
        return parts, first, last

    def _ends(self, token: int) -> tuple[set[str], set[str]]:
        found = self.sides.get(token)
        if found is None:
            parts, first, last = self._merged(self.pieces[token])
            found = self.sides[token] = (first, last) if len(parts) == 1 else (set(), set())
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are side by side; a left of -1 is no token, or a character that
        nothing merges with."""
        begins = self._ends(right)[0]
        if left < 0 or not begins:
            return bool(begins)
        stops = self._ends(left)[1]
        if not any(a + b in self.scores for a in stops for b in begins):
            return True
        return self._merged(self.pieces[left] + self.pieces[right])[0] == [self.pieces[left], self.pieces[right]]

    def last_tokens(self, unit: str) -> list[int]:
        """The last token of each prefix, the empty one first; -1 behind a character that is no piece."""
        last, beside = [-1] * (len(unit) + 1), self.beside
        for end, (size, token) in self.automaton.iter(unit):
            if last[end + 1] < 0:
                pair = (last[end + 1 - size], token)
                fits = beside.get(pair)
                if fits is None:
                    if len(beside) > 20 * _MOST:
                        beside.clear()
                    fits = beside[pair] = self.compatible(*pair)
                if fits:
                    last[end + 1] = token
        return last

    def unit_ids(self, unit: str) -> list[int]:
        """Token ids of a unit, read from its end."""
        last, ids, at = self.last_tokens(unit), [], len(unit)
        while at:
            token = last[at]
            if token < 0:
                at -= 1
                ids += [self.byte_ids[b] for b in reversed(unit[at].encode())]
            else:
                ids.append(token)
                at -= len(self.pieces[token])
        ids.reverse()
        return ids

    def ids(self, unit: str) -> list[int]:
        found = self.units.get(unit)
        if found is None:
            found = self.unit_ids(unit)
            if len(unit) <= _LONGEST:
                if len(self.units) >= _MOST:
                    self.units.clear()
                self.units[unit] = found
        return found

    def cuts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Starts of the units of a block, and its end."""
        cut = np.zeros(len(data) + 1, bool)
        space = data == 0x20
        cut[1:-1] = space[1:] & ~space[:-1]
        marks = np.flatnonzero((data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2])) if len(data) > 2 else np.zeros(0, np.int64)
        cut[marks + 3] = False  # white space goes on there
        alone = self.alone[data]
        cut[:-1] |= alone
        cut[1:] |= alone
        cut[offs] = True
        return np.flatnonzero(cut)

    def block_ids(self, data: np.ndarray, offs: np.ndarray) -> pa.Array:
        """Ids of the documents of a block, a list for each."""
        if not len(data):
            return pa.LargeListArray.from_arrays(pa.array(np.zeros(len(offs), np.int64)), pa.array([], pa.int32()))
        at = self.cuts(data, offs)
        found = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        slots = found.indices.to_numpy().astype(np.int64)
        table = [self.ids(u.replace(" ", MARK)) for u in found.dictionary.to_pylist()]
        # a mark goes before every text that has any character
        full = np.flatnonzero(offs[1:] > offs[:-1])
        first = np.searchsorted(at, offs[full])
        opened: dict[int, int] = {}
        for k, slot in zip(first.tolist(), slots[first].tolist(), strict=True):
            if slot not in opened:
                opened[slot] = len(table)
                table.append(self.ids(MARK + data[at[k] : at[k + 1]].tobytes().decode().replace(" ", MARK)))
            slots[k] = opened[slot]
        size = np.array([len(x) for x in table], np.int64)
        begin = np.cumsum(size) - size
        flat = np.fromiter((i for x in table for i in x), np.int32, int(size.sum()))
        n = size[slots]
        to = np.cumsum(n)
        ids = flat[np.arange(to[-1]) + np.repeat(begin[slots] - (to - n), n)]
        ends = np.concatenate([[0], to])[np.searchsorted(at, offs)]
        return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(ids))

    def text(self, ids: list[int]) -> str:
        """The text of one list of ids: the leading mark goes, and each stray byte becomes U+FFFD."""
        out, held_back, bos = [], [], True

        def told() -> None:
            held, at = b"".join(held_back), 0
            held_back.clear()
            while at < len(held):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(held[at : at + size].decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    at += 1

        for i in ids:
            piece = self.surfaces[i]
            if i in self.raw:
                held_back.append(piece)
                bos = False
                continue
            told()
            if bos and self.plain[i] and piece[:1] == b" ":
                piece = piece[1:]
            bos &= bool(self.silent[i])
            out.append(piece.decode())
        told()
        return "".join(out)

    def texts(self, ids: np.ndarray, offs: np.ndarray) -> pa.Array:
        """The texts of many lists of ids. Only lists whose bytes are no text are read one by one."""
        surfaces = pa.array(self.surfaces, pa.large_binary())
        joined = surfaces.take(pa.array(ids)) if len(ids) else pa.array([], pa.large_binary())
        at = np.frombuffer(joined.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data = joined.buffers()[2].to_pybytes() if len(ids) and joined.buffers()[2] is not None else b""
        spaced = np.array([p and s[:1] == b" " for p, s in zip(self.plain, self.surfaces, strict=True)])
        out = []
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            if a == b:
                out.append("")
                continue
            if self.silent[ids[a]]:
                out.append(self.text(ids[a:b].tolist()))
                continue
            try:
                out.append(data[at[a] + bool(spaced[ids[a]]) : at[b]].decode())
            except UnicodeDecodeError:
                out.append(self.text(ids[a:b].tolist()))
        return pa.array(out, pa.string())


@lru_cache(maxsize=2)
def _model(path: str | None) -> MergeModel:
    import public_tokenizers

    return MergeModel(path or public_tokenizers.path("piece_bpe_32k.model"))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """(id, ids) of each row: the token ids of its whole text, without begin and end ids.

    `model_path` names a BPE model that every executor can read (None: the public one of 32,000 pieces). A
    null or empty text has no ids. Ids may be null or repeat, every row is encoded by itself. No shuffle;
    a task holds one block of texts, or one longer text.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        model = _model(model_path)
        for batch, data, offs in arrays.blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), model.block_ids(data, offs).cast(pa.list_(pa.int32()))], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode_documents(rows: DataFrame, ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """The columns of `rows` and `decoded`, the text that its ids stand for. Null ids give an empty text;
    control ids give nothing. An added column replaces another of its name."""
    small_batches(rows.sparkSession)
    held = rows.drop("decoded")
    packed = held.select(F.struct(*(held[c] for c in held.columns)).alias("row"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        model = _model(model_path)
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(1)
                offs = lists.offsets.to_numpy()
                values = lists.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]]
                yield pa.RecordBatch.from_arrays([batch.column(0), model.texts(values, offs - offs[0])], ["row", "decoded"])

    out = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, decoded string")
    return out.select(*(F.col(f"row.`{c}`") for c in held.columns), "decoded")


def op12_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded texts of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = decode_documents(encode_documents(docs))
    return rows.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
