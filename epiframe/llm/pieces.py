"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The vocabulary file is read with the sentencepiece library's own model
message; encoding and decoding are done here, over whole batches."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from epiframe.llm.common import WordCache, text_slices
from epiframe.llm.merges import PairTable, merge_words

SPACE = "▁"
_RUNS = re.compile(r"\n[^ \n]*| +[^ \n]*|[^ \n]+")


def _words(text: str) -> list[str]:
    """The text with its leading space mark, cut where no piece can cross.

    A word "x" stands for the mark and x; words that begin with a space or a
    newline stand for themselves.  No piece has a mark after another
    character, and none holds a newline, so merges never cross these cuts."""
    if not text:
        return []
    text = text.replace(SPACE, " ")  # the mark itself reads as a space
    if "  " not in text and text[0] != " ":
        return text.replace("\n", " \n").split(" ")
    return [w[1:] if w[0] == " " and w[1:2] != " " else w for w in _RUNS.findall(" " + text)]


class PieceModel:
    """A BPE model file: pieces, their ids and the table of mergeable pairs."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind = model.SentencePiece
        if (model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback
                or model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces
                or not model.normalizer_spec.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix):
            raise ValueError("only identity-normalised BPE models with byte fallback and a leading space mark")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal):
            raise ValueError("pieces cross word starts")
        self.size = len(model.pieces)
        self.end_id = next(i for i, p in enumerate(model.pieces) if p.type == kind.CONTROL and p.piece == "</s>")
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.byte_ids = np.array([byte[b] for b in range(256)], np.int32)
        self.is_byte = np.zeros(self.size, bool)
        self.is_byte[self.byte_ids] = True
        self.control = {i for i, p in enumerate(model.pieces) if p.type == kind.CONTROL}
        # What an id adds to the decoded bytes.
        self.surface = [model.trainer_spec.unk_surface.encode("utf-8")] * self.size
        for piece, i in normal.items():
            self.surface[i] = piece.replace(SPACE, " ").encode("utf-8")
        for b, i in byte.items():
            self.surface[i] = bytes([b])
        # Symbols: ids, then the characters that are no piece (they never merge, unless a piece holds them).
        chars = sorted({c for p in normal for c in p} - set(normal))
        symbol = {**normal, **{c: self.size + k for k, c in enumerate(chars)}}
        self.char_symbol = {c: i for c, i in symbol.items() if len(c) == 1}
        scores = sorted({model.pieces[i].score for i in normal.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        pairs = [(symbol[p[:k]], symbol[p[k:]], rank_of[model.pieces[i].score], i)
                 for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        self.pairs = PairTable(*np.array(pairs, np.int64).T)
        self.points = np.full(0x110000, -1, np.int32)  # code point -> symbol
        for c, i in self.char_symbol.items():
            self.points[ord(c)] = i

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, how many per word); see ``_words``."""
        marked = [w if w[:1] in (" ", "\n") else " " + w for w in words]
        lens = np.array([len(w) for w in marked], np.int64)
        points = np.frombuffer("".join(marked).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), "<u4")
        sym = self.points[points]
        # A character without a symbol stays as minus its code point - 1: no pair holds it.
        sym = np.where(sym < 0, -points.astype(np.int64) - 1, sym).astype(np.int32)
        return self._to_ids(*merge_words(self.pairs, sym, lens))

    def _to_ids(self, flat, lens):
        """Characters that are no piece become the ids of their UTF-8 bytes."""
        odd = np.flatnonzero((flat < 0) | (flat >= self.size))
        if not len(odd):
            return flat, lens
        outside = {i: c for c, i in self.char_symbol.items() if i >= self.size}
        fill = [self.byte_ids[list((outside[s] if s >= 0 else chr(-s - 1)).encode("utf-8", "surrogatepass"))]
                for s in flat[odd].tolist()]
        sizes = np.ones(len(flat), np.int64)
        sizes[odd] = [len(f) for f in fill]
        out = np.repeat(flat, sizes)
        begin = (np.cumsum(sizes) - sizes)[odd]
        out[np.repeat(begin - (np.cumsum(sizes[odd]) - sizes[odd]), sizes[odd])
            + np.arange(int(sizes[odd].sum()))] = np.concatenate(fill)
        word = np.repeat(np.arange(len(lens)), lens)
        return out, np.bincount(np.repeat(word, sizes), minlength=len(lens)).astype(np.int64)

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: marks become spaces, a leading space of the
        first piece goes, byte ids in a row are read as UTF-8 (each byte that
        is none as U+FFFD), control ids add nothing but end such a row."""
        while ids and ids[-1] in self.control:
            ids = ids[:-1]
        if not ids:
            return ""
        if not self.control.isdisjoint(ids):
            runs, run = [], []
            for i in ids:
                if i in self.control:
                    runs.append(run)
                    run = []
                else:
                    run.append(i)
            runs = [r for r in [*runs, run] if r]
        else:
            runs = [ids]
        surface = self.surface
        text = "".join(_utf8(b"".join([surface[i] for i in r])) for r in runs)
        return text[1:] if text[:1] == " " and not self.is_byte[runs[0][0]] else text


def _utf8(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return _decode_bytewise(data)


def _decode_bytewise(data: bytes) -> str:
    out, i = [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[i:i + n].decode("utf-8"))
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        i += n
    return "".join(out)


@lru_cache(maxsize=4)
def model(path: str) -> PieceModel:
    return PieceModel(path)


@lru_cache(maxsize=4)
def _cache(path: str) -> WordCache:
    return WordCache(model(path).encode_words, np.int32)


def encode_texts(path: str, texts: list[str], end: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in order, how many per text), the end id last in each if asked for."""
    flat, sizes = _cache(path).lookup([_words(t) for t in texts])
    if end:
        flat = np.insert(flat, np.cumsum(sizes), model(path).end_id)
        sizes = sizes + 1
    return flat, sizes


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
           end: bool = True, with_decoded: bool = False) -> DataFrame:
    """(id, ids: array<int> [, decoded]): the ids of every whole text, null as empty (the end id alone).

    ``with_decoded`` adds what the ids decode to, from the ids, while they are
    at hand.  One row per input row, whatever its id; other columns are left out."""
    def run(batches):
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1)):
                flat, sizes = encode_texts(model_path, texts, end)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
                columns = {"id": batch.column(0).slice(a, b - a), "ids": ids}
                if with_decoded:
                    m = model(model_path)
                    columns["decoded"] = pa.array([m.decode(flat[i:j].tolist()) for i, j in zip(offsets, offsets[1:])],
                                                  pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {pairs.schema['id'].dataType.simpleString()}, ids array<int>" + (", decoded string" if with_decoded else "")
    return pairs.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null ids give the empty text."""
    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        m = model(model_path)
        return pd.Series([m.decode(x.tolist()) if x is not None else "" for x in ids], dtype=object)

    return encoded.withColumn(out_col, text(F.col(ids_col)))
