"""Language identification by unigram pieces, summed over all segmentations.

Every language has a probability for each piece of one fixed public
vocabulary.  A word's probability is the sum over all ways to cut it into
pieces, by a forward pass over its letters; a text's is the product over its
words, times the language's share of the training rows."""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from epiframe.llm.common import WordCache, slices
from epiframe.llm.merges import NONE, PairTable

LETTERS = regex.compile(r"\p{L}+")
SPACE = "▁"
#: Letters scored together; longer runs are scored in windows of so many.
RUN = 32
#: Probability of a letter that is no piece, in every language.
ODD_LETTER = 1e-7
#: Least probability of a piece.
FLOOR = 1e-8
UNDETERMINED = "und"
_BASE = np.uint64(1_000_003)


def vocabulary(path: str) -> list[str]:
    """Lower-case letter pieces of a sentencepiece model file, some with the word mark in front."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return [p.piece for p in model.pieces
            if p.type == model.SentencePiece.NORMAL and p.piece == p.piece.lower()
            and (p.piece == SPACE or p.piece.removeprefix(SPACE).isalpha())]


def runs(word: str) -> list[str]:
    """Runs of letters, marked in front and cut into windows."""
    out = []
    for run in LETTERS.findall(word):
        out.append(SPACE + run[:RUN])
        out += [run[i:i + RUN] for i in range(RUN, len(run), RUN)]
    return out


class Lattice:
    """Finds the pieces at every place of many words at once."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        self.table = PairTable(*self._halves(keys), np.arange(len(pieces)), np.arange(len(pieces)))

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c)) & (2**64 - 1)
        return h

    @staticmethod
    def _halves(keys):
        return ((keys >> np.uint64(32)) & np.uint64(0x3FFFFFFF)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def find(self, words: list[str]) -> list[np.ndarray]:
        """For each piece length n from 1: the piece at [word, start], len(pieces) + 1 for none.
        A single letter that is no piece gets len(pieces)."""
        width = max(map(len, words))
        flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
        points = flat.reshape(len(words), width).astype(np.uint64)
        odd, none = len(self.pieces), len(self.pieces) + 1
        out, h = [], np.zeros((len(words), width), np.uint64)
        for n in range(1, min(self.longest, width) + 1):
            h = h[:, :width - n + 1] * _BASE + points[:, n - 1:]
            rank, _ = self.table(*(x.ravel() for x in self._halves(h)))
            found = np.where(rank == NONE, none, rank).reshape(h.shape)
            out.append(np.where((found == none) & (points > 0), odd, found) if n == 1 else found)
        return out


def _chunks(words: list[str], size: int = 8192):
    """Indices of words of similar length, a bounded number at a time."""
    order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
    for a in range(0, len(order), size):
        yield order[a:a + size]


def forward(found: list[np.ndarray], prob: np.ndarray) -> np.ndarray:
    """alpha[word, end, language]: summed probability of all segmentations of the first ``end`` letters.
    ``prob`` has a row per piece, one for odd letters and one of zeros."""
    words, width = found[0].shape
    alpha = np.zeros((words, width + 1, prob.shape[1]))
    alpha[:, 0] = 1.0
    for end in range(1, width + 1):
        acc = alpha[:, end]
        for n in range(1, min(end, len(found)) + 1):
            acc += alpha[:, end - n] * prob[found[n - 1][:, end - n]]
    return alpha


def _expected(found, lens, weight, prob) -> np.ndarray:
    """Expected piece counts of weighted words under ``prob`` (one language)."""
    alpha = forward(found, prob[:, None])[:, :, 0]
    words, width = found[0].shape
    beta = np.zeros((words, width + 1))
    beta[np.arange(words), lens] = 1.0
    counts = np.zeros(len(prob))
    total = alpha[np.arange(words), lens]
    scale = np.where(total > 0, weight / np.maximum(total, 1e-300), 0)
    for start in range(width - 1, -1, -1):
        for n in range(1, min(width - start, len(found)) + 1):
            at = found[n - 1][:, start]
            on = prob[at] * beta[:, start + n]
            beta[:, start] += on
            counts += np.bincount(at, alpha[:, start] * on * scale, minlength=len(prob))
    return counts


@dataclass
class LanguageModel:
    """Piece probabilities per language; its size is pieces x languages, whatever it learned from."""
    languages: list[str]
    pieces: list[str]
    prob: np.ndarray  # (pieces + 2, languages)
    prior: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def fit(words: dict[str, Counter], rows: dict[str, int], pieces: list[str], rounds: int = 3) -> LanguageModel:
    """EM over all segmentations of the counted training words of each language."""
    lattice, langs = Lattice(pieces), sorted(words)
    n = len(pieces)
    expected = np.zeros((n + 2, len(langs)))
    for k, lang in enumerate(langs):
        texts = sorted(words[lang])
        weight = np.array([words[lang][w] for w in texts], float)
        parts = [(lattice.find([texts[i] for i in c]), np.array([len(texts[i]) for i in c]), weight[c])
                 for c in _chunks(texts)]
        prob = np.full(n + 2, 1.0 / n)
        prob[n:] = ODD_LETTER, 0.0
        for _ in range(rounds):
            counts = sum((_expected(f, ln, w, prob) for f, ln, w in parts), np.zeros(n + 2))
            prob[:n] = np.maximum(counts[:n] / max(counts[:n].sum(), 1e-9), FLOOR)
        expected[:, k] = counts
    seen = expected[:n]
    pooled = (seen.sum(1) + 0.5) / (seen.sum() + 0.5 * n)
    smooth = 500.0
    prob = np.zeros((n + 2, len(langs)))
    prob[:n] = np.maximum((seen + smooth * pooled[:, None]) / (seen.sum(0) + smooth), FLOOR)
    prob[n] = ODD_LETTER
    share = np.array([rows[x] for x in langs], float) + 1.0
    return LanguageModel(langs, pieces, prob, share / share.sum())


def train(docs: DataFrame, vocab_path: str, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
          max_docs: int = 300, max_words: int = 30_000, rounds: int = 3) -> LanguageModel | None:
    """A model from rows with a text and a language; None where there is no such row.

    Shares of the languages count all rows.  Piece probabilities are fitted on
    a bounded sample: at most ``max_docs`` rows of each language (the smallest
    hashes of the id), of whose whole texts the ``max_words`` most frequent
    runs of letters."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"))
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return None
    first = rows.select("lang", "h").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    bound = first.where(F.col("k") <= max_docs).groupBy("lang").agg(F.max("h").alias("bound"))
    # One row per language; a language's bound admits max_docs rows (and ties of the last hash).
    sample = rows.join(F.broadcast(bound), "lang").where("h <= bound").select("lang", "text")

    def count(batches):
        for batch in batches:
            tally: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = Counter(text.lower().split())
                for w, k in words.items():
                    for r in runs(w):
                        tally[lang, r] += k
            yield pa.RecordBatch.from_pydict({"lang": [x for x, _ in tally], "word": [w for _, w in tally],
                                              "n": pa.array(tally.values(), pa.int64())})

    words = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = words.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
    counted: dict[str, Counter] = {x: Counter() for x in shares}
    for r in top.where(F.col("k") <= max_words).collect():
        counted[r["lang"]][r["word"]] = r["n"]
    return fit(counted, shares, vocabulary(vocab_path), rounds)


class Scorer:
    def __init__(self, model: LanguageModel):
        self.model, self.lattice = model, Lattice(model.pieces)
        self.width = len(model.languages) + 1
        self.words = WordCache(self._words, np.float64, max_words=150_000)

    def _words(self, words: list[str]):
        """Per word: the log-probability in each language, then its number of runs of letters."""
        parts = [runs(w) for w in words]
        distinct = list({r for p in parts for r in p})
        log = np.zeros((len(distinct), self.width))
        log[:, -1] = 1.0
        for c in _chunks(distinct):
            some = [distinct[i] for i in c]
            alpha = forward(self.lattice.find(some), self.model.prob)
            log[c, :-1] = np.log(alpha[np.arange(len(some)), [len(w) for w in some]])
        number = {r: i for i, r in enumerate(distinct)}
        index = np.array([number[r] for p in parts for r in p], np.int64)
        word = np.repeat(np.arange(len(words)), [len(p) for p in parts])
        out = np.zeros((len(words), self.width))
        np.add.at(out, word, log[index])
        return out.ravel(), np.full(len(words), self.width)

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for a, b in slices(texts):
            flat, counts = self.words.lookup([t.lower().split() for t in texts[a:b]])
            rows = flat.reshape(-1, self.width)
            n = counts // self.width
            filled = np.flatnonzero(n)
            sums = np.zeros((b - a, self.width))
            if len(filled):
                sums[filled] = np.add.reduceat(rows, (np.cumsum(n) - n)[filled], axis=0)
            has = sums[:, -1] > 0.5
            log = sums[:, :-1] + np.log(self.model.prior)
            log -= log.max(axis=1, keepdims=True)
            post = np.exp(log) / np.exp(log).sum(axis=1, keepdims=True)
            best = post.argmax(axis=1)
            langs += [self.model.languages[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), has.tolist())]
            scores += [float(p) if ok else 0.0 for p, ok in zip(post.max(axis=1), has.tolist())]
        return langs, scores


_SCORERS: dict[str, Scorer] = {}


def _scorer(model: LanguageModel) -> Scorer:
    if model.key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.key] = Scorer(model)
    return _SCORERS[model.key]


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text",
             lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` plus the most probable language of each whole text and its posterior probability.

    A null text, or one without a letter: ``und`` and 0.  Ties go to the
    language that sorts first.  Without a model every row is ``und``.  Columns
    of the same names as the two new ones are replaced."""
    if model is None:
        return docs.withColumns({lang_out: F.lit(UNDETERMINED), score_out: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        lang, score = _scorer(shared.value).score([t or "" for t in texts])
        return pd.DataFrame({"lang": lang, "score": score})

    out = docs.withColumn("_language", scored(F.col(text_col)))
    return out.withColumns({lang_out: F.col("_language.lang"), score_out: F.col("_language.score")}).drop("_language")
