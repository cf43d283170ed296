"""Toxicity by weak supervision.

Lexicon and pattern voters vote on every text.  A generative label model
estimates each voter's accuracy and which voters depend on each other, from
the votes alone.  A linear classifier on the voters' counts is then trained on
the label model's posterior labels."""

from __future__ import annotations

import heapq
import math
import re
import uuid
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from epiframe.llm.common import WordCache, cut, slices, text_slices

LETTERS = regex.compile(r"\p{L}+")

# Common English insults.
INSULTS = ("idiot stupid moron loser trash scum pathetic worthless disgusting clown dumb imbecile fool jerk "
           "hate kill ugly filthy vermin garbage bastard bitch damn crap shit fuck asshole").split()

#: Term kinds a lexicon is induced from: whole words, and beginnings of words by length.
KINDS = {"word": None, "start4": 4, "start5": 5, "start6": 6}
#: The words of the induced lexicon are dealt to so many voters by a hash.
WORD_LEXICONS = 3
LEXICONS = [f"words{i}" for i in range(WORD_LEXICONS)] + ["start4", "start5", "start6", "insults"]
#: Pattern voters: shouted words, and words with a letter three times in a row.
PATTERNS = ["shout", "drawn"]
VOTERS = LEXICONS + PATTERNS
_DRAWN = re.compile(r"([^\W\d_])\1\1")


def terms(word: str) -> list[tuple[str, str]]:
    """(kind, term) of one lower-case run of letters."""
    out = [("word", word)]
    for kind, n in KINDS.items():
        if n and len(word) >= n:
            out.append((kind, word[:n]))
    return out


def lexicon_of(kind: str, term: str) -> str:
    return f"words{sum(map(ord, term)) % WORD_LEXICONS}" if kind == "word" else kind


def sketch(text: str, size: int = 4) -> list[int]:
    """The ``size`` least hashes over pairs of neighbouring words: near copies
    mostly share them all, texts that share a passage or a frequent pair do not."""
    words = text.lower().split()
    return heapq.nsmallest(size, set(map(zlib.crc32, map(str.encode, map(" ".join, zip(words, words[1:])))))) or [zlib.crc32(text.encode())]


def induce(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "toxic", max_rows: int = 20_000, max_terms: int = 5_000,
           chance: float = 0.01, least_ratio: float = 3.0) -> dict[str, frozenset[str]]:
    """Lexicons of terms whose document frequency is far higher among toxic rows.

    Learned from a bounded sample: at most ``max_rows`` rows of each label (the
    smallest hashes of the id) of ``labels``, of which near copies (equal
    ``sketch``) count once.  A term enters if its smoothed log ratio of
    frequencies is at least ``least_ratio`` and its log-likelihood ratio so
    high that among all terms tried about ``chance`` would enter by accident;
    at most ``max_terms`` per kind."""
    rated = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    rated = rated.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y")).withColumn("h", F.xxhash64("id"))
    first = [rated.where(F.col("y") == y).orderBy("h", "id").limit(max_rows) for y in (0, 1)]
    sample = cut(first[0].unionByName(first[1]).select("id", "y"), "labels")  # at most 2 x max_rows rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    sketched = F.pandas_udf(lambda t: t.map(sketch), "array<long>")
    single = (texts.join(F.broadcast(sample), "id").select("id", "y", sketched("text").alias("s"))
              .groupBy("y", "s").agg(F.min("id").alias("id")))
    texts = texts.join(F.broadcast(cut(single.select("id", "y"), "sample")), "id").select("y", "text")

    def count(batches):
        """Partial document frequencies; y = 0 or 1, kind '' counts the rows."""
        for batch in batches:
            ys = batch.column(0).to_pylist()
            for a, b, rows in text_slices(batch.column(1)):
                tally: Counter = Counter()
                for y, text in zip(ys[a:b], rows):
                    tally[y, "", ""] += 1
                    for kind, term in {t for w in set(LETTERS.findall(text.lower())) for t in terms(w)}:
                        tally[y, kind, term] += 1
                keys = list(tally)
                yield pa.RecordBatch.from_pydict({
                    "y": pa.array([k[0] for k in keys], pa.int32()), "kind": [k[1] for k in keys],
                    "term": [k[2] for k in keys], "n": pa.array([tally[k] for k in keys], pa.int64())})

    n = texts.mapInArrow(count, "y int, kind string, term string, n long")
    n = n.groupBy("kind", "term").agg(F.sum(F.when(F.col("y") == 1, F.col("n"))).alias("a"),
                                      F.sum(F.when(F.col("y") == 0, F.col("n"))).alias("b")).na.fill(0)
    n = cut(n.where((F.col("kind") == "") | (F.col("a") >= 3)), "terms")
    tried = {r["kind"]: r["n"] for r in n.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    order = Window.partitionBy("kind").orderBy(F.desc(F.col("a") - F.col("b")), "term")
    found = n.withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_terms).collect()
    total = next(((r["a"], r["b"]) for r in found if r["kind"] == ""), (0, 0))
    lexicons: dict[str, set[str]] = {x: set() for x in LEXICONS}
    lexicons["insults"].update(INSULTS)
    for r in found:
        if r["kind"] and _gain(r["a"], total[0], r["b"], total[1]) >= 2 * math.log(tried[r["kind"]] / chance) and (
                math.log((r["a"] + 0.5) / (total[0] + 1)) - math.log((r["b"] + 0.5) / (total[1] + 1)) >= least_ratio):
            lexicons[lexicon_of(r["kind"], r["term"])].add(r["term"])
    return {k: frozenset(v) for k, v in lexicons.items()}


def _gain(a: int, n: int, b: int, m: int) -> float:
    """Log-likelihood ratio of a of n against b of m."""
    def part(k, total, p):
        return (k * math.log(p) if k else 0.0) + ((total - k) * math.log(1 - p) if total - k else 0.0)

    if not n or not m:
        return 0.0
    pooled = (a + b) / (n + m)
    if not 0 < pooled < 1:
        return 0.0
    return 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, pooled) - part(b, m, pooled))


class HitCounter:
    """Counts of every voter's hits in whole texts, and of words."""

    def __init__(self, lexicons: dict[str, frozenset[str]]):
        self.lexicons = lexicons
        self.width = len(VOTERS) + 1
        self.words = WordCache(self._words, np.int32, max_words=200_000)

    def _words(self, words: list[str]):
        out = np.zeros((len(words), self.width), np.int32)
        for i, word in enumerate(words):
            for run in LETTERS.findall(word):
                low = run.lower()
                out[i, -1] += 1
                for kind, term in terms(low):
                    name = lexicon_of(kind, term)
                    if term in self.lexicons[name]:
                        out[i, VOTERS.index(name)] += 1
                if low in self.lexicons["insults"]:
                    out[i, VOTERS.index("insults")] += 1
                if len(run) > 3 and run.isupper():
                    out[i, VOTERS.index("shout")] += 1
                if _DRAWN.search(low):
                    out[i, VOTERS.index("drawn")] += 1
        return out.ravel(), np.full(len(words), self.width)

    def count(self, texts: list[str]) -> np.ndarray:
        flat, n = self.words.lookup([t.split() for t in texts])
        rows, n = flat.reshape(-1, self.width), n // self.width
        out = np.zeros((len(texts), self.width), np.int64)
        filled = np.flatnonzero(n)
        if len(filled):
            out[filled] = np.add.reduceat(rows, (np.cumsum(n) - n)[filled], axis=0)
        return out


_COUNTERS: dict[str, HitCounter] = {}


def _counter(key: str, lexicons) -> HitCounter:
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = HitCounter(lexicons)
    return _COUNTERS[key]


def hits(docs: DataFrame, lexicons: dict[str, frozenset[str]], text_col: str = "text") -> DataFrame:
    """``docs`` plus ``_hits``: array of each voter's hits in the whole text, then its number of words (null text: zeros)."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, lexicons))  # bounded by max_terms

    @F.pandas_udf("array<int>")
    def counted(texts: pd.Series) -> pd.Series:
        counter = _counter(*shared.value)
        rows = [t or "" for t in texts]
        out: list = []
        for a, b in slices(rows):
            out += list(counter.count(rows[a:b]).astype(np.int32))
        return pd.Series(out, dtype=object)

    return docs.withColumn("_hits", counted(F.col(text_col)))


def vote(hit_array):
    """Votes as one string, a character per voter: + from two hits, 0 for one, - for none."""
    n = len(VOTERS)
    return F.concat(*[F.when(hit_array[i] >= 2, "+").when(hit_array[i] == 1, "0").otherwise("-") for i in range(n)])


@dataclass
class LabelModel:
    """P(toxic) and, per clique of dependent voters, the table P(votes | label)."""
    prior: float
    cliques: list[tuple[int, ...]]
    tables: list[np.ndarray]  # per clique: (2, 3 ** voters)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes) for rows of votes in {0, 1, 2} (none, one, more hits)."""
        log = np.log(np.array([1 - self.prior, self.prior]))[:, None] + np.zeros(len(votes))
        for clique, t in zip(self.cliques, self.tables):
            log += np.log(t[:, _code(votes, clique)])
        log -= log.max(axis=0)
        p = np.exp(log)
        return p[1] / p.sum(axis=0)


def _code(votes: np.ndarray, clique: tuple[int, ...]) -> np.ndarray:
    code = np.zeros(len(votes), np.int64)
    for j in clique:
        code = code * 3 + votes[:, j]
    return code


def _em(votes, weight, cliques, post, rounds=50):
    for _ in range(rounds):
        prior = float(np.clip((post * weight).sum() / weight.sum(), 1e-4, 0.5))
        tables = []
        for c in cliques:
            code, size = _code(votes, c), 3 ** len(c)
            t = np.stack([np.bincount(code, weight * (1 - post), size), np.bincount(code, weight * post, size)])
            tables.append((t + 0.1) / (t + 0.1).sum(axis=1, keepdims=True))
        model = LabelModel(prior, cliques, tables)
        new = model.posterior(votes)
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return model, post


def fit_labels(patterns: dict[str, int], dependence: float = 0.05, most: int = 3) -> LabelModel | None:
    """EM on the counts of vote patterns, without any label.

    Voters start as independent given the label.  Then the pair with the
    largest mutual information given the posterior label is joined, while that
    is at least ``dependence`` (bits per row, on the rows of either label) and
    the joint clique has at most ``most`` voters, and EM runs again: dependent
    voters so count as one piece of evidence."""
    if not patterns:
        return None
    votes = np.array([["-0+".index(c) for c in p] for p in patterns])
    weight = np.array(list(patterns.values()), float)
    # Start: rows where lexicons hit are likelier toxic.
    lexical = (votes[:, :len(LEXICONS)] == 2).sum(axis=1)
    post = np.where(lexical >= 2, 0.95, np.where(lexical == 1, 0.5, 0.02))
    cliques: list[tuple[int, ...]] = [(j,) for j in range(votes.shape[1])]
    model, post = _em(votes, weight, cliques, post)
    while True:
        best = max(((_dependence(votes, weight, post, a, b), a, b) for i, a in enumerate(cliques)
                    for b in cliques[i + 1:] if len(a) + len(b) <= most), default=(0.0, (), ()))
        if best[0] < dependence:
            return model
        cliques = [c for c in cliques if c not in best[1:]] + [best[1] + best[2]]
        model, post = _em(votes, weight, cliques, post)


def _dependence(votes, weight, post, a, b) -> float:
    """The larger of the mutual informations of two cliques' votes given either label, in bits."""
    most = 0.0
    for p in (post, 1 - post):
        w = weight * p
        if w.sum() < 1:
            continue
        x, y = _code(votes, a), _code(votes, b)
        joint = np.bincount(x * 3 ** len(b) + y, w, 3 ** (len(a) + len(b))).reshape(3 ** len(a), -1) / w.sum()
        px, py = joint.sum(1, keepdims=True), joint.sum(0, keepdims=True)
        on = joint > 0
        most = max(most, float((joint[on] * np.log2(joint[on] / (px * py)[on])).sum()))
    return most


@dataclass
class ToxicityModel:
    lexicons: dict[str, frozenset[str]]
    labels: LabelModel | None
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 * len(VOTERS) + 1))


def features(counts: np.ndarray) -> np.ndarray:
    """Per voter the log of its hits and of its hits per thousand words, then 1."""
    hit, words = counts[:, :-1].astype(float), np.maximum(counts[:, -1:], 1)
    return np.hstack([np.log1p(hit), np.log1p(1000 * hit / words) / 5, np.ones((len(counts), 1))])


def fit_classifier(counts: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels, by Newton steps."""
    x = features(counts)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + penalty * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6)
        step = np.linalg.solve(curve, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(counted: DataFrame, lexicons, max_rows: int = 40_000) -> ToxicityModel:
    """The label model from the vote patterns of all rows of ``counted`` (see ``hits``);
    the classifier from the distinct counts of at most ``max_rows`` rows per vote (smallest hashes)."""
    voted = counted.select("_hits", vote(F.col("_hits")).alias("votes"))
    # At most 3 ** voters patterns, whatever the number of rows.
    patterns = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    labels = fit_labels(patterns)
    model = ToxicityModel(lexicons, labels)
    if labels is None:
        return model
    # A bounded sample of the distinct counts, each weighted by its rows.
    tallied = voted.groupBy("_hits", "votes").agg(F.count("*").alias("n"))
    some = tallied.orderBy(F.xxhash64("_hits"), "_hits").limit(max_rows).toPandas()
    counts = np.array(some["_hits"].tolist(), np.int64).reshape(len(some), -1)
    codes = np.array([["-0+".index(c) for c in v] for v in some["votes"]])
    model.weights = fit_classifier(counts, labels.posterior(codes), some["n"].to_numpy(float))
    return model


def score(counted: DataFrame, model: ToxicityModel, out_col: str = "score") -> DataFrame:
    """``counted`` plus the classifier's probability, by column arithmetic."""
    n = len(VOTERS)
    h = F.col("_hits")
    words = F.greatest(h[n], F.lit(1)).cast("double")
    z = F.lit(float(model.weights[-1]))
    for i in range(n):
        hit = h[i].cast("double")
        z = z + float(model.weights[i]) * F.log1p(hit) + float(model.weights[n + i]) * F.log1p(1000 * hit / words) / 5
    return counted.withColumn(out_col, 1 / (1 + F.exp(-z)))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", keep: list[str] | None = None, out_col: str = "score") -> DataFrame:
    """``keep`` columns of every row of ``docs`` plus the score (0 to 1, higher: likelier toxic).

    ``labels`` are the rows that may be learned from.  Null and empty texts
    have no hits and get the score of a text without any.  Without labels the
    lexicon of common insults still votes; an empty table stays empty."""
    lexicons = induce(docs, labels, id_col, text_col, label_col)
    counted = cut(hits(docs, lexicons, text_col).select(*(keep or [id_col]), "_hits"), "hits")
    model = train(counted, lexicons)
    return score(counted, model, out_col).drop("_hits")
