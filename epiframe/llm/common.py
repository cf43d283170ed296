"""Helpers the operators share: lineage cuts, word caches, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from epiframe.session import materialise as cut  # noqa: F401  (write under spark.checkpoint.dir, read back)


class _Numbers(dict):
    """word -> running number; words not seen before are noted in ``fresh``."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class WordCache:
    """word -> a few numbers, computed once per worker for words that recur.

    ``compute`` maps a list of words to (flat values, how many per word).  The
    cache is emptied before it would keep more than ``max_words`` words or
    ``max_values`` values from one call to the next, so a worker's memory is
    bounded; results never depend on what the cache holds."""

    def __init__(self, compute: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype,
                 max_words: int = 400_000, max_values: int = 4_000_000):
        self.compute, self.dtype, self.max_words, self.max_values = compute, dtype, max_words, max_values
        self._clear()

    def _clear(self) -> None:
        self.numbers, self.known, self.used = _Numbers(), 0, 0
        self.starts = np.zeros(1024, np.int64)
        self.sizes = np.zeros(1024, np.int64)
        self.values = np.zeros(8192, self.dtype)

    def _learn(self) -> None:
        flat, sizes = self.compute(self.numbers.fresh)
        self.numbers.fresh = []
        n, k = self.known + len(sizes), self.used + len(flat)
        if n > len(self.sizes):
            self.starts = np.resize(self.starts, 2 * n)
            self.sizes = np.resize(self.sizes, 2 * n)
        if k > len(self.values):
            self.values = np.resize(self.values, 2 * k)
        self.sizes[self.known:n] = sizes
        self.starts[self.known:n] = self.used + np.cumsum(sizes) - sizes
        self.values[self.used:k] = flat
        self.known, self.used = n, k

    #: The cache used last; another one's use empties it, so a worker that runs
    #: several operators after one another holds one cache at a time.
    last: "WordCache | None" = None

    def lookup(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(the values of all words of all texts in order, how many per text)."""
        if WordCache.last is not self:
            if WordCache.last is not None:
                WordCache.last._clear()
            WordCache.last = self
        if self.known > self.max_words or self.used > self.max_values:
            self._clear()
        number = self.numbers.__getitem__
        index = np.concatenate([np.zeros(0, np.int64),
                                *(np.fromiter(map(number, words), np.int64, len(words)) for words in texts)])
        if self.numbers.fresh:
            self._learn()
        sizes = self.sizes[index]
        ends = np.cumsum(sizes)
        flat = self.values[np.repeat(self.starts[index] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.cumsum([0, *(len(w) for w in texts)])
        return flat, np.diff(np.concatenate(([0], ends))[cuts])


def text_slices(column: pa.Array, size: int = 1_000_000) -> Iterable[tuple[int, int, list[str]]]:
    """(first, last + 1, texts) of a string column, about ``size`` bytes at a
    time (one text at least); null texts are empty."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, have = 0, 0
    for i, n in enumerate(sizes.tolist()):
        have += n
        if have >= size or i == len(sizes) - 1:
            yield start, i + 1, [t or "" for t in column.slice(start, i + 1 - start).to_pylist()]
            start, have = i + 1, 0


def slices(texts: list[str], chars: int = 1_000_000) -> Iterable[tuple[int, int]]:
    """Ranges of ``texts`` of about ``chars`` characters each (one text at least)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (u, v: long).

    Returns (node, root) with root the smallest node of the component, one row
    per node that has an edge to another node.  Alternates the two star steps
    (each hooks neighbours to the smallest neighbour) until the edges form
    stars; every round is written to the shared folder, so lineage stays short
    and a lost executor costs one round.  Nothing is collected but two sums."""
    cur = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
              .distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        cur = cut(small, "edges")
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            roots = cur.select("v").distinct()
            return (cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
                    .unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root"))))
        seen = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
