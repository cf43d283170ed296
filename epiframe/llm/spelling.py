"""Spelling variants: words one edit apart, found by dense comparison of blocks of padded code points.

With p and s the lengths of the common prefix and suffix of two different
words, the longer of m code points, they are one edit apart if and only if
their lengths differ by one at most and p + s >= m - 1."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from epiframe.llm.common import cut, text_slices

RUNS = re.compile("[a-zÀ-ÿ]+")


def run_counts(doc_id: str, text: str, every: int = 97) -> Counter:
    """Words of a text -> how often: runs of Latin letters, A-Z lower-cased.  A run
    loses one code point where ``every`` divides the CRC-32 of ``<doc_id>:<run>``
    (the one at that number modulo the run's length); 0 for none."""
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    seed = zlib.crc32(f"{doc_id}:".encode())
    out: Counter = Counter()
    for word, n in Counter(RUNS.findall(lower)).items():
        if every and (h := zlib.crc32(word.encode(), seed)) % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
        out[word] += n
    return out


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97,
          shortest: int = 5, least: int = 3, held: int = 500_000) -> DataFrame:
    """(word, n): words of at least ``shortest`` code points found ``least`` times in all.

    A null text has no word, a null id counts as the text ``null``.  A task keeps
    about ``held`` distinct words at a time and sends their counts on."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out():
            kept = [w for w in total if len(w) >= shortest]
            return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([total[w] for w in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            ids = batch.column(0)
            for start, end, texts in text_slices(batch.column(1)):
                for doc_id, text in zip(ids.slice(start, end - start).to_pylist(), texts):
                    total.update(run_counts("null" if doc_id is None else doc_id, text, every))
                if len(total) > held:
                    yield out()
                    total.clear()
        yield out()

    found = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


#: What names a group of ``_keyed``, and a block pair of it.
GROUP, TILE = ["m", "lo", "rest"], ["m", "lo", "rest", "i", "j"]


def _keyed(vocabulary: DataFrame, parts: int) -> DataFrame:
    """(m, lo, hi, rest, word, n): the groups in which a word meets all words one edit away.

    Cut the longer word (m code points) of a pair into ``parts`` stretches.  The
    edited code point lies in one of them, [lo, hi); before lo both words are
    equal counted from the left, after hi counted from the right.  So they share
    (m, lo, hash of what precedes lo and of the last m - hi code points).  A word
    is the longer one for m = its length and may be the shorter one for m + 1."""
    size = F.char_length("word")
    at = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("at")
    cuts = vocabulary.select("word", "n", F.explode(F.array(size, size + 1)).alias("m")).select("word", "n", "m", at)
    cuts = cuts.select("word", "n", "m", F.floor(F.col("m") * F.col("at") / parts).cast("int").alias("lo"),
                       F.floor(F.col("m") * (F.col("at") + 1) / parts).cast("int").alias("hi")).where("lo < hi")
    return cuts.select("m", "lo", "hi", F.xxhash64(F.expr("left(word, lo)"), F.expr("right(word, m - hi)")).alias("rest"), "word", "n")


def _tiles(keyed: DataFrame, block: int) -> DataFrame:
    """``keyed`` dealt into block pairs (m, lo, rest, i, j): a group of up to
    ``block`` words is the one pair (0, 0); a larger one is cut into blocks by a
    hash of the word (smaller ones where words pass 64 code points), each block
    sent to its pairs, which are work of their own wherever they land, so no
    group is ever in one place.  ``second`` marks the rows of block j if i < j."""
    size = keyed.groupBy(*GROUP).agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") * F.greatest(F.col("m"), F.lit(64)) / (64 * block)).cast("int")
    own = F.pmod(F.xxhash64("word"), F.least("blocks", "size")).cast("int")
    placed = keyed.join(size.withColumn("blocks", blocks), GROUP).withColumn("own", own)
    placed = placed.select(*GROUP, "hi", "word", "n", "own", F.explode(F.sequence(F.lit(0), F.least("blocks", "size").cast("int") - 1)).alias("other"))
    return placed.select(*GROUP, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                         (F.col("own") > F.col("other")).alias("second"), "hi", "word", "n")


def _padded(found: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points from the left, from the right, lengths), rows padded with zeros."""
    points = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points) or points.max() < 256:
        points = points.astype(np.uint8)
    lengths = np.fromiter(map(len, found), np.int32, len(found))
    row = np.repeat(np.arange(len(found)), lengths)
    at = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left, right = np.zeros((2, len(found), size), points.dtype)
    left[row, at] = points
    right[row, np.repeat(lengths, lengths) - 1 - at] = points
    return left, right, lengths


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading columns of each row pair are equal (all of them: the width)."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _near(left, right, lengths, lo, hi, u, v) -> np.ndarray:
    """Which of the row pairs (u, v) are one edit apart with the first differing
    code point in [lo, hi) (so a pair that shares several groups counts in one)."""
    longer, shorter = np.maximum(lengths[u], lengths[v]), np.minimum(lengths[u], lengths[v])
    prefix = np.minimum(_common(left[u], left[v]), shorter)
    ok = (longer - shorter <= 1) & (lo[u] <= prefix) & (prefix < hi[u])
    u, v, prefix, longer, shorter, at = u[ok], v[ok], prefix[ok], longer[ok], shorter[ok], np.flatnonzero(ok)
    suffix = np.minimum(_common(right[u], right[v]), shorter)
    return at[prefix + suffix >= longer - 1]


def _compare_rows(table: pa.Table, pairs: int) -> Iterator[pa.RecordBatch]:
    """Links of whole block pairs, about ``pairs`` row pairs at a time."""
    found = table["word"].to_pylist()
    width = max(map(len, found))
    left, right, lengths = _padded(found, width)
    n, m, lo, hi, second, i, j = (table[c].to_numpy() for c in ("n", "m", "lo", "hi", "second", "i", "j"))
    starts = np.flatnonzero(_new_tile(table))
    ends = np.append(starts[1:], len(found))
    # a row meets those after it in its own block, or all of the second block
    inside = np.repeat(i[starts] == j[starts], ends - starts)
    row = np.arange(len(found))
    first = np.where(inside, row + 1, np.repeat(starts + np.add.reduceat((~second).astype(np.int64), starts), ends - starts))
    size = np.where(~inside & second, 0, np.repeat(ends, ends - starts) - first)
    done = np.cumsum(size)
    pairs = max(1, pairs * 16 // max(16, width))
    word, at = pa.array(found, pa.string()), 0
    while at < len(found):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + pairs, side="right")))
        k = size[at:to]
        u = np.repeat(row[at:to], k)
        v = np.repeat(first[at:to], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        whole = np.maximum(lengths[u], lengths[v]) == m[u]
        u, v = u[whole], v[whole]
        ok = _near(left, right, lengths, lo, hi, u, v)
        u, v = u[ok], v[ok]
        yield pa.RecordBatch.from_arrays([word.take(pa.array(u)), pa.array(n[u]), word.take(pa.array(v)), pa.array(n[v])], ["u", "un", "v", "vn"])
        at = to


def _new_tile(table: pa.Table) -> np.ndarray:
    """Which rows begin a block pair."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in TILE:
        x = table[c].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return new


def _of_like_width(table: pa.Table) -> Iterator[pa.Table]:
    """``table`` (by m ascending) in parts whose words are at most twice as long as each other."""
    kind = np.log2(table["m"].to_numpy()).astype(int)
    cuts = np.flatnonzero(np.diff(kind, prepend=-1, append=-1)).tolist()
    for start, end in zip(cuts, cuts[1:]):
        yield table.slice(start, end - start)


def _compare(batches: Iterator[pa.RecordBatch], cells: int = 1 << 22, pairs: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Links (u, un, v, vn) of the block pairs in sorted rows of ``_tiles``.  Block
    pairs are taken together until their padded matrix has ``cells`` cells."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held.append(table)
        size += int(table["m"].to_numpy().astype(np.int64).sum())
        if size < cells:
            continue
        table = pa.concat_tables(held)
        end = int(np.flatnonzero(_new_tile(table))[-1])  # the last block pair may go on in the next batch
        for part in _of_like_width(table.slice(0, end)):
            yield from _compare_rows(part, pairs)
        held = [table.slice(end)]
        size = int(held[0]["m"].to_numpy().astype(np.int64).sum())
    for part in _of_like_width(pa.concat_tables(held)) if held else ():
        yield from _compare_rows(part, pairs)


def links(vocabulary: DataFrame, parts: int = 4, block: int = 1024) -> DataFrame:
    """(u, un, v, vn): every pair of different words one edit apart, once, with their counts."""
    tiles = _tiles(_keyed(vocabulary, parts), block)
    sorted_tiles = tiles.repartition(*TILE).sortWithinPartitions(*TILE, "second")
    return sorted_tiles.mapInArrow(_compare, "u string, un long, v string, vn long")


def forms(vocabulary: DataFrame, near: DataFrame, factor: int = 2) -> DataFrame:
    """(word, form, n, n_near, form_n): a word's form is its near word of largest
    count (ties: smallest in code-point order), if that is ``factor`` times its own or more."""
    sides = near.select(F.col("u").alias("word"), F.col("v").alias("other"), F.col("vn").alias("other_n")).unionByName(
        near.select(F.col("v").alias("word"), F.col("u").alias("other"), F.col("un").alias("other_n")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    best = best.select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.other").alias("best"))
    is_form = F.col("best_n") >= factor * F.col("n")
    return (vocabulary.join(best, "word", "left")
            .select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                    F.when(is_form, F.col("best_n")).alias("form_n")))


def roots(found: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(word, root) for every word with a form: the last word reached over forms.

    Counts grow at least twofold along forms, so a chain has at most 63 of them;
    each round doubles how far a word looks, written to the shared folder."""
    cur = cut(found.where("form is not null").select("word", F.col("form").alias("root"), F.lit(False).alias("done")), "roots")
    for _ in range(max_rounds):
        if not cur.where("not done").limit(1).count():
            return cur.select("word", "root")
        ahead = cur.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("done").alias("end"))
        open_ = cur.where("not done").join(ahead, "root", "left")
        step = open_.select("word", F.coalesce("next", "root").alias("root"), F.coalesce("end", F.lit(True)).alias("done"))
        cur = cut(cur.where("done").unionByName(step), "roots")
    raise RuntimeError(f"chains of forms did not end in {max_rounds} rounds")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, shortest: int = 5,
             least: int = 3, factor: int = 2, parts: int = 4, block: int = 1024) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per word of ``words``.

    form is the near word it is a variant of, else null; root is the end of the
    chain of forms (the word itself without a form); n_near counts its near words."""
    vocabulary = cut(words(docs, id_col, text_col, every, shortest, least), "words")
    near = cut(links(vocabulary, parts, block), "near")
    found = cut(forms(vocabulary, near, factor), "forms")
    return (found.join(roots(found), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
