"""Phrase collocations by stripes: each prefix keys a counter of next words.

A task holds the stripes of the text it reads as sorted arrays and sends each as
one row; stripes are merged elementwise.  The merged structure gives the counts
of the extensions (its entries), the count of a one-word prefix (the sum of its
stripe, the end of a piece being an entry), and the largest extension of a
phrase.  Longer phrases are counted level by level: a phrase can only reach the
least count if all its parts do, so before the text is read again, what lies
outside of frequent word pairs is dropped."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from epiframe.llm.common import cut, text_slices

#: What ends a piece; all of it is turned into SEP, which no word holds.  END is a
#: stripe's entry for the end of a piece.
BREAKS, SEP, END = b".,;:!?\n\x0b\x0c\r", b".", ""
_FOLD = bytes.maketrans(BREAKS + b"\t", SEP * len(BREAKS) + b" ")
STRIPE = "lang string, prefix string, next array<string>, n array<long>"


def words_of(text: str) -> list[bytes]:
    """Words, A-Z lower-cased, and SEP after every piece."""
    folded = text.encode("utf-8", "surrogatepass").lower().translate(_FOLD)
    words = folded.replace(SEP, b" . ").split()
    words.append(SEP)
    return words


class _Ids(dict):
    """word -> running number; 0 is the end of a piece, also as a word's successor."""

    def __init__(self):
        self.words = [SEP]
        self[SEP] = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n


class _Held:
    """Coded text of several languages."""

    def __init__(self):
        self.ids, self.langs, self.parts, self.size = _Ids(), {}, [], 0

    def add(self, lang: str, text: str) -> None:
        words = words_of(text)
        self.parts.append((np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)), self.langs.setdefault(lang, len(self.langs))))
        self.size += len(words)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, languages) of all held text."""
        lang = np.array([x for _, x in self.parts], np.int32)
        return np.concatenate([c for c, _ in self.parts]), np.repeat(lang, [len(c) for c, _ in self.parts])


def _pack(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def _stripes(held: _Held, length: int) -> Iterator[pa.RecordBatch]:
    """Stripes of the prefixes of ``length`` - 1 words in the held text.  One-word
    prefixes have the end of a piece as an entry, longer ones only words."""
    code, lang = held.arrays()
    n = len(code) - length + 1
    if n <= 0:
        return
    inner = [code[i:i + n] for i in range(length)]
    ok = np.logical_and.reduce([c != 0 for c in (inner[:1] if length == 2 else inner)])
    base = len(held.ids.words)
    prefix = lang[:n][ok].astype(np.int64)
    for c in inner[:-1]:
        # number the prefixes anew at each word, so the next product stays small
        seen, prefix = np.unique(prefix * base + c[ok], return_inverse=True)
    at = np.flatnonzero(ok)
    first = np.zeros(len(seen), np.int64)
    first[prefix] = at  # a place where the prefix stands
    entry, count = np.unique(prefix * base + inner[-1][ok], return_counts=True)
    owner, follow = entry // base, entry % base
    offsets = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
    names = held.ids.words
    vocabulary = _pack([END.encode(), *names[1:]])
    langs = pa.array(list(held.langs), pa.string())
    if length == 2:
        prefixes = vocabulary.take(pa.array(code[first]))
    else:
        prefixes = _pack([b" ".join([names[x] for x in row]) for row in np.stack([code[first + i] for i in range(length - 1)], 1).tolist()])
    step = 20_000
    for a in range(0, len(seen), step):
        b = min(a + step, len(seen))
        lo, hi = offsets[a], offsets[b]
        cuts = pa.array(offsets[a:b + 1] - lo, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [langs.take(pa.array(lang[first[a:b]])), prefixes.slice(a, b - a),
             pa.ListArray.from_arrays(cuts, vocabulary.take(pa.array(follow[lo:hi]))),
             pa.ListArray.from_arrays(cuts, pa.array(count[lo:hi]))], ["lang", "prefix", "next", "n"])


def _texts(batches: Iterator[pa.RecordBatch], long: int = 8_000_000) -> Iterator[tuple[str, str]]:
    """(lang, text): the texts of each language in a slice of rows, joined by the end
    of a piece; one of over ``long`` characters is cut where pieces end."""
    for batch in batches:
        langs = batch.column(0)
        for start, end, texts in text_slices(batch.column(1)):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(langs.slice(start, end - start).to_pylist(), texts):
                by_lang.setdefault(lang, []).append(text)
            for lang, parts in by_lang.items():
                text, at = "\n".join(parts), 0
                while len(text) - at > long:
                    ends = [e for c in BREAKS.decode() if (e := text.find(c, at + long)) >= 0]
                    to = min(ends, default=len(text) - 1) + 1
                    yield lang, text[at:to]
                    at = to
                yield lang, text[at:]


def _held(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[_Held]:
    """The text of a task, about ``words`` words at a time."""
    held = _Held()
    for lang, text in _texts(batches):
        held.add(lang, text)
        if held.size >= words:
            yield held
            held = _Held()
    if held.parts:
        yield held


def stripes(texts: DataFrame, length: int, held_words: int = 1_000_000) -> DataFrame:
    """(lang, prefix, next, n): how often ``next`` follows the ``length`` - 1 words of
    ``prefix`` within a piece, in ``texts`` (lang, text).

    A task makes stripes of about ``held_words`` words at a time, which is all that
    can be combined before the shuffle: a second partial sum there would only
    hold the same rows once more.  Their entries are summed per (prefix, next), so
    the stripe of a frequent prefix, however wide, is spread over all tasks."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, held_words):
            yield from _stripes(held, length)

    rows = texts.mapInArrow(made, STRIPE)
    flat = rows.select("lang", "prefix", F.inline(F.arrays_zip("next", "n")).alias("next", "n"))
    return flat.repartition("lang", "prefix", "next").groupBy("lang", "prefix", "next").agg(F.sum("n").alias("n"))


def _turn(h: Column, by: int) -> Column:
    return F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by)) if by else h


def phrase_filter(phrases: DataFrame, size: int, bits: int = 26) -> np.ndarray:
    """A bit array of 2^``bits`` bits with two set for each (lang, phrase of ``size``
    words): 8 MB whatever the table, so it may be sent to every task.  A phrase that
    is not there may pass (what is counted for it then falls short), none is lost."""
    word = F.split("phrase", " ")
    hashes = [F.xxhash64(F.concat("lang", F.lit("\n"), F.get(word, F.lit(i)))) for i in range(size)]
    mixed = hashes[0]
    for i, h in enumerate(hashes[1:], 1):
        mixed = mixed.bitwiseXOR(_turn(h, i))
    mask = F.lit((1 << bits) - 1)
    at = F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask)))
    cells = phrases.select(mixed.alias("h")).select(at.alias("at")).groupBy(F.shiftrightunsigned("at", 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("word"))
    found = cells.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["cell"].to_numpy()] = found["word"].to_numpy()
    return out.view(np.uint64)


def _runs(held: _Held, bits: np.ndarray, size: int, words: int = 200_000) -> pa.RecordBatch:
    """The stretches of the held text in which two phrases of ``size`` words or more,
    one after another, pass the filter, as texts of about ``words`` words whose
    pieces they are."""
    code, lang = held.arrays()
    names, langs, base = held.ids.words, list(held.langs), len(held.ids.words)
    known, inverse = np.unique(lang.astype(np.int64) * base + code, return_inverse=True)
    heads = [f"{x}\n".encode() for x in langs]
    h = np.array([xxhash.xxh64_intdigest(heads[k // base] + names[k % base], 42) for k in known.tolist()], np.uint64)[inverse]
    n = max(0, len(code) - size + 1)
    mixed, ok = h[:n].copy(), np.ones(n, bool)
    for i in range(size):
        ok &= code[i:i + n] != 0
        if i:
            mixed ^= (h[i:i + n] << np.uint64(i)) | (h[i:i + n] >> np.uint64(64 - i))
    mask = np.uint64(len(bits) * 64 - 1)
    for at in (mixed & mask, (mixed >> np.uint64(32)) & mask):
        ok &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    edge = np.diff(np.concatenate(([0], ok.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= 2
    starts, ends = starts[long], ends[long] + size - 1
    # the words of all stretches, each followed by a place for SEP
    sizes = ends - starts + 1
    after = np.cumsum(sizes)
    source = np.arange(sizes.sum()) + np.repeat(starts - (after - sizes), sizes)
    source[after - 1] = starts  # any place of the same language
    out, of = code[source], lang[source]
    out[after - 1] = 0
    texts, owners = [], []
    for x in range(len(langs)):
        own = out[of == x].tolist()
        at = 0
        while at < len(own):
            to = own.index(0, min(at + words, len(own) - 1)) + 1
            texts.append(b" ".join([names[c] for c in own[at:to]]))
            owners.append(langs[x])
            at = to
    return pa.RecordBatch.from_arrays([pa.array(owners, pa.string()), _pack(texts)], ["lang", "text"])


def frequent_runs(texts: DataFrame, bits: np.ndarray, size: int, held_words: int = 1_000_000) -> DataFrame:
    """(lang, text): what of ``texts`` can hold a frequent phrase of ``size`` + 1 words,
    given the filter of those of ``size``."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, held_words):
            yield _runs(held, shared.value, size)

    return texts.mapInArrow(made, "lang string, text string")


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 5, least: int = 100) -> DataFrame:
    """(lang, phrase, size, a, prefix): every phrase of 1 to ``longest`` words found
    ``least`` times, and per lang a row of size 0 with the number of all words in a."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    pairs = stripes(texts, 2)
    # an entry that cannot be a phrase only adds to its prefix: folded into one
    frequent = F.when((F.col("next") != END) & (F.col("n") >= least), F.col("next"))
    pairs = cut(pairs.groupBy("lang", "prefix", frequent.alias("next")).agg(F.sum("n").alias("n")), "stripes")
    words = cut(pairs.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.sum("n").alias("a")), "words")
    none = F.lit(None).cast("string").alias("prefix")
    found = [words.groupBy("lang").agg(F.sum("a").alias("a")).select("lang", F.lit("").alias("phrase"), F.lit(0).alias("size"), "a", none),
             words.where(F.col("a") >= least).select("lang", "phrase", F.lit(1).alias("size"), "a", none)]
    level, size = pairs.where("next is not null"), 2
    while True:
        phrases = cut(level.select("lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), F.lit(size).alias("size"),
                                   F.col("n").alias("a"), "prefix"), f"phrases{size}")
        found.append(phrases)
        if size == longest or phrases.isEmpty():
            return reduce(DataFrame.unionByName, found)
        texts = cut(frequent_runs(texts, phrase_filter(phrases, size), size), "runs")
        size += 1
        level = stripes(texts, size).where(F.col("n") >= least)


def _scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words and more, by their
    lowest-scoring cut (ties: the earliest).  Decimals keep the products exact."""
    word, k = F.split("phrase", " "), F.col("k")
    cuts = phrases.where("size > 1").select("lang", "phrase", "a", word.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), k), " ").alias("left"),
                       F.array_join(F.slice("w", k + 1, F.size("w")), " ").alias("right"))
    parts = phrases.where("size > 0")
    each = (cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
            .join(parts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
            .join(phrases.where("size = 0").select("lang", F.col("a").alias("n")), "lang"))
    a, l, r, n = (f"cast({c} as decimal(17,0))" for c in "alrn")
    score = F.expr(f"({a} * {n} * 1000BD) div ({l} * {r})").cast("long")
    lowest = each.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("n").alias("n"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def _contained(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, most): the largest count of a phrase one word longer that holds
    the phrase, to its right (the maximum of its stripe) or to its left.  Phrases
    that are longer still have no larger counts."""
    longer = phrases.where("size > 2")
    right = longer.select("lang", F.col("prefix").alias("phrase"), "a")
    left = longer.select("lang", F.expr("substring(phrase, locate(' ', phrase) + 1)").alias("phrase"), "a")
    return right.unionByName(left).groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 5, least: int = 100,
                 share: int = 100, top: int = 2000, salts: int = 32) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): per language the ``top`` phrases.

    Texts are cut into pieces and words as ``words_of`` does; a null lang is
    ``und``, a null text empty.  a, l, r count the phrase and the two parts of its
    lowest-scoring cut, n all words of the language; score is
    floor(1000 a n / (l r)).  Phrases inside a longer one that is found in
    ``share`` percent of their places or more go.  Order: score, a descending,
    phrase ascending in UTF-8.  The ranks are taken in two steps, so a task
    orders a ``salts``-th of a language, then ``salts`` times ``top`` rows."""
    phrases = cut(phrase_counts(docs, lang_col, text_col, longest, least), "phrases")
    kept = _scored(phrases).join(_contained(phrases), ["lang", "phrase"], "left")
    kept = kept.where(F.coalesce(F.col("most") * 100 < F.col("a") * share, F.lit(True))).drop("most")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    first = kept.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    ranked = first.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
