"""Token counts that follow edits without encoding whole documents again.

A document is cut into leaves at places no pre-token crosses, and keeps a
segment tree over them with characters and tokens per subtree.  An edit
encodes the leaves it touches and one more on either side, then updates the
sums on their paths to the root."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from epiframe.llm.common import cut, text_slices

#: Characters of a leaf, at least, where a safe cut follows.
LEAF = 512
#: Edits of one document applied from one row; longer logs go in several rounds.
EDITS_AT_ONCE = 10_000


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def cuts(text: str, leaf: int = LEAF) -> list[str]:
    """The text in leaves of at least ``leaf`` characters (the last maybe fewer).

    A leaf begins at a space between two characters that are no white space:
    the split pattern always begins a pre-token there, whatever is around it."""
    out, at, n = [], 0, len(text)
    while n - at > leaf:
        p = text.find(" ", at + leaf)
        while p >= 0 and (p + 1 >= n or text[p - 1].isspace() or text[p + 1].isspace()):
            p = text.find(" ", p + 1)
        if p < 0:
            break
        out.append(text[at:p])
        at = p
    out.append(text[at:])
    return out


class Tree:
    """Segment tree over the leaves of one document, in two flat lists."""

    def __init__(self, leaves: list[str], tokens: list[int]):
        self.leaves = list(leaves)
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        pad = [0] * (self.size - len(leaves))
        self.chars = [0] * self.size + [len(x) for x in leaves] + pad
        self.tokens = [0] * self.size + list(tokens) + pad
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, position: int) -> tuple[int, int]:
        """(leaf, its first character) that holds the character at ``position``, the last one at the end."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if position >= before + self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return i - self.size, before

    def put(self, leaf: int, text: str, tokens: int) -> None:
        i = leaf + self.size
        chars, more = len(text) - self.chars[i], tokens - self.tokens[i]
        self.leaves[leaf] = text
        while i:
            self.chars[i] += chars
            self.tokens[i] += more
            i //= 2

    def edit(self, start: int, stop: int, insert: str, count) -> int:
        """Replaces characters start to stop; returns how many characters were encoded again."""
        total = self.chars[1]
        start = min(max(start, 0), total)
        stop = min(max(stop, start), total)
        first, before = self.find(start)
        last, _ = self.find(stop)
        # Context: the nearest leaf of two characters or more on either side keeps the outer cuts safe.
        while first:
            first -= 1
            before -= len(self.leaves[first])
            if len(self.leaves[first]) > 1:
                break
        while last < len(self.leaves) - 1:
            last += 1
            if len(self.leaves[last]) > 1:
                break
        old = "".join(self.leaves[first:last + 1])
        new = old[:start - before] + insert + old[stop - before:]
        slots = last - first + 1
        parts = cuts(new, max(LEAF, -(-len(new) // slots)))
        parts += [""] * (slots - len(parts))
        for k, part in enumerate(parts):
            self.put(first + k, part, count(part))
        return len(new)


def trees(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, n_tokens, leaf_chars, leaf_tokens): the kept state, a row per distinct id and text.

    The inner sums follow from the leaves and are not stored.  version is a
    hash of the text, so an id that stands for several texts has a row each.
    Null counts as the empty text."""
    def run(batches):
        for batch in batches:
            enc = encoder(ranks_path, pattern)
            for a, b, texts in text_slices(batch.column(2)):
                leaves = [cuts(t) for t in texts]
                tokens = [[len(enc.encode_ordinary(x)) for x in row] for row in leaves]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                     pa.array([sum(t) for t in tokens], pa.int64()),
                     pa.array([[len(x) for x in row] for row in leaves], pa.list_(pa.int32())),
                     pa.array(tokens, pa.list_(pa.int32()))],
                    names=["id", "version", "n_tokens", "leaf_chars", "leaf_tokens"])

    rows = _versions(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return (rows.mapInArrow(run, f"id {kind}, version long, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>")
            .dropDuplicates(["id", "version"]))


def _versions(docs, id_col, text_col):
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))


def recount(docs: DataFrame, state: DataFrame, edits: DataFrame, ranks_path: str, pattern: str,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_edited, n_edits, chars_encoded): a row per row of ``docs``.

    ``edits`` (id, seq, start, stop, insert) are applied in the order of seq,
    then start, stop, insert; positions refer to the text after the edits
    before, and are held within it; nulls count as 0, start and the empty
    text.  Edits of unknown ids do nothing.  chars_encoded is what was encoded
    for the edits, the rest of the tree is taken over."""
    log = edits.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col("seq"), F.coalesce("start", F.lit(0)).cast("int").alias("start"),
        F.coalesce("stop", "start", F.lit(0)).cast("int").alias("stop"), F.coalesce("insert", F.lit("")).alias("insert"))
    order = Window.partitionBy("id").orderBy("seq", "start", "stop", "insert")
    log = log.withColumn("k", F.row_number().over(order))
    log = cut(log.groupBy("id", F.floor((F.col("k") - 1) / EDITS_AT_ONCE).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("k", "start", "stop", "insert"))).alias("edits")), "edits")
    parts = 1 + (log.agg(F.max("part")).first()[0] or 0)

    def run(batches):
        for batch in batches:
            enc = encoder(ranks_path, pattern)
            out = {n: [] for n in ("leaf_tokens", "n_edits", "chars_encoded", "leaves")}
            for text, widths, tokens, leaves, todo, done, chars in zip(*(batch.column(i).to_pylist() for i in range(2, 9))):
                if leaves is None:
                    ends = np.cumsum(widths).tolist()
                    leaves = [text[e - w:e] for e, w in zip(ends, widths)]
                tree = Tree(leaves, tokens)
                for e in todo or []:
                    chars += tree.edit(e["start"], e["stop"], e["insert"], lambda x: len(enc.encode_ordinary(x)) if x else 0)
                out["leaf_tokens"].append(tree.tokens[tree.size:tree.size + len(leaves)])
                out["leaves"].append(tree.leaves if parts > 1 else None)
                out["n_edits"].append(done + len(todo or []))
                out["chars_encoded"].append(chars)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out["leaf_tokens"], pa.list_(pa.int32())),
                 pa.array(out["leaves"], pa.list_(pa.string())), pa.array(out["n_edits"], pa.int64()),
                 pa.array(out["chars_encoded"], pa.int64())],
                names=["id", "n_tokens", "leaf_tokens", "leaves", "n_edits", "chars_encoded"])

    def with_edits(rows, part):
        return rows.join(log.where(F.col("part") == part).select("id", "edits"), "id", "left")

    # The first edits meet the small state, not the texts: these are shuffled once.
    known = with_edits(state, 0).select(F.col("id").alias("_id"), F.col("version").alias("_version"), "n_tokens",
                                        "leaf_chars", "leaf_tokens", "edits")
    rows = _versions(docs, id_col, text_col).join(
        known, F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")))
    rows = rows.withColumns({"leaves": F.lit(None).cast("array<string>"), "n_edits": F.lit(0).cast("long"),
                             "chars_encoded": F.lit(0).cast("long")})
    kind = rows.schema["id"].dataType.simpleString()
    for part in range(parts):
        rows = (with_edits(rows, part) if part else rows).select(
            "id", "n_tokens", "text", "leaf_chars", "leaf_tokens", "leaves", "edits", "n_edits", "chars_encoded")
        rows = rows.mapInArrow(run, f"id {kind}, n_tokens long, leaf_tokens array<int>, leaves array<string>, "
                                    "n_edits long, chars_encoded long")
        rows = rows.select("id", "n_tokens", F.lit("").alias("text"), F.array().cast("array<int>").alias("leaf_chars"),
                           "leaf_tokens", "leaves", "n_edits", "chars_encoded")
        if part < parts - 1:
            rows = cut(rows, "edited")
    total = F.aggregate("leaf_tokens", F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select(F.col("id").alias(id_col), "n_tokens", total.alias("n_edited"), "n_edits", "chars_encoded")
