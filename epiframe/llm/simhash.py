"""SimHash near-duplicates with a ring filter over fingerprint segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from epiframe.llm.common import components, cut

BITS = 64


def simhash(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the whole text (signed).

    A-Z is lower-cased, words are runs of anything but ASCII white space, and
    all ``shingle``-word windows (repeats included) are hashed by XXH64 with
    seed 42.  Fewer words: one window of all words.  No word, or null: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[:n - 1] + 1)).tolist()
    ends = ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    count = np.zeros(BITS, dtype=np.int64)
    step = 1 << 16
    for at in range(0, n, step):
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[at:at + step], ends[at:at + step])], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int32)
    set_bits = np.packbits((2 * count > n).astype(np.uint8), bitorder="little")
    return int(set_bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): one row per input row; fp is the signed 64-bit SimHash."""
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias(id_col), fp(F.col(text_col)).alias("fp"))


def _segments(max_bits: int) -> list[int]:
    """max_bits + 2 bit masks (signed) that split the 64 bits into a ring of segments."""
    m = max_bits + 2
    cuts = [BITS * i // m for i in range(m + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [x - (1 << BITS) if x >= 1 << (BITS - 1) else x for x in masks]


def _starts(max_bits: int) -> dict[tuple[int, int], list[int]]:
    """Segment pairs to match exactly -> the ring starts they serve.

    With m segments and at most t differing bits, some start s has, for every
    length l, at most floor(l * t / m) differing bits in the l segments from s.
    So segment s is equal, and a second one is among the next few: the first
    length l with l - floor(l * t / m) >= 2 says how far to look."""
    m = max_bits + 2
    reach = next(n for n in range(2, m + 1) if n - n * max_bits // m >= 2)
    pairs: dict[tuple[int, int], list[int]] = {}
    for s in range(m):
        for d in range(1, reach):
            pairs.setdefault(tuple(sorted((s, (s + d) % m))), []).append(s)
    return pairs


def links(fps: DataFrame, max_bits: int = 2, crowd: int = 32) -> DataFrame:
    """(u, v): links whose components equal those of "at most ``max_bits`` differing bits".

    ``fps`` holds distinct fingerprints (fp: long).  Each fingerprint is keyed
    by the segment pairs of the ring filter.  Fingerprints that share a key are
    candidates; their chains of consecutive segments must keep within the
    proportional budgets before the full distance is taken.

    A key shared by more than ``crowd`` fingerprints would give quadratically
    many candidates.  There (for max_bits 2) every member is sent to the points
    one free bit away and to itself: two members are at most two bits apart if
    and only if they meet in a point, at most 1 + free bits members meet in
    one, and each is linked to the smallest.  No link is lost, none is added."""
    masks, pairs = _segments(max_bits), _starts(max_bits)
    m = len(masks)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(masks[i] | masks[j]))
                                                    for i, j in pairs])).alias("k", "key"))
    size = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keyed.join(size, ["k", "key"]), "shared")

    few = shared if max_bits != 2 else shared.where(F.col("n") <= crowd)
    a, b = few.select("k", "key", F.col("fp").alias("u")), few.select("k", "key", F.col("fp").alias("v"))
    x = F.col("u").bitwiseXOR(F.col("v"))
    differ = [F.bit_count(x.bitwiseAND(F.lit(mask))) for mask in masks]
    chain = F.lit(False)
    for k, starts in enumerate(pairs.values()):
        for s in starts:
            ok, total = F.col("k") == k, F.lit(0)
            for n in range(1, m):
                total = total + differ[(s + n - 1) % m]
                ok = ok & (total <= n * max_bits // m)
            chain = chain | ok
    near = a.join(b, ["k", "key"]).where("u < v").where(chain).where(F.bit_count(x) <= max_bits).select("u", "v")
    if max_bits != 2:
        return near.distinct()

    many = shared.where(F.col("n") > crowd)
    free = [[bit for bit in range(BITS) if not (masks[i] | masks[j]) >> bit & 1] for i, j in pairs]
    one_bit = [1 << bit if bit < BITS - 1 else -(1 << (BITS - 1)) for bit in range(BITS)]
    flips = F.element_at(F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(one_bit[bit]).cast("long") for bit in row])
                                   for row in free]), F.col("k") + 1)
    points = many.select("k", "key", "fp", F.explode(flips).alias("flip"))
    points = points.select("k", "key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    meet = points.withColumn("u", F.min("fp").over(Window.partitionBy("k", "point")))
    stars = meet.where("u < fp").select("u", F.col("fp").alias("v"))
    return near.unionByName(stars).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(id, fp, component_id): one row per input row.

    component_id is the smallest id reachable over links of at most
    ``max_bits`` differing bits, the row's own included.  Rows without a word
    have fingerprint 0 and link like others; a null id is returned as such and
    never names a component, unless the component has no other id (null then).
    Exact copies meet in one fingerprint before any candidate search, so a
    group of copies of any size costs one row there."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min(id_col).alias("least_id"))
    comps = components(links(distinct.select("fp"), max_bits))
    rooted = distinct.join(comps.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = cut(rooted.withColumn("root", F.coalesce("root", "fp")), "roots")
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rows.join(rooted.join(ids, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One document of every group, all columns unchanged: the one with the smallest id.

    Every row is grouped by its own text, whatever its id: rows that repeat an
    id are told apart by a running number, written once with the rows, and rows
    without an id come after those with one.  Of rows with the same id in a
    group the first number stays."""
    # the input's columns travel as one struct, so none can clash with the number
    stored = cut(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    doc_id, text = F.col("doc").getField(id_col), F.col("doc").getField(text_col)
    number = F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), F.col("row").alias("row"))
    groups = simhash_groups(stored.select(number.alias("number"), text.alias("text")), "number", "text", shingle, max_bits)
    kept = groups.where("number.row = component_id.row").select(F.col("number.row").alias("row"))
    return stored.join(kept, "row", "left_semi").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def hex_fingerprint(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
