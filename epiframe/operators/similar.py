"""Nearest names by edit distance (J4: what a name that has no match was meant to be).

A similarity join without comparing all pairs: two strings at most k edits apart
share one of their k * q + 1 rarest q-grams, as an edit changes at most q of
them (prefix filter).  That needs more than k * q q-grams on both sides; pairs with a
short string meet in a string that is left after at most k deletions from each.
Candidates are checked by their true edit distance.  Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from epiframe.session import materialise

_PAD = "\u0001"


def _grams(name: Column, q: int) -> Column:
    """The q-grams of a string padded on both sides, each with its number among equal ones."""
    padded = F.concat(F.lit(_PAD * (q - 1)), name, F.lit(_PAD * (q - 1)))
    return F.transform(F.sequence(F.lit(1), F.char_length(name) + (q - 1)), lambda i: F.substring(padded, i, F.lit(q)))


def _deletions(name: Column, edits: int) -> Column:
    """The strings left after up to ``edits`` deletions."""
    out = F.array(name)
    for _ in range(edits):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, lambda s: F.transform(
            F.sequence(F.lit(0), F.char_length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i), F.substring(s, i + 2, F.char_length(s))))))))
    return out


def _keys(names: DataFrame, order: DataFrame, edits: int, q: int) -> DataFrame:
    """(name, key): what a name can meet its neighbours in."""
    least = edits * q - q + 1  # longest string with no more than edits * q q-grams
    size = F.char_length("name")
    # a q-gram that occurs again in a string is another one
    grams = names.where(size > least).select("name", F.posexplode(_grams(F.col("name"), q)).alias("at", "gram"))
    grams = grams.withColumn("again", F.row_number().over(Window.partitionBy("name", "gram").orderBy("at")))
    ranked = grams.join(order, ["gram", "again"]).withColumn(
        "rank", F.row_number().over(Window.partitionBy("name").orderBy("n", "gram", "again")))
    prefix = ranked.where(F.col("rank") <= edits * q + 1).select("name", F.concat_ws(_PAD, F.lit("q"), "gram", "again").alias("key"))
    short = names.where(size <= least + edits).select("name", F.explode(_deletions(F.col("name"), edits)).alias("left"))
    return prefix.unionByName(short.select("name", F.concat(F.lit("d" + _PAD), "left").alias("key")))


def similar_pairs(left: DataFrame, right: DataFrame, edits: int = 2, q: int = 2) -> DataFrame:
    """(l, r, distance): every pair of different values of the one column of ``left``
    and that of ``right`` that is at most ``edits`` edits apart, once; NULLs pair with nothing."""
    sides = [materialise(df.select(F.col(f"`{df.columns[0]}`").alias("name")).where("name is not null").distinct(), "names") for df in (left, right)]
    everything = sides[0].unionByName(sides[1]).distinct()
    grams = everything.select("name", F.posexplode(_grams(F.col("name"), q)).alias("at", "gram"))
    grams = grams.withColumn("again", F.row_number().over(Window.partitionBy("name", "gram").orderBy("at")))
    order = materialise(grams.groupBy("gram", "again").agg(F.count(F.lit(1)).alias("n")), "grams")
    l, r = (_keys(side, order, edits, q) for side in sides)
    met = l.withColumnRenamed("name", "l").join(r.withColumnRenamed("name", "r"), "key")
    met = met.where(F.abs(F.char_length("l") - F.char_length("r")) <= edits).select("l", "r").distinct()
    return met.withColumn("distance", F.levenshtein("l", "r", edits)).where("distance >= 0")


def nearest_names(left: DataFrame, right: DataFrame, edits: int = 2, q: int = 2) -> DataFrame:
    """(name, nearest, distance) for every different non-null value of the one column of ``left``:
    the value of ``right`` with the fewest edits (ties: the smallest), NULL where
    none is within ``edits``."""
    best = similar_pairs(left, right, edits, q).groupBy("l").agg(F.min(F.struct("distance", "r")).alias("best"))
    names = left.select(F.col(f"`{left.columns[0]}`").alias("name")).where("name is not null").distinct()
    return names.join(best, names["name"] == best["l"], "left").select("name", F.col("best.r").alias("nearest"), F.col("best.distance").alias("distance"))
