"""Exact order statistics of many columns without moving rows.

A double has a 64-bit image: a whole number in the same order.  A pass over
the rows counts, per column, how many fall in each of the 2^16 values of the
next 16 bits, map-side; only these counts are shuffled, so an exchange holds at
most (column, quantile) pairs times 2^16 rows however many rows there are.  The
bucket with the wanted rank is kept and the next pass splits it.  Four passes
name the value; a bucket left with no more rows than there are buckets is
sorted instead.  What reaches the driver is one row per column and quantile.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, Window, functions as F

BITS, DIGIT = 64, 16
_FRACTION, _EXPONENTS = 52, 1023  # of a double: bits of the fraction, bias of the exponent


def image(x: Column) -> Column:
    """The 64-bit whole number that orders like the double: its IEEE bits for
    positive ones, minus those of the absolute value for negative ones.  Both
    zeros are 0; NULL stays NULL and NaN is NULL.

    There is no built-in function for the bits, so they are computed: dividing
    by a power of two is exact.  The exponent from the logarithm may be one off,
    which the two comparisons mend."""
    a, one = F.abs(x), F.lit(1)
    guess = F.floor(F.log2(a))
    power = F.pow(F.lit(2.0), guess.cast("double"))
    exponent = guess - F.when(power > a, one).otherwise(0) + F.when(power * 2 <= a, one).otherwise(0)
    scale = float(1 << _FRACTION)
    normal = ((exponent + (_EXPONENTS - 1)).cast("long") * F.lit(1 << _FRACTION)
              + (a / F.pow(F.lit(2.0), exponent.cast("double")) * scale).cast("long"))
    # below the least normal number the fraction has no leading one
    tiny = (a * 2.0 ** 537 * 2.0 ** 537).cast("long")
    bits = (F.when(a == 0, F.lit(0).cast("long")).when(a < 2.0 ** -1022, tiny)
            .when(a == float("inf"), F.lit((2 * _EXPONENTS + 1) << _FRACTION)).when(a < float("inf"), normal))
    return F.when(F.isnan(x), F.lit(None).cast("long")).when(x < 0, -bits).otherwise(bits)


def value(bits: int) -> float:
    """The double of an image."""
    return math.copysign(struct.unpack(">d", struct.pack(">q", abs(bits)))[0], bits)


def _images(df: DataFrame, columns: list[str]) -> DataFrame:
    """(_k, _i): column number and image of every non-null value."""
    each = F.array(*[F.struct(F.lit(k).alias("_k"), image(F.col(f"`{c}`").cast("double")).alias("_i")) for k, c in enumerate(columns)])
    return df.select(F.inline(each)).where(F.col("_i").isNotNull())


def order_statistics(df: DataFrame, columns: list[str], shares: dict[str, float], sort_up_to: int = 1 << DIGIT) -> list[dict[str, float | None]]:
    """For every column of ``columns`` the values at rank max(1, ceil(share * n)) of
    its n values (NULL and NaN are none): one dict per column, None where it has
    no value.  ``df`` is read once per pass, so it should be a stored table."""
    spark = df.sparkSession
    rows = _images(df, columns)
    # column -> {name: (prefix, rank inside it)}
    found: list[dict[str, float | None]] = [dict.fromkeys(shares) for _ in columns]
    if df.count() <= sort_up_to:
        total = F.count("*").over(Window.partitionBy("_k"))
        at = F.row_number().over(Window.partitionBy("_k").orderBy("_i"))
        names = F.array(*[F.struct(F.lit(n).alias("name"), _rank(F.col("_n"), p).alias("rank")) for n, p in shares.items()])
        placed = rows.select("_k", "_i", total.alias("_n"), at.alias("_at")).select("_k", "_i", "_at", F.inline(names))
        for r in placed.where("_at = rank").collect():
            found[r["_k"]][r["name"]] = value(r["_i"])
        return found

    targets = None  # rows (_k, name, prefix, rank, n): where each wanted value is, and beside how many others
    for left in range(BITS - DIGIT, -1, -DIGIT):
        prefix, digit = F.shiftright("_i", left + DIGIT), F.shiftright("_i", left)
        if targets is None:
            counts = rows.groupBy("_k", digit.alias("next")).agg(F.count("*").alias("n"))
            per = Window.partitionBy("_k")
            names = F.array(*[F.struct(F.lit(n).alias("name"), _rank(F.col("total"), p).alias("rank")) for n, p in shares.items()])
            wanted = counts.withColumn("total", F.sum("n").over(per))
            wanted = wanted.withColumn("before", F.sum("n").over(per.orderBy("next")) - F.col("n")).select("*", F.inline(names))
        else:
            keys = _targets(spark, targets).select("_k", "prefix").distinct()
            inside = rows.withColumn("prefix", prefix).join(F.broadcast(keys), ["_k", "prefix"])
            counts = inside.groupBy("_k", "prefix", digit.alias("next")).agg(F.count("*").alias("n"))
            before = F.sum("n").over(Window.partitionBy("_k", "prefix").orderBy("next")) - F.col("n")
            wanted = counts.withColumn("before", before).join(F.broadcast(_targets(spark, targets)), ["_k", "prefix"])
        hit = wanted.where("before < rank and rank <= before + n")
        targets = [(r["_k"], r["name"], r["next"], r["rank"] - r["before"], r["n"])
                   for r in hit.select("_k", "name", "next", "rank", "before", "n").collect()]
        if left and targets and max(t[4] for t in targets) <= sort_up_to:
            keys = _targets(spark, targets)
            inside = rows.withColumn("prefix", F.shiftright("_i", left)).join(F.broadcast(keys.select("_k", "prefix").distinct()), ["_k", "prefix"])
            at = F.row_number().over(Window.partitionBy("_k", "prefix").orderBy("_i"))
            placed = inside.withColumn("at", at).join(F.broadcast(keys), ["_k", "prefix"]).where("at = rank")
            targets = [(r["_k"], r["name"], r["_i"], 1, 1) for r in placed.collect()]
            break
    for k, name, bits, _, _ in targets or []:
        found[k][name] = value(bits)
    return found


def _rank(n: Column, share: float) -> Column:
    return F.greatest(F.ceil(n * F.lit(float(share))), F.lit(1))


def _targets(spark, targets: list[tuple]) -> DataFrame:
    """One row per column and quantile."""
    return spark.createDataFrame([t[:4] for t in targets], "_k int, name string, prefix long, rank long")
