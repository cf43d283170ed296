"""Co-moments of all column pairs in one pass.

A task turns each batch of rows into a matrix and adds its products to five
columns x columns sums, so it holds and sends a number of sums that depends on
the columns only; Spark adds these up per pair.  Rows are never expanded into
pairs.  Matrix products have no built-in form, which is why this runs in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SUMS = ["n", "si", "sj", "qi", "qj", "c", "odd"]
#: A side whose variance is below this share of its mean square distance from the
#: column's centre counts as constant: so much is lost to rounding.
CONSTANT = 1e-12


def pair_sums(rows: DataFrame, centre: list[float], cells: int = 1 << 21) -> DataFrame:
    """(i, j, n, si, sj, qi, qj, c, odd) for every pair i < j of the positions of the
    one array column of ``rows`` (NULL elements allowed): over the rows where both
    are there, how many, the sums and sums of squares of each side, of their
    products, and how many infinite values.  ``centre`` (near each mean) is
    subtracted first, which keeps the sums small."""
    p = len(centre)
    shift = np.asarray(centre, float)
    upper = np.triu_indices(p, 1)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q, c, odd = np.zeros((5, p, p))
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            for at in range(0, len(flat), max(1, cells // p)):
                x = flat[at:at + max(1, cells // p)]
                there = ~np.isnan(x)
                infinite = np.isinf(x)
                x = np.where(there & ~infinite, x - shift, 0.0)
                m = there.astype(float)
                n += m.T @ m
                s += x.T @ m
                q += (x * x).T @ m
                c += x.T @ x
                odd += infinite.T.astype(float) @ m
        sums = [n[upper], s[upper], s.T[upper], q[upper], q.T[upper], c[upper], (odd + odd.T)[upper]]
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)) for a in upper] + [pa.array(a) for a in sums], ["i", "j", *SUMS])

    each = rows.mapInArrow(summed, "i int, j int, " + ", ".join(f"{c} double" for c in SUMS))
    return each.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in SUMS])


def correlation() -> Column:
    """Pearson's coefficient from ``pair_sums``; NULL without rows, where a side is
    constant, or where an infinite value takes part."""
    n, si, sj, qi, qj, c, odd = (F.col(x) for x in SUMS)
    vi, vj = qi - F.try_divide(si * si, n), qj - F.try_divide(sj * sj, n)
    r = F.try_divide(c - F.try_divide(si * sj, n), F.sqrt(vi) * F.sqrt(vj))
    return F.when((n > 0) & (odd == 0) & (vi > CONSTANT * qi) & (vj > CONSTANT * qj), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
