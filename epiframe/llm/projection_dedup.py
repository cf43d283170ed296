"""Embedding near-duplicates by sorted projection passes.

Each pass sorts the vectors by the concatenated signs of random projections
and compares every vector with a window of its neighbours in that order and
with its whole run, the vectors that share its first signs, however long.
The number of passes follows from the number of vectors (``schedule``).
Verified pairs of all passes are joined into components."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from epiframe.llm.common import components, cut
from epiframe.llm.vectors import usable

HASHES = 62


def schedule(n: int, least: float, window: int, recall: float) -> tuple[int, int]:
    """(bits, passes) for ``n`` vectors: the signs a run shares, and how many passes.

    Two vectors at the angle acos(least) agree in one sign with probability
    p = 1 - acos(least) / pi, so they share a run of ``bits`` signs with
    p ** bits, whatever the other vectors are, and miss each other in all passes
    with (1 - p ** bits) ** passes, which is to be at most 1 - recall.
    bits = ceil(log2(n / window)): runs of scattered vectors are no longer than
    the window.  Closer pairs are found more surely."""
    p = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi
    bits = min(HASHES, math.ceil(math.log2(n / window))) if n > window and p > 0 else 0
    meet = p ** bits
    return bits, 1 if meet >= 1 else math.ceil(math.log1p(-recall) / math.log1p(-meet))


def projections(dim: int, passes: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, passes * HASHES))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths, in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def ranks(vectors: DataFrame, passes: int, seed: int, bits: int = 0) -> DataFrame:
    """(rep, places, runs): the place of each vector in the order of every pass
    (from 0, ties by rep), and its first ``bits`` signs there.

    Sorted by range, so places are exact at any size: the partition number is
    stored with the sorted rows, then the rows before each partition are added."""
    def sign_keys(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pa.compute.list_value_length(batch.column(1)).to_numpy()
            for dim in np.unique(sizes):
                some = np.flatnonzero(sizes == dim)
                part = batch.take(pa.array(some))
                bits = (matrix(part.column(1)) @ projections(int(dim), passes, seed)) > 0
                weights = 1 << np.arange(HASHES, dtype=np.int64)[::-1]
                keys = bits.reshape(len(some), passes, HASHES) @ weights
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column(0).to_numpy(), passes)),
                     pa.array(np.full(len(some) * passes, dim, np.int32)),
                     pa.array(np.tile(np.arange(passes, dtype=np.int32), len(some))), pa.array(keys.ravel())],
                    names=["rep", "dim", "pass", "key"])

    import pyarrow.compute  # noqa: F401  (pa.compute above)
    rows = vectors.select("rep", "vector").mapInArrow(sign_keys, "rep long, dim int, pass int, key long")
    rows = rows.repartitionByRange("dim", "pass", "key", "rep").withColumn("part", F.spark_partition_id())
    rows = cut(rows, "sorted")
    each = rows.groupBy("part", "dim", "pass").agg(F.count("*").alias("n"))
    before = Window.partitionBy("dim", "pass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("part", "dim", "pass", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part", "dim", "pass").orderBy("key", "rep"))
    placed = rows.withColumn("n", inside).join(each, ["part", "dim", "pass"])
    placed = placed.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct(  # one per pass
        "pass", (F.col("before") + F.col("n") - 1).alias("place"),
        F.shiftright("key", HASHES - bits).alias("run")))).alias("p"))
    return placed.select("rep", F.col("p.place").alias("places"), F.col("p.run").alias("runs"))


def compare_block(home: np.ndarray, other: np.ndarray, unit: np.ndarray, places: np.ndarray, runs: np.ndarray, which: int,
                  window: int, least: float, far: bool, cells: int = 1 << 20):
    """Yields (row, col, new) for slices of the home rows: the linked pairs (home row, other row) of this
    pass, ``far`` ones beyond the window or those within it, and which of them no earlier pass compared."""
    step = max(1, cells // max(len(other), 1))
    for start in range(0, len(home), step):
        at = home[start:start + step]
        gap = places[None, other, which] - places[at, None, which]
        within = gap > window if far else (gap > 0) & (gap <= window)
        row, col = np.nonzero((unit[at] @ unit[other].T >= least) & within)
        row, col = at[row], other[col]
        new = np.arange(len(row))
        for q in range(which):
            u, v = row[new], col[new]
            new = new[(np.abs(places[u, q] - places[v, q]) > window) & (runs[u, q] != runs[v, q])]
        yield row, col, new


def spanning_labels(label: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """``label`` (the smallest index known of each row's component) after more pairs, by repeated minimum."""
    row, col = np.concatenate([row, np.arange(len(label))]), np.concatenate([col, label])
    while True:
        new = label.copy()
        np.minimum.at(new, row, label[col])
        np.minimum.at(new, col, label[row])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9,
                    passes: int | None = None, window: int = 1024, seed: int = 1, recall: float = 0.999) -> DataFrame:
    """(id, n_links, component_id, kept): one row per input row.

    Links are pairs with cosine >= ``least`` in double precision that, in some
    pass, are within ``window`` places of each other or in one run; n_links
    counts a row's, component_id is the smallest id reachable.  A pair at
    ``least`` is found with probability ``recall`` or more at any number of rows
    and whatever they are (see ``schedule``), unless ``passes`` is given; up to
    ``window`` distinct vectors every pair is compared.  Equal vectors form one
    class first, so copies of a vector cost one row in the passes and are all
    linked.  Rows whose vector is null, empty, zero or not finite, and vectors
    of different lengths, link with nothing.  A repeated id with the same
    vector counts as another vector.

    A block of ``window`` rows and its successor are compared in one task as
    matrices, and what a run has beyond the window in pairs of tiles of
    4 x ``window`` rows, a task each: memory is bounded, pairs are counted where
    they are found, each in the first pass that compares it, and only one edge
    per row and block leaves the task, never all pairs of a group."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    good = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    # rep is a running number of the class; written once, so it stays the same.
    classes = good.groupBy("vector").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    bits, enough = schedule(classes.count(), least, window, recall)
    passes = enough if passes is None else passes
    placed = cut(classes.drop("least_id").join(ranks(classes, passes, seed, bits), "rep"), "placed")
    placed = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("dim", F.size("vector"))
    place, run = F.element_at("places", F.col("pass") + 1), F.element_at("runs", F.col("pass") + 1)
    block = F.floor(place / window)
    near = placed.withColumn("start", F.lit(-1).cast("long")).withColumn("lo", F.explode(F.array(block, block - 1)))
    near = near.where("lo >= 0").withColumn("hi", F.col("lo") + 1).withColumn("home", F.col("lo") == block)

    # Runs longer than the window, one row per block they touch, so that a hot run joins by many keys.
    long = placed.groupBy("dim", "pass", run.alias("run")).agg(F.min(place).alias("start"), F.count("*").alias("n"))
    long = long.where(F.col("n") > window + 1).withColumn("block", F.explode(F.sequence(
        F.floor(F.col("start") / window), F.floor((F.col("start") + F.col("n") - 1) / window))))
    tile, tiles = F.floor((place - F.col("start")) / (4 * window)), F.ceil(F.col("n") / (4 * window))
    far = placed.withColumn("block", block).withColumn("run", run).join(long, ["dim", "pass", "block", "run"])
    far = far.withColumn("tile", tile).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    far = far.withColumn("lo", F.least("tile", "with")).withColumn("hi", F.greatest("tile", "with"))
    far = far.withColumn("home", F.col("tile") == F.col("lo")).select(near.columns)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        x = np.array(group["vector"].tolist(), np.float64)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        places, runs = (np.array(group[c].tolist(), np.int64) for c in ("places", "runs"))
        copies, is_home, rep = group["copies"].to_numpy(), group["home"].to_numpy(), group["rep"].to_numpy()
        which, is_far = int(group["pass"].iloc[0]), bool(group["start"].iloc[0] >= 0)
        home = np.flatnonzero(is_home)
        other = np.flatnonzero(~is_home) if is_far and not is_home.all() else np.arange(len(x))
        n, label = np.zeros(len(x)), np.arange(len(x))
        for row, col, new in compare_block(home, other, unit, places, runs, which, window, least, is_far):
            n += np.bincount(row[new], copies[col[new]], len(x)) + np.bincount(col[new], copies[row[new]], len(x))
            label = spanning_labels(label, row, col)
        root = rep[label]
        out = (root != rep) | (n > 0)
        return pd.DataFrame({"rep": rep[out], "root": root[out], "n": n[out].astype(np.int64)})

    found = near.unionByName(far).groupBy("dim", "pass", "start", "lo", "hi")
    found = cut(found.applyInPandas(compare, "rep long, root long, n long"), "links")
    comps = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    known = (classes.join(links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
             .withColumn("root", F.coalesce("root", "rep")))
    least_ids = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = known.join(least_ids, "root").select(F.col("vector").alias("_vector"), "component_id",
                                                 (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.join(known, F.when(F.col("id").isNotNull() & usable(F.col("vector")), F.col("vector")) == F.col("_vector"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), (F.col("id") == component).alias("kept"))
