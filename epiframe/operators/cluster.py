"""K-means over entity-level features (M2, M3).

``lloyd`` (default) is deterministic and independent of partitioning:
seeds are the rows at ranks floor((2i+1)n/(2k)) in the order (features,
entity) — found with an exact distributed rank, not a one-task sort —
then rounds, until no centre moves, of: squared distance to each centre,
argmin (ties to the lowest centre id), mean per label.  A centre that loses
all members keeps its position.  Features, centres and distances are
rounded to 9 places so summation order cannot flip a tie.  Only the k
centres (k <= 10) travel to the driver between rounds, like any k-means.

Labels are canonical: 0..k-1 by ascending centre (first feature, then
second).  The features frame is written to the shared checkpoint folder
before iterating, so a lost executor does not replay the lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from epiframe.operators.guards import require_columns
from epiframe.operators.ranking import global_row_number
from epiframe.operators.regression import log_features, standardise
from epiframe.session import materialise

PLACES = 9
K_MIN, K_MAX = 2, 10


def features(totals: DataFrame, entity: str = "country_region",
             columns: tuple[str, str] = ("total_cases", "total_deaths")) -> DataFrame:
    """P17 + M1: (entity, f0, f1) = standardised ln(1+x), rounded to 9 places;
    rows with a missing feature are dropped.  Writes the entity-level log
    totals to the shared folder (one job)."""
    require_columns(totals, entity, *columns)
    logged = log_features(totals, {"f0": columns[0], "f1": columns[1]}).select(entity, "f0", "f1").dropna()
    # Standardising reads its input twice (statistics, then rows): store the
    # entity-level values once rather than recomputing them from the facts.
    return standardise(materialise(logged, "kmeans_logged"), ["f0", "f1"], PLACES)


def seed_ranks(n: int, k: int) -> list[int]:
    return [((2 * i + 1) * n) // (2 * k) for i in range(k)]


def seeds(feats: DataFrame, k: int, entity: str = "country_region") -> list[tuple[float, float]]:
    """Centres at the quantile ranks of the (f0, f1, entity) order."""
    n = feats.count()
    if n == 0:
        return []
    ranks = seed_ranks(n, k)
    ranked = global_row_number(feats, ["f0", "f1", entity], "_rank")
    rows = ranked.filter(F.col("_rank").isin(ranks)).select("_rank", "f0", "f1").collect()
    by_rank = {r["_rank"]: (r["f0"], r["f1"]) for r in rows}
    return [by_rank[r] for r in ranks]


def _distances(centres: list[tuple[float, float]]) -> list[Column]:
    return [F.round((F.col("f0") - F.lit(c0)) * (F.col("f0") - F.lit(c0))
                    + (F.col("f1") - F.lit(c1)) * (F.col("f1") - F.lit(c1)), PLACES)
            for c0, c1 in centres]


def assign(feats: DataFrame, centres: list[tuple[float, float]], out: str = "cluster") -> DataFrame:
    """Nearest centre per row; ties go to the lowest centre id."""
    d = _distances(centres)
    best = F.least(*d) if len(d) > 1 else d[0]
    label = F.lit(None).cast("int")
    for j in reversed(range(len(d))):
        label = F.when(d[j] == best, F.lit(j)).otherwise(label)
    return feats.withColumn(out, label)


def update(assigned: DataFrame, centres: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """New centre = mean of members (9 places); empty clusters keep theirs."""
    rows = (assigned.groupBy("cluster")
            .agg(F.round(F.avg("f0"), PLACES).alias("c0"), F.round(F.avg("f1"), PLACES).alias("c1"))
            .collect())
    means = {r["cluster"]: (r["c0"], r["c1"]) for r in rows}
    return [means.get(j, c) for j, c in enumerate(centres)]


def canonical(centres: list[tuple[float, float]]) -> dict[int, int]:
    order = sorted(range(len(centres)), key=lambda j: (centres[j][0], centres[j][1], j))
    return {old: new for new, old in enumerate(order)}


def lloyd(feats: DataFrame, k: int = 3, max_rounds: int = 1000, entity: str = "country_region"):
    """Returns (labels DataFrame(entity, f0, f1, cluster), final centres), at
    the fixed point: rounds go on until no centre moves.  Not reaching it
    within ``max_rounds`` is an error, never a silent cut."""
    if not K_MIN <= k <= K_MAX:
        raise ValueError(f"k must be in [{K_MIN}, {K_MAX}], got {k}")
    feats = materialise(feats, "kmeans_features")
    centres = seeds(feats, k, entity)
    if not centres:
        return assign(feats, [(0.0, 0.0)]).limit(0), []
    for _ in range(max_rounds):
        new = update(assign(feats, centres), centres)
        if new == centres:
            break
        centres = new
    else:
        raise RuntimeError(f"centres still move after {max_rounds} rounds")
    relabel = canonical(centres)
    mapping = F.create_map(*[F.lit(x) for kv in relabel.items() for x in kv])
    labelled = assign(feats, centres).withColumn("cluster", mapping[F.col("cluster")].cast("int"))
    return labelled, [centres[old] for old, _ in sorted(relabel.items(), key=lambda kv: kv[1])]


def one_step(feats: DataFrame, k: int, entity: str = "country_region") -> DataFrame:
    """One assignment from the quantile seeds and the resulting update:
    (cluster, members, c0, c1) per seed id."""
    centres = seeds(feats, k, entity)
    assigned = assign(feats, centres)
    return (assigned.groupBy("cluster")
            .agg(F.count(F.lit(1)).alias("members"),
                 F.round(F.avg("f0"), PLACES).alias("c0"), F.round(F.avg("f1"), PLACES).alias("c1")))

