import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from epiframe.llm.common import cut
from epiframe.llm import hnsw as H, projection_dedup as D

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, ROWS)


def brute_links(x, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= least
    np.fill_diagonal(s, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min([label[i], *label[s[i]]]) for i in range(len(x))])
        if (new == label).all():
            return s.sum(axis=1), label
        label = new


def clusters(rng, groups, size, dim=32, noise=0.05):
    x = []
    for _ in range(groups):
        c = rng.standard_normal(dim)
        c /= np.linalg.norm(c)
        x += [c + noise * rng.standard_normal(dim) / np.sqrt(dim) * 5 for _ in range(rng.integers(1, size))]
    return np.array(x, np.float32).astype(float)


def test_dedup_matches_brute_force(spark):
    x = clusters(np.random.default_rng(1), 60, 12)
    n, label = brute_links(x, 0.9)
    rows = sorted(D.near_duplicates(table(spark, x), window=64, passes=6).collect())
    assert [r["n_links"] for r in rows] == n.tolist()
    assert [r["component_id"] for r in rows] == label.tolist()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)


def test_small_windows_never_count_a_pair_twice(spark):
    x = clusters(np.random.default_rng(2), 3, 60)
    n, label = brute_links(x, 0.9)
    rows = sorted(D.near_duplicates(table(spark, x), window=8, passes=5).collect())
    assert all(r["n_links"] <= k for r, k in zip(rows, n))
    assert np.mean([r["component_id"] == c for r, c in zip(rows, label)]) > 0.95


def test_runs_beyond_the_window_are_compared_whole(spark):
    rng = np.random.default_rng(7)
    centre = rng.standard_normal(64) / 8
    x = np.vstack([centre + 0.295 * rng.standard_normal((400, 64)) / 8, rng.standard_normal((800, 64)) / 8])
    x = x.astype(np.float32).astype(float)
    n, label = brute_links(x, 0.9)
    assert n.sum() > 100_000
    rows = sorted(D.near_duplicates(table(spark, x), window=64).collect())
    got = np.array([r["n_links"] for r in rows])
    assert (got <= n).all() and got.sum() >= 0.999 * n.sum()
    assert [r["component_id"] for r in rows] == label.tolist()


def test_passes_grow_with_the_table(spark):
    assert [D.schedule(n, 0.9, 1024, 0.999) for n in (0, 1000, 20_000, 10**6)] == [(0, 1), (0, 1), (5, 12), (10, 29)]
    rng = np.random.default_rng(8)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((3000, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.905 * a + np.sqrt(1 - 0.905**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x = np.vstack([a, b]).astype(np.float32).astype(float)
    rows = D.near_duplicates(table(spark, x), window=128).where("vec_id >= 3000").collect()
    assert np.mean([r["component_id"] == r["vec_id"] - 3000 for r in rows]) >= 0.997


def test_dedup_edges(spark):
    a, b = [1.0, 0, 0, 0], [0, 1.0, 0, 0]
    vectors = [a, a, [2.0, 0, 0, 0], b, None, [], [0.0] * 4, [float("nan"), 1, 0, 0], [float("inf"), 1, 0, 0], [None, 1, 0, 0], [1.0, 0]]
    df = table(spark, [*vectors, a, b, b], [5, 3, 4, *range(10, 18), None, 10, 20]).withColumn("rep", F.lit(1)).withColumn("n", F.lit("x"))
    got = {}
    for r in D.near_duplicates(df).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert got[3] == [(2, 3, True)] and got[4] == [(2, 3, False)] and got[5] == [(2, 3, False)]
    assert got[10] == [(2, 10, True)] * 2 and got[20] == [(2, 10, False)]  # a repeated row is one more vector
    assert all(got[i] == [(0, i, True)] for i in range(11, 18))
    assert got[None] == [(0, None, None)]
    assert D.near_duplicates(table(spark, [])).collect() == []


def test_ranks_are_exact(spark):
    x = np.random.default_rng(3).standard_normal((3000, 8)).astype(np.float32).astype(float)
    df = table(spark, x).select(F.col("vec_id").alias("rep"), F.col("embedding").alias("vector")).repartition(8)
    places = {r["rep"]: r["places"] for r in D.ranks(df, 2, 7).collect()}
    bits = (x @ D.projections(8, 2, 7) > 0).reshape(len(x), 2, D.HASHES)
    for p in range(2):
        order = sorted(range(len(x)), key=lambda i: (bits[i, p].tolist(), i))
        assert all(places[i][p] == k for k, i in enumerate(order))


def brute_nearest(x, ids, q, k):
    s = x @ x[q]
    order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
    return [int(ids[i]) for i in order]


@pytest.mark.parametrize("n,shard_rows", [(3000, 700), (40, 10)])
def test_nearest_recall_and_exact_scores(spark, n, shard_rows):
    x = np.random.default_rng(4).standard_normal((n, 24)).astype(np.float32).astype(float)
    df, ids = table(spark, x), np.arange(n)
    rows = H.nearest(H.index(df, shard_rows=shard_rows, k=10), df.where("vec_id % 20 = 0"), k=10).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r)
    assert sorted(found) == list(range(0, n, 20))
    hits = 0
    for q, rs in found.items():
        assert [r["rank"] for r in rs] == list(range(1, 11))
        assert all(r["score"] == pytest.approx(x[q] @ x[r["vec_id"]], abs=1e-12) for r in rs)
        assert [(-r["score"], r["vec_id"]) for r in rs] == sorted((-r["score"], r["vec_id"]) for r in rs)
        hits += len(set(brute_nearest(x, ids, q, 10)) & {r["vec_id"] for r in rs})
    assert hits >= 0.95 * 10 * len(found)


def test_nearest_with_unequal_norms(spark):
    x = np.random.default_rng(5).standard_normal((2000, 16)) * np.random.default_rng(6).lognormal(0, 0.7, (2000, 1))
    x = x.astype(np.float32).astype(float)
    df, ids = table(spark, x), np.arange(len(x))
    rows = H.nearest(H.index(df, k=10), df.where("vec_id % 20 = 0"), k=10).collect()
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(set(brute_nearest(x, ids, q, 10)) & v) for q, v in found.items())
    assert hits >= 0.9 * 10 * len(found)


def test_nearest_edges(spark):
    a, b = [1.0, 0, 0], [0.5, 0.5, 0]
    vectors = [a] * 30 + [b, None, [], [0.0] * 3, [float("nan"), 1, 0], [None, 1, 0], [1.0, 0]]
    df = table(spark, vectors).withColumn("dim", F.lit("clash")).withColumn("rank", F.lit(0))
    stored = H.index(df, k=5)
    rows = sorted(tuple(r) for r in H.nearest(stored, df.where("vec_id in (0, 29, 30, 31, 33, 36)"), k=5).collect())
    assert [r[2] for r in rows if r[0] == 0] == [1, 2, 3, 4, 5]  # equal scores: smaller ids first, not itself
    assert [r[2] for r in rows if r[0] == 29] == [0, 1, 2, 3, 4]
    assert [r[3] for r in rows if r[0] == 30] == [0.5] * 5
    assert not [r for r in rows if r[0] in (31, 33, 36)]  # nothing else of that length
    few = table(spark, [a, b, a])
    assert len(H.nearest(H.index(few), few.where("vec_id = 0")).collect()) == 2
    twice = few.unionByName(few)
    assert [tuple(r)[2] for r in H.nearest(H.index(twice), few.where("vec_id = 0")).orderBy("rank").collect()] == [2, 1]
    empty = table(spark, [])
    assert H.nearest(H.index(empty), empty).collect() == []


@pytest.mark.parametrize("share,noise,dim", [(0.6, 0.03, 64), (1 / 3, 0.2, 64), (0.1, 0.03, 64), (0.0, 0.0, 256)])
def test_recall_of_the_hot_group_and_of_the_rest(spark, share, noise, dim):
    """Production parameters on two shards: a group of near copies hides nothing."""
    rng = np.random.default_rng(int(share * 100) + dim)
    n, k = 12_000, 20
    x, hot = rng.standard_normal((n, dim)), rng.random(n) < share
    x[hot] = rng.standard_normal(dim) + noise * rng.standard_normal((hot.sum(), dim))
    x = x.astype(np.float32).astype(float)
    df = table(spark, x).repartition(4)
    stored = cut(H.index(df, k=k), "hnsw")
    found = {}
    for r in H.nearest(stored, df.where("vec_id % 40 = 0"), k=k).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    share_found = np.array([len(set(brute_nearest(x, np.arange(n), q, k)) & found[q]) / k for q in range(0, n, 40)])
    groups = [hot[::40], ~hot[::40]]
    assert all(share_found[g].mean() >= 0.95 for g in groups if g.any())


def test_a_shard_whose_graph_misses_is_compared_whole():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    layers = H.build(x)
    assert H.tuned(layers, x, 20) in (128, 256, 512)
    lost = [np.full_like(layer, -1) for layer in layers]  # no links: only the entry is found
    assert H.tuned(lost, x, 20) == 0
    members = [[i] for i in range(len(x))]
    rows = list(H._look(x.astype(float), lost, members, 0, x[:5].astype(float), np.arange(5), 20))[0]
    for q in range(5):
        assert rows[rows["query_id"] == q]["vec_id"].tolist() == brute_nearest(x.astype(float), np.arange(600), q, 20)
