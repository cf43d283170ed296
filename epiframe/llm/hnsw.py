"""Nearest neighbours by inner product: one navigable small-world graph per shard.

A graph has layers; layer 0 holds all vectors of the shard, each higher one a
random part of the one below.  A layer is a flat array of neighbour numbers
(one row per vector, -1 where there are fewer).  Searches go down from the top
layer; the results of all shards are merged."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from epiframe.llm.common import cut
from epiframe.llm.vectors import usable


def beam(layer: np.ndarray, x: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int):
    """(numbers, scores): up to ``ef`` nearest found from ``entry`` (queries x entries) for all queries in step, best first.

    Each step expands every query's best vector not yet expanded; a query ends
    when all it holds are."""
    b = len(queries)
    seen = np.zeros((b, len(layer)), bool)
    rows = np.arange(b)
    ids = np.full((b, ef), -1, np.int32)
    score = np.full((b, ef), -np.inf, np.float32)
    done = np.ones((b, ef), bool)

    def add(at, new):
        """Adds numbers (-1 for none) to the pools of queries ``at``."""
        ok = (new >= 0) & ~seen[at[:, None], new]
        new = np.where(ok, new, -1)
        r, c = np.nonzero(ok)
        seen[at[r], new[r, c]] = True
        s = np.full(new.shape, -np.inf, np.float32)
        s[r, c] = np.einsum("ij,ij->i", x[new[r, c]], queries[at[r]])
        all_ids = np.hstack([ids[at], new])
        all_score = np.hstack([score[at], s])
        all_done = np.hstack([done[at], ~ok])
        best = np.argsort(-all_score, axis=1, kind="stable")[:, :ef]
        ids[at], score[at], done[at] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_score, all_done))

    for column in entry.T:  # one at a time: entries may repeat
        add(rows, column[:, None])
    active = rows
    while len(active):
        open_ = ~done[active]
        more = open_.any(axis=1)
        active = active[more]
        if not len(active):
            break
        pick = open_[more].argmax(axis=1)
        done[active, pick] = True
        add(active, layer[ids[active, pick]])
    return ids, score


def choose(x: np.ndarray, node: np.ndarray, cand: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
    """Up to ``m`` neighbours per node: nearest first, each nearer to the node
    than to any chosen before; free places go to the nearest left out.  Nearness
    is the inner product itself, so that vectors of large norm, which are near
    to many queries, are linked from everywhere."""
    order = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    v = x[np.maximum(cand, 0)]
    mutual = np.einsum("bid,bjd->bij", v, v)
    n, width = cand.shape
    taken, count = np.zeros((n, width), bool), np.zeros(n, np.int64)
    for i in range(width):
        near = np.where(taken[:, :i], mutual[:, i, :i], -np.inf).max(axis=1, initial=-np.inf)
        ok = (cand[:, i] >= 0) & np.isfinite(sim[:, i]) & (sim[:, i] > near) & (count < m)
        taken[:, i] = ok
        count += ok
    valid = (cand >= 0) & np.isfinite(sim)
    prefer = np.argsort(np.where(taken, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :m]
    out = np.where(np.take_along_axis(valid, prefer, 1), np.take_along_axis(cand, prefer, 1), -1)
    if out.shape[1] < m:
        out = np.hstack([out, np.full((n, m - out.shape[1]), -1, out.dtype)])
    return out.astype(np.int32)


def _link_back(layer: np.ndarray, x: np.ndarray, nodes: np.ndarray) -> None:
    """Adds the new nodes to their neighbours' rows; a full row keeps its nearest."""
    m = layer.shape[1]
    to = layer[nodes].ravel()
    src = np.repeat(nodes, m)
    src, to = src[to >= 0], to[to >= 0]
    hit = np.unique(to)
    old = layer[hit]
    r, c = np.nonzero(old >= 0)
    owner = np.concatenate([hit[r], to])
    other = np.concatenate([old[r, c], src])
    pair = np.unique(owner.astype(np.int64) << 32 | other)
    owner, other = pair >> 32, pair & 0xFFFFFFFF
    sim = np.einsum("ij,ij->i", x[owner], x[other])
    order = np.lexsort((other, -sim, owner))
    owner, other = owner[order], other[order]
    first = np.concatenate(([True], owner[1:] != owner[:-1]))
    place = np.arange(len(owner)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    keep = place < m
    layer[hit] = -1
    layer[owner[keep], place[keep]] = other[keep]


def build(x: np.ndarray, m: int = 16, ef: int = 64, seed: int = 1, batch: int = 512) -> list[np.ndarray]:
    """The layers, highest first, of vectors ``x`` (float32) by inner product.  A layer of n rows holds the first n vectors.

    Vectors are in random order, so a prefix is a random part.  Layers are
    built from the top, each by batches that search what is there and one
    another, and at most double it."""
    n = len(x)
    sizes = [n]
    while sizes[-1] > 2 * m:
        sizes.append(-(-sizes[-1] // m))
    layers: list[np.ndarray] = []
    for size in reversed(sizes):
        width = 2 * m if size == n else m
        layer = np.full((size, width), -1, np.int32)
        have = 0
        while have < size:
            new = np.arange(have, min(size, have + min(batch, max(have, 2 * m))))
            own = x[new] @ x[new].T
            np.fill_diagonal(own, -np.inf)
            top = np.argsort(-own, axis=1, kind="stable")[:, :min(width, len(new))]
            cand, sim = new[top].astype(np.int32), np.take_along_axis(own, top, 1)
            if have:
                ids, score = search(layers + [layer[:have]], x, x[new], ef)
                cand, sim = np.hstack([ids, cand]), np.hstack([score, sim])
            layer[new] = choose(x, new, cand, sim, width)
            _link_back(layer, x, new)
            have = int(new[-1]) + 1
        layers.append(layer)
    return layers


def search(layers: list[np.ndarray], x: np.ndarray, queries: np.ndarray, ef: int):
    """(numbers, scores) of up to ``ef`` nearest found per query, best first."""
    entry = np.zeros((len(queries), 1), np.int32)
    for layer in layers[:-1]:
        ids, _ = beam(layer, x, queries, entry, 4)
        entry = np.where(ids[:, :2] < len(layers[-1]), ids[:, :2], 0)
    return beam(layers[-1], x, queries, entry, ef)


def tuned(layers: list[np.ndarray], x: np.ndarray, k: int, recall: float = 0.97, efs: tuple = (128, 256, 512), probes: int = 256) -> int:
    """The least of ``efs`` at which the graph finds what a comparison with all vectors
    does: of the ``k`` best of evenly picked members a share of ``recall`` on the
    whole, and of 0.9 over the tenth of them that fares worst (a small group
    that the graph does not lead to shows there).  0 if none does."""
    n = len(x)
    q = x[np.unique(np.linspace(0, n - 1, min(n, probes)).astype(int))]
    k = min(k, n)
    best = -np.sort(-(q @ x.T), axis=1)[:, :k]
    least = best[:, -1] - 1e-5 * np.abs(best).max(axis=1)  # equally near ones are as good
    for ef in efs:
        _, score = search(layers, x, q, max(ef, k))
        share = np.sort((score[:, :k] >= least[:, None]).mean(axis=1))
        if share.mean() >= recall and share[:max(1, len(share) // 10)].mean() >= 0.9:
            return ef
    return 0


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192, k: int = 20,
          m: int = 16, ef: int = 64) -> DataFrame:
    """The stored index, a row per shard: (dim, shard, members, vectors, layers, breadth).

    breadth is how many vectors a search of the shard keeps (see ``tuned``): as few
    as its own self-check allows, and 0 where none was enough, as in a shard that
    a group of near copies fills: such a shard is compared whole.

    Equal vectors are one entry that keeps its ``k`` + 1 smallest ids, which is
    all that a search for k can return.  Rows without an id, and vectors that
    are null, empty, zero or not finite, are left out; vectors of different
    lengths are in different shards.  A shard holds about ``shard_rows``
    entries by a hash, whatever the size of the table."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    entries = cut(few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")), "entries")
    shards = max(1, -(-entries.count() // shard_rows))
    spread = F.xxhash64(F.element_at("ids", 1), "vector")
    entries = entries.select(F.size("vector").alias("dim"), F.pmod(spread, F.lit(shards)).cast("int").alias("shard"),
                             spread.alias("order"), "ids", "vector")

    def make(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("order", kind="stable")
        x = np.array(group["vector"].tolist(), np.float64)
        layers = build(x.astype(np.float32), m, ef)
        return pd.DataFrame({"dim": [int(group["dim"].iloc[0])], "shard": [int(group["shard"].iloc[0])],
                             "members": [[list(i) for i in group["ids"]]], "vectors": [x.tobytes()],
                             "layers": [[y.tobytes() for y in layers]], "widths": [[y.shape[1] for y in layers]],
                             "breadth": [tuned(layers, x.astype(np.float32), k + 1)]})

    return entries.groupBy("dim", "shard").applyInPandas(
        make, "dim int, shard int, members array<array<long>>, vectors binary, layers array<binary>, widths array<int>, breadth int")


def nearest(index_rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            block_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found by inner product, a query's own id left out.

    Scores are double-precision inner products of the original vectors, ties
    go to the smaller id.  A shard is sent to one task once; blocks of
    ``block_rows`` queries follow it there and are searched one after another.
    A shard returns k rows per query, so what is merged grows with queries times
    shards, not with the table: for large tables raise ``shard_rows`` of the index.
    A repeated query id is searched once per distinct vector.  Fewer candidates
    than k: all of them."""
    rows = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).distinct()
    rows = rows.withColumn("dim", F.size("vector"))
    blocks = max(1, -(-rows.count() // block_rows))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    # A block holds about block_rows queries, by a hash of the id.
    packs = rows.groupBy("dim", "block").agg(F.collect_list(F.struct("id", "vector")).alias("queries"))
    shards = index_rows.groupBy("dim").agg(F.max("shard").alias("last"))
    sent = packs.join(shards, "dim").select("dim", F.explode(F.sequence(F.lit(0), "last")).alias("shard"), "block", "queries")
    both = index_rows.withColumn("block", F.lit(-1)).unionByName(sent, allowMissingColumns=True)
    both = both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "block")

    def look(batches):
        shard = None  # (dim, number, vectors, layers, members, breadth)
        for frame in batches:
            for r in frame.itertuples(index=False):
                if r.block < 0:
                    layers = [np.frombuffer(y, np.int32).reshape(-1, int(w)) for y, w in zip(r.layers, r.widths)]
                    shard = r.dim, r.shard, np.frombuffer(r.vectors, np.float64).reshape(-1, r.dim), layers, r.members, int(r.breadth)
                elif shard is not None and shard[:2] == (r.dim, r.shard):  # else no vector fell into the shard
                    q = np.array([row["vector"] for row in r.queries], np.float64)
                    mine = np.array([row["id"] for row in r.queries], np.int64)
                    yield from _look(*shard[2:], q, mine, k)

    found = both.select("dim", "shard", "block", "members", "vectors", "layers", "widths", "breadth", "queries").mapInPandas(
        look, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _look(x, layers, members, breadth, q, mine, k, some: int = 256):
    """The best ``k`` rows of one shard for each query, some queries at a time."""
    full = x.astype(np.float32)
    first = np.array([len(i) for i in members], np.int64)
    flat = np.concatenate([np.asarray(i, np.int64) for i in members])
    start = np.cumsum(first) - first
    want = min(k + 1, len(x))
    for a in range(0, len(q), some):
        part = q[a:a + some].astype(np.float32)
        if breadth:
            ids, _ = search(layers, full, part, max(breadth, k + 1))
            short = (ids >= 0).sum(axis=1) < want
        else:
            ids, short = np.full((len(part), want), -1, np.int32), np.ones(len(part), bool)
        if short.any():  # compared with all: the shard as its self-check says, or a part of the graph not reached
            near = part[short] @ full.T
            # a few more than wanted, as scores are compared in double precision below
            more = min(len(x), 3 * k)
            ids = np.hstack([ids, np.full((len(ids), max(0, more - ids.shape[1])), -1, ids.dtype)])
            ids[short, :more] = np.argsort(-near, axis=1, kind="stable")[:, :more]
        ids = ids[:, :max(want, min(ids.shape[1], 3 * k))]
        r, c = np.nonzero(ids >= 0)
        entry = ids[r, c]
        score = np.einsum("ij,ij->i", x[entry], q[a + r])
        n = first[entry]
        query = np.repeat(r, n)
        vec = flat[np.repeat(start[entry] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        score = np.repeat(score, n)
        other = vec != mine[a + query]
        query, vec, score = query[other], vec[other], score[other]
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        head = np.concatenate(([True], query[1:] != query[:-1])) if len(query) else np.zeros(0, bool)
        place = np.arange(len(query)) - np.flatnonzero(head)[np.cumsum(head) - 1] if len(query) else query
        keep = place < k
        yield pd.DataFrame({"query_id": mine[a + query[keep]], "vec_id": vec[keep], "score": score[keep]})
