"""Views under inserts, updates and deletions against recomputation."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F, types as T

from epiframe.operators.filters import active_rows
from epiframe.streaming import changes as ch

BASE = T.StructType([T.StructField("country_region", T.StringType()), T.StructField("date", T.IntegerType()),
                     T.StructField("cases_since_prev_day", T.LongType())])
STATS = ch.View(["country_region"], "cases_since_prev_day", active_rows, extremes=True)
TOTALS = ch.View(["country_region"], "cases_since_prev_day")


def change_rows(spark, pairs):
    return spark.createDataFrame(pairs, ch.change_schema(BASE))


def expected(rows, view):
    """country -> (total, n, max, min) of the base rows."""
    groups = {}
    for country, _, v in rows:
        if view is STATS and not (v is not None and v > 0):
            continue
        groups.setdefault(country, []).append(v)
    out = {}
    for country, values in groups.items():
        there = [v for v in values if v is not None]
        out[country] = (sum(there) if there else None, len(there), *((max(there), min(there)) if view is STATS else ()))
    return out


def state(spark, view, path):
    return {r[0]: tuple(r)[1:] for r in ch.read_view(spark, view, BASE, path).collect()}


def random_batches(seed, n_batches):
    """Batches of (before, after) and the rows after each."""
    rng, rows, out = random.Random(seed), [], []
    new = lambda: (rng.choice(["A", "B", "C", None]), rng.randrange(5), rng.choice([None, -3, 0, 1, 2, 2, 7, 50]))
    for _ in range(n_batches):
        batch = []
        for _ in range(rng.randrange(1, 9)):
            kind = rng.choice(["insert", "insert", "update", "delete"])
            if kind == "insert" or not rows:
                rows.append(new())
                batch.append((None, rows[-1]))
            else:
                i = rng.randrange(len(rows))
                old = rows.pop(i)
                if kind == "update":
                    rows.append(new())
                batch.append((old, rows[-1] if kind == "update" else None))
        out.append((batch, list(rows)))
    return out


@pytest.mark.parametrize("view", [STATS, TOTALS])
def test_equal_to_recomputation_after_every_batch_and_replay(spark, tmp_dir, view):
    path = os.path.join(tmp_dir, "view")
    for epoch, (batch, rows) in enumerate(random_batches(5, 5)):
        changes = change_rows(spark, batch)
        ch.apply_batch(view, changes, path, epoch, buckets=3)
        assert state(spark, view, path) == expected(rows, view)
        if epoch % 2:  # the batch comes again under its number
            ch.apply_batch(view, changes, path, epoch, buckets=3)
            assert state(spark, view, path) == expected(rows, view)


def test_a_replay_after_a_state_written_without_its_manifest(spark, tmp_dir, monkeypatch):
    path = os.path.join(tmp_dir, "view")
    ch.apply_batch(STATS, change_rows(spark, [(None, ("A", 1, 5)), (None, ("B", 1, 9))]), path, 0, buckets=2)
    second = change_rows(spark, [(("A", 1, 5), ("A", 1, 6)), (("B", 1, 9), None)])
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            ch.apply_batch(STATS, second, path, 1)
    assert state(spark, STATS, path) == {"A": (5, 1, 5, 5), "B": (9, 1, 9, 9)}
    ch.apply_batch(STATS, second, path, 1)
    assert state(spark, STATS, path) == {"A": (6, 1, 6, 6)}


def test_a_deletion_may_come_before_its_insert(spark, tmp_dir):
    path = os.path.join(tmp_dir, "view")
    row = ("A", 1, 4)
    ch.apply_batch(STATS, change_rows(spark, [(row, None), (None, ("A", 2, 8))]), path, 0)
    ch.apply_batch(STATS, change_rows(spark, [(None, row), (None, ("A", 3, 8))]), path, 1)
    assert state(spark, STATS, path) == {"A": (16, 2, 8, 8)}


def test_only_touched_buckets_are_read_and_written(spark, tmp_dir):
    path = os.path.join(tmp_dir, "view")
    rows = [(f"c{i}", 1, i + 1) for i in range(200)]
    ch.apply_batch(STATS, change_rows(spark, [(None, r) for r in rows]), path, 0, buckets=16)
    touched = ch.apply_batch(STATS, change_rows(spark, [(rows[3], ("c3", 1, 1000))]), path, 1, buckets=16)
    assert len(touched) == 1
    others = [f for f in glob.glob(f"{path}/state/*/*/*.parquet") if f"{ch.BUCKET}={touched[0]}/" not in f]
    assert len({f.split(f"{ch.BUCKET}=")[1].split("/")[0] for f in others}) == 15
    saved = {f: open(f, "rb").read() for f in others}
    for f in others:  # unreadable: a batch that opened them would fail
        with open(f, "wb") as out:
            out.write(b"no parquet")
    assert ch.apply_batch(STATS, change_rows(spark, [(("c3", 1, 1000), None)]), path, 2, buckets=16) == touched
    for f, data in saved.items():
        with open(f, "wb") as out:
            out.write(data)
    assert state(spark, STATS, path) == expected([r for r in rows if r[0] != "c3"], STATS)


def test_stream_in_single_files_equals_one_batch_and_a_rerun_changes_nothing(spark, tmp_dir):
    batches = random_batches(11, 4)
    for batch, _ in batches:
        change_rows(spark, batch).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/in")
    def run(name, files):
        out = ch.run_changes(spark, STATS, BASE, f"{tmp_dir}/in", f"{tmp_dir}/{name}", f"{tmp_dir}/{name}-ckpt", buckets=4, files_per_trigger=files)
        return {r[0]: tuple(r)[1:] for r in out.collect()}
    want = expected(batches[-1][1], STATS)
    assert run("single", 1) == run("whole", None) == run("single", 1) == want


def test_empty_batches_and_views_and_wrong_values(spark, tmp_dir):
    path = os.path.join(tmp_dir, "view")
    assert ch.read_view(spark, TOTALS, BASE, path).collect() == []
    assert ch.apply_batch(TOTALS, change_rows(spark, []), path, 0) == []
    assert ch.read_view(spark, TOTALS, BASE, path).columns == ["country_region", "total", "n"]
    ch.apply_batch(TOTALS, change_rows(spark, [(None, (None, 1, None))]), path, 1)
    assert state(spark, TOTALS, path) == {None: (None, 0)}
    floats = spark.createDataFrame([("A", 1.5)], "k string, v double")
    with pytest.raises(ValueError, match="whole numbers"):
        ch.apply_batch(ch.View(["k"], "v"), ch.inserts(floats), f"{tmp_dir}/f", 0)
    cents = floats.select("k", F.col("v").cast("decimal(10,2)").alias("v"))
    ch.apply_batch(ch.View(["k"], "v"), ch.inserts(cents), f"{tmp_dir}/d", 0)
    assert [str(r["total"]) for r in ch.read_view(spark, ch.View(["k"], "v"), cents.schema, f"{tmp_dir}/d").collect()] == ["1.50"]
