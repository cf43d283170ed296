"""The comment store of sorted segments, and the checked stream into it."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from epiframe import fixtures as fx
from epiframe.plans.comment_log import FILES, CommentLog
from epiframe.plans.comments import fan_out
from epiframe.sources.manifest import read_manifest, write_manifest
from epiframe.streaming.comments import checked_ingest, parse_lines
from tests.conftest import SF_SMALL

COLS = ["country_key", "comment_text", "user", "source", "additional_notes"]


def texts(df):
    return sorted(r["comment_text"] for r in df.collect())


def comments(spark, rows):
    """(key, text) rows as submitted comments."""
    return spark.createDataFrame([(k, t, "u", None, None) for k, t in rows], "country_key string, comment_text string, user string, source string, additional_notes string")


def test_round_trip_against_the_posted_comments(spark, tmp_dir):
    posted = fx.comments(spark, SF_SMALL).drop("timestamp")
    log = CommentLog(spark, f"{tmp_dir}/log").append(posted).append(fan_out(posted, ["Nation_1", "Ελλάδα"]))
    rows = log.read().collect()
    n = posted.count()
    assert len(rows) == 3 * n and len({r["comment_id"] for r in rows}) == 3 * n and all(r["timestamp"] for r in rows)
    want = [r["comment_text"] for r in posted.collect() if r["country_key"].strip().lower() == "nation_1"] + [r["comment_text"] for r in posted.collect()]
    found = log.for_key("  NATION_1 ")
    assert texts(found) == sorted(want) and {r["count"] for r in found.collect()} == {len(want)}
    both = log.for_keys(["ελλάδα ", "Nation_3", "nobody"])
    assert [r["country_key"] for r in both.collect()] == sorted(r["country_key"] for r in both.collect())
    assert log.for_key("nobody").count() == 0 and log.for_keys([]).count() == 0
    assert found.columns == [*COLS, "timestamp", "comment_id", "count"]


def test_lookups_open_few_files_after_many_appends(spark, tmp_dir):
    log = CommentLog(spark, f"{tmp_dir}/log", fanout=2)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for i in range(15):
            log.append(comments(spark, [(f"key{j}", f"{i}-{j}") for j in (i % 7, 9)]).coalesce(1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    segments = {r["segment"] for r in log.files()}
    assert len(segments) <= 4  # fewer than fanout of each of the tiers 0 to 3
    assert len(log.files_of(["key9"])) <= 4 and log.files_of(["zzz"]) == []
    found = log.for_key("key9")
    assert texts(found) == sorted(f"{i}-9" for i in range(15)) and found.first()["count"] == 15
    opened = {f.removeprefix("file:").lstrip("/") for f in found.inputFiles() if "/segments/" in f}  # the lookup's, without the counts
    assert opened == {f.removeprefix("file:").lstrip("/") for f in log.files_of(["key9"])}
    assert {r["country_key"]: r["n"] for r in log.counts(["key9", "key0"]).collect()} == {"key9": 15, "key0": 3}
    before = texts(log.read())
    gone = log.forget_merged()
    assert gone and texts(log.read()) == before and log.forget_merged() == []
    on_disk = os.listdir(f"{tmp_dir}/log/segments")
    assert segments <= set(on_disk) and len(on_disk) <= len(segments) + 6


def test_a_key_opens_only_files_whose_range_holds_it(spark, tmp_dir):
    log = CommentLog(spark, f"{tmp_dir}/log").append(comments(spark, [(f"k{i:03d}", str(i)) for i in range(300)]), per_file=20)
    assert len(log.files()) >= 15 and len(log.files_of(["k007"])) == 1
    plan = log.for_key("k007")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(country_key), EqualTo(country_key,k007)" in plan or "In(country_key, [k007])" in plan
    import pyarrow.parquet as pq
    path = log.files_of(["k007"])[0].removeprefix("file:")
    assert pq.ParquetFile(path).metadata.num_rows <= 20


def test_counts_are_kept_not_scanned(spark, tmp_dir):
    log = CommentLog(spark, f"{tmp_dir}/log").append(comments(spark, [("a", str(i)) for i in range(50)] + [("b", "x")]))
    plan = log.for_key("a")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/segments/") == 1 and "/counts/" in plan and "Window" not in plan


def test_null_keys_empty_appends_and_replayed_batches(spark, tmp_dir):
    log = CommentLog(spark, f"{tmp_dir}/log", fanout=2)
    assert log.read().count() == 0 and log.for_key("a").count() == 0
    log.append(comments(spark, []), batch=0)
    assert log.read().count() == 0
    rows = comments(spark, [(None, "none"), ("a", "1")])
    for batch in (1, 1, 0, 2):
        log.append(rows, batch=batch)
    assert texts(log.read()) == ["1", "1", "none", "none"] and texts(log.for_key("a")) == ["1", "1"]
    assert CommentLog(spark, f"{tmp_dir}/log").for_key("a").first()["count"] == 2


def test_readers_see_the_last_whole_version(spark, tmp_dir):
    path = f"{tmp_dir}/m"
    assert read_manifest(spark, path, FILES) == (-1, [])
    for v in range(3):
        write_manifest(spark, path, FILES, v, [(f"s{v}", 0, None, None, None, 0, v)])
    version, rows = read_manifest(spark, path, FILES)
    assert version == 2 and [r["segment"] for r in rows] == ["s2"]
    assert [r["segment"] for r in read_manifest(spark, path, FILES, before=2)[1]] == ["s1"]


def line(**fields):
    return json.dumps(fields)


def test_checked_stream_keeps_one_of_each_and_the_bad_lines(spark, tmp_dir):
    good = [line(country_key=f" K{i % 3} ", comment_text=f"t{i}", user="u", client_id=f"c{i}") for i in range(9)]
    bad = ['{"country_key": "k1", "comment_te', "not json", line(country_key="k1", user="u", client_id="z"),
           line(country_key="k1", comment_text="x", user="u"), "", "[1]"]
    os.makedirs(f"{tmp_dir}/in")
    def send(name, lines):
        with open(f"{tmp_dir}/in/{name}", "w") as f:
            f.write("\n".join(lines))
    def run():
        return checked_ingest(spark, f"{tmp_dir}/in", f"{tmp_dir}/log", f"{tmp_dir}/bad", f"{tmp_dir}/ckpt")
    send("a.json", good[:6] + bad[:2])
    log, rejects = run()
    assert texts(log.read()) == [f"t{i}" for i in range(6)] and rejects.count() == 2
    send("a-again.json", good[:6] + bad[:2])  # the file is sent twice
    send("b.json", good[3:] + bad[2:])
    for _ in range(2):  # and the job runs once more with nothing new
        log, rejects = run()
        assert texts(log.read()) == [f"t{i}" for i in range(9)]
        assert texts(log.for_key("k1")) == ["t1", "t4", "t7"]
    got = sorted((r["line"], r["reason"]) for r in rejects.collect())
    assert got == sorted([(bad[0], "unreadable"), (bad[1], "unreadable")] * 2 + [(bad[2], "missing comment_text"), (bad[3], "missing client_id"),
                         (bad[4], "unreadable"), (bad[5], "unreadable")])


def test_lines_are_parsed_with_their_reason(spark):
    lines = spark.createDataFrame([(line(country_key="a", comment_text="t", user="u", client_id="1", extra=5),)], "value string")
    row = parse_lines(lines).first()
    assert row["reason"] is None and row["comment_text"] == "t" and row["source"] is None


@pytest.mark.parametrize("per_file", [None, 3])
def test_merging_keeps_every_comment(spark, tmp_dir, per_file):
    log = CommentLog(spark, f"{tmp_dir}/log", fanout=2)
    t0 = time.time()
    for i in range(5):
        log.append(comments(spark, [(f"k{j}", f"{i}.{j}") for j in range(4)]), per_file=per_file)
    assert texts(log.read()) == sorted(f"{i}.{j}" for i in range(5) for j in range(4)) and time.time() - t0 < 300
    assert {r["n"] for r in log.counts(["k0", "k1", "k2", "k3"]).collect()} == {5}
    assert sorted({r["tier"] for r in log.files()}) == [0, 2]
    assert log.read().where(F.col("timestamp").isNull()).count() == 0
