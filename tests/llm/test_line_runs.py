"""Line de-duplication against DuckDB SQL and a plain loop."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from epiframe.llm import line_runs
from epiframe.llm.oracles import ORACLES
from epiframe.llm.queries import QUERIES
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, least=10):
    """(doc_id, text) with different ids -> doc_id -> (n_lines, n_dropped, kept)."""
    owner, holders = {}, {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            k = key_of(line)
            if len(k) >= least:
                owner[k] = min(owner.get(k, doc_id), doc_id)
                holders.setdefault(k, set()).add(doc_id)
    out = {}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key_of(x), ())) < 2 or owner[key_of(x)] == doc_id]
        out[doc_id] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def result(df):
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect()}


def test_query_matches_sql_and_stays_native(spark):
    df = QUERIES["op11_line_dedup"](spark, SF_SMALL)
    got = sorted(tuple(r) for r in df.collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    rel = con.sql(ORACLES["op11_line_dedup"])
    assert df.columns == rel.columns and got == sorted(rel.fetchall()) and sum(r[2] for r in got) > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "InPandas", "NestedLoop"))


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (7, 3)])
def test_batches_and_levels_do_not_change_the_result(spark, batches, fanout):
    rng = random.Random(batches)
    pool = [f"Shared line number {i} ÀÉ" for i in range(30)] + ["short", "", "   ", "\tShared Line number 3 ÀÉ \r", "shared line number 3 àé", "ten points"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 9)))) for i in rng.sample(range(1000), 80)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert result(line_runs.dedupe(docs, batches=batches, fanout=fanout)) == brute(rows)


def test_later_batches_of_a_kept_store_lose_to_earlier_ones_and_a_rerun_changes_nothing(spark):
    store = line_runs.LineRuns(spark, "kept_lines", buckets=4, fanout=2)
    def batch(*rows):
        return line_runs.lines(spark.createDataFrame(list(rows), SCHEMA))
    assert store.add(batch((9, "first come line\nsecond line here")), "a").count() == 0
    assert store.add(batch((1, "first come line\nthird line here"), (2, "third line here")), "b").count() == 2
    again = [tuple(r) for r in store.add(batch((1, "first come line\nthird line here"), (2, "third line here")), "b").select("doc.id", "pos").collect()]
    assert sorted(again) == [(1, 0), (2, 0)]
    for i in range(5):
        assert store.add(batch((100 + i, f"third line here\nonly in batch {i}")), f"c{i}").count() == 1
    # two runs a level at most stay behind before the next compaction
    assert sorted(store.runs()) != [0] and all(len(v) <= 2 for v in store.runs().values())
    reopened = line_runs.LineRuns(spark, "kept_lines", buckets=4, fanout=2)
    assert reopened.add(batch((0, "only in batch 4\nnot seen before")), "d").count() == 1
    reopened.forget()
    assert store.runs() == {}


def test_runs_are_joined_without_being_shuffled(spark):
    store = line_runs.LineRuns(spark, "plan_lines", fanout=9)
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("a line of text "), F.col("id") % 7).alias("text"))
    store.add(line_runs.lines(rows), "a")
    new = line_runs.lines(rows).groupBy("h1", "h2").agg(F.min("doc").alias("doc"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = new.join(spark.table(store.runs()[0][0]), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    store.forget()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_nulls_repeated_rows_and_clashing_columns(spark):
    line = "the same long line"
    rows = [(1, line, 5, "x"), (1, line, 6, "y"), (1, line + "\nother", 7, "z"), (None, line, 8, None), (None, line, 9, None),
            (None, "only here, once", 1, None), (3, None, 2, None), (4, "", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, doc string")
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_runs.dedupe(docs, batches=3).collect()), key=repr)
    # rows equal in id and text are one document; another text under the same id is another
    kept_by_first = [x for x in got if x[0] == 1 and x[1] == line]
    second = [x for x in got if x[1] == line + "\nother"][0]
    assert len(kept_by_first) == 2 and len({x[3:] for x in kept_by_first}) == 1
    assert {kept_by_first[0][3], second[3]} == {0, 1}
    assert [x[3:] for x in got if x[0] is None and x[1] == line] == [(1, "")] * 2
    assert (None, "only here, once", 1, 0, "only here, once") in got
    assert (3, None, 1, 0, "") in got and (4, "", 1, 0, "") in got


def test_text_ids_empty_table_and_many_lines(spark):
    docs = spark.createDataFrame([("b", "one long line of text"), ("a", "ONE long line of text ")], "doc_id string, text string")
    assert result(line_runs.dedupe(docs)) == {"a": (1, 0, "ONE long line of text "), "b": (1, 1, "")}
    assert line_runs.dedupe(spark.createDataFrame([], SCHEMA)).count() == 0
    n = 30_000
    docs = spark.range(2).select((F.col("id") + 1).alias("doc_id"), F.expr(f"array_join(transform(sequence(1, {n}), i -> concat('line of number ', i % 25000, if(id = 1 and i % 2 = 0, 'x', ''))), '\\n')").alias("text"))
    got = result(line_runs.dedupe(docs, batches=2))
    assert got[1][:2] == (n, 0) and got[2][:2] == (n, n // 2)
