import corpus_pipeline as P
from pyspark.sql import functions as F

from epiframe.llm import language, simhash, toxicity
from epiframe.llm.common import components
from epiframe.llm.queries import QUERIES, folds, table
from tests.conftest import SF_SMALL
from tests.llm.test_packing import check_rows
from tests.llm.test_simhash import brute_components, brute_fingerprint


def test_stages_against_each_operator(spark, word_path, piece_path):
    assert [n for n, _ in P.STAGES] == ["toxicity", "language", "simhash", "packing"]
    docs = table(spark, SF_SMALL, "documents")
    labels = folds(table(spark, SF_SMALL, "labels"), 5, 0).where("not held_out")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in toxicity.score_documents(docs, labels).where("score < 0.5").collect()}
    left = docs.where(F.col("doc_id").isin(*good))
    model = language.train(folds(left, 3, 1).where("not held_out"), piece_path)
    known = {r["doc_id"] for r in language.identify(left, model).where("lang_pred <> 'und' and score >= 0.5").collect()}
    groups = brute_components({i: brute_fingerprint(texts[i]) for i in known}, 2)
    kept = sorted(i for i in known if groups[i] == i)
    rows = P.run(spark, SF_SMALL).collect()
    assert sorted({r["doc_id"] for r in rows}) == kept
    check_rows(rows, docs.where(F.col("doc_id").isin(*kept)).collect(), word_path, 4096)


def test_stages_keep_columns_and_take_odd_tables(spark, make_docs, tmp_path):
    spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = make_docs([None, "", "12", "idiot " * 50, "plain words of one text", "plain words of one text"])
    odd = odd.unionByName(odd).withColumn("score", F.lit("x")).withColumn("held_out", F.lit("y"))
    for docs in (odd, odd.where("false")):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("id * 7 % 200 AS u", "(id + 1) * 7 % 200 AS v").where("u <> v")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == dict.fromkeys(range(200), 0)
    assert components(edges.where("false")).collect() == []


def test_registered():
    from __spark_entry__ import oracle_sql, queries

    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert "op9_chat_format" in oracle_sql()


def test_stages_return_columns_of_any_name_unchanged(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60)
    for c in ("_toxicity", "_hits", "_language", "_lang_pred", "score", "held_out", "row"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    for stage in (P.clean, P.known_language):
        got = stage(spark, docs, SF_SMALL)
        assert got.columns == docs.columns and got.select("_toxicity", "_hits", "_language", "_lang_pred", "score", "held_out", "row").distinct().count() == 1
        assert got.count() > 40
