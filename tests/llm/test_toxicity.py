import numpy as np
import pytest
from pyspark.sql import functions as F

from epiframe.llm import toxicity as X


def test_label_model_recovers_accuracies_without_labels():
    rng = np.random.default_rng(1)
    n = 20000
    y = rng.random(n) < 0.2
    j = len(X.VOTERS)
    sens, spec = np.linspace(0.6, 0.9, j), np.linspace(0.97, 0.9, j)
    votes = np.where(np.where(y[:, None], rng.random((n, j)) < sens, rng.random((n, j)) > spec), 2, 0)
    votes[:, 1] = votes[:, 0]  # a copy of a voter must not count twice
    patterns = {}
    for v in votes:
        p = "".join("-0+"[x] for x in v)
        patterns[p] = patterns.get(p, 0) + 1
    model = X.fit_labels(patterns)
    assert model.prior == pytest.approx(0.2, abs=0.02)
    assert any({0, 1} <= set(c) for c in model.cliques)
    post = model.posterior(votes)
    assert ((post > 0.5) == y).mean() > 0.97
    for c, t in zip(model.cliques, model.tables):
        if len(c) == 1:
            assert t[1][2] == pytest.approx(sens[c[0]], abs=0.05)
            assert t[0][2] == pytest.approx(1 - spec[c[0]], abs=0.03)


def test_classifier_fits_soft_labels():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 4, (500, len(X.VOTERS) + 1))
    counts[:, -1] = 100
    target = 1 / (1 + np.exp(-(counts[:, 0] * 2.0 - 3)))
    w = X.fit_classifier(counts, target, np.ones(500), ridge=1e-3)
    p = 1 / (1 + np.exp(-X.features(counts) @ w))
    assert np.abs(p - target).max() < 0.1


def test_planted_words_are_caught_and_labels_of_held_rows_unused(spark, make_docs):
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    texts, toxic = [], []
    for i in range(400):
        t = list(rng.choice(words, 60))
        bad = i % 8 == 0
        if bad:
            t[3::15] = rng.choice(["grufflix", "grubnax", "zorkump", "zorkex"], len(t[3::15]))
        texts.append(" ".join(t))
        toxic.append(int(bad))
    docs = make_docs(texts)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic) if i % 2], "doc_id long, quality int, toxic int")
    labels = labels.unionByName(spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic) if not i % 16],
                                                      "doc_id long, quality int, toxic int"))
    rows = X.score_documents(docs, labels).collect()
    assert len(rows) == 400
    assert all((r["score"] >= 0.5) == bool(toxic[r["doc_id"]]) for r in rows)


def test_texts_that_share_a_passage_are_not_copies():
    rng = np.random.default_rng(4)
    shared = " ".join(f"s{i}" for i in range(20))
    own = [" ".join(f"w{k}" for k in rng.integers(0, 10**6, 60)) for _ in range(300)]
    assert len({tuple(X.sketch(f"{t} {shared}")) for t in own}) >= 295
    long = [f"w{k}" for k in rng.integers(0, 10**6, 2000)]
    near = [" ".join([*long[:k], "changed", *long[k + 1:]]) for k in range(100, 2000, 100)]
    same = [X.sketch(t) == X.sketch(" ".join(long)) for t in near]
    assert np.mean(same) >= 0.9
    assert X.sketch("a b") == X.sketch("A  b") and len(X.sketch("")) == 1


def test_edges(spark, make_docs):
    docs = make_docs([None, "", "idiot moron idiot loser scum loser", "fine words here", "!" * 20000, "fine words here"])
    docs = docs.withColumn("score", F.lit("clash")).withColumn("y", F.lit(1)).withColumn("id", F.lit(2))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r["score"] for r in X.score_documents(docs, none).collect()}
    assert len(rows) == 6 and all(0 <= s <= 1 for s in rows.values())
    assert rows[0] == rows[1] == rows[3] == rows[5]
    odd = spark.createDataFrame([(None, 1, 1), (2, None, None), (2, 1, 1), (2, 1, 1), (77, 1, 5)], "doc_id long, quality int, toxic int")
    assert X.score_documents(docs.unionByName(docs), odd).count() == 12
    assert X.score_documents(make_docs([]), none).collect() == []


def test_held_out_rows_of_the_query(spark):
    from epiframe.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op5_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.93 * len(held)
    assert all(r["predicted"] == 0 for r in held if r["toxic"] == 0)
