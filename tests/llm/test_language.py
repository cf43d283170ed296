from collections import Counter
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiframe.llm import language as L


def brute(word, prob):
    """Sum over all segmentations, by recursion."""
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        if word[:n] in prob:
            total += prob[word[:n]] * brute(word[n:], prob)
    if word[0] not in prob:
        total += L.ODD_LETTER * brute(word[1:], prob)
    return total


def test_forward_equals_recursion():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab"]
    rng = np.random.default_rng(1)
    prob = np.zeros((len(pieces) + 2, 2))
    prob[:-2] = rng.random((len(pieces), 2))
    prob[-2] = L.ODD_LETTER
    words = ["▁a", "▁abab", "▁xab", "▁babaxaba", "b"]
    alpha = L.forward(L.Lattice(pieces).find(words), prob)
    for i, w in enumerate(words):
        for k in range(2):
            assert alpha[i, len(w), k] == pytest.approx(brute(w, dict(zip(pieces, prob[:, k]))), rel=1e-12)


def test_expected_counts_are_the_gradient():
    """Expected count of a piece = p * d log(word probability) / d p."""
    pieces, word = ["▁", "a", "b", "ab", "▁a"], "▁abab"
    prob = np.array([0.1, 0.2, 0.15, 0.3, 0.25, L.ODD_LETTER, 0.0])
    got = L._expected(L.Lattice(pieces).find([word]), np.array([len(word)]), np.array([2.0]), prob)
    for i, p in enumerate(pieces):
        up = prob.copy()
        up[i] *= 1 + 1e-6
        logs = [np.log(brute(word, dict(zip(pieces, x)))) for x in (prob, up)]
        assert got[i] == pytest.approx(2 * (logs[1] - logs[0]) / 1e-6, rel=1e-3)


def test_runs_keep_every_letter():
    assert L.runs("don't-12x") == ["▁don", "▁t", "▁x"]
    assert "".join(L.runs("z" * 100)).replace("▁", "") == "z" * 100
    assert L.runs("123 ½ ²") == []


def test_held_out_accuracy_and_score_range(spark):
    from epiframe.llm.queries import QUERIES
    from tests.conftest import SF_SMALL

    got = QUERIES["op4_language"](spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = got.join(docs.select("doc_id", "lang", F.crc32(F.col("doc_id").cast("string")).alias("c")), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (r["c"] % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_edges(spark, make_docs, piece_path):
    train = reduce(lambda a, b: a.unionByName(b), [
        make_docs(["the cat and the dog"] * 5, "en"), make_docs(["der hund und die katze"] * 5, "de", 10),
        make_docs([None, "le chat"], None, 20)])
    model = L.train(train, piece_path)
    assert model.languages == ["de", "en"]
    docs = make_docs([None, "", "12 ½ !", "The DOG", "Der Hund", "the dog " * 20000, "x" * 5000])
    docs = docs.withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(7))
    rows = {r["doc_id"]: r for r in L.identify(docs.unionByName(docs.where("doc_id = 3")), model).collect()}
    assert [rows[i]["lang_pred"] for i in range(6)] == ["und", "und", "und", "en", "de", "en"]
    assert [rows[i]["score"] for i in range(3)] == [0.0, 0.0, 0.0]
    assert rows[6]["lang_pred"] in model.languages
    assert L.train(make_docs([]), piece_path) is None
    none = L.identify(docs, None).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert L.identify(make_docs([]), model).collect() == []


def test_tied_languages_go_to_the_first():
    words = {"b": Counter({"▁x": 3}), "a": Counter({"▁x": 3})}
    model = L.fit(words, {"a": 3, "b": 3}, ["▁", "x", "▁x"])
    assert L.Scorer(model).score(["x"])[0] == ["a"]
    assert L.Scorer(model).score(["x"])[1] == [pytest.approx(0.5)]
