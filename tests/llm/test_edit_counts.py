import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from epiframe.llm import edit_counts as E

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = ["the", "ing", " ", "  ", "\n", " a", "é", "'s", "12", ".", ", ", "\t", " \n", "中", " word", " another", "\x1c", "　"]


@pytest.fixture(scope="module")
def count():
    return lambda x: len(E.encoder(RANKS, PATTERN).encode_ordinary(x))


def replace(text, start, stop, insert):
    start = min(max(start, 0), len(text))
    stop = min(max(stop, start), len(text))
    return text[:start] + insert + text[stop:]


def test_tree_counts_equal_whole_encoding_after_every_edit(count):
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 120)))
        leaves = E.cuts(text, 16)
        assert "".join(leaves) == text
        tree = E.Tree(leaves, [count(x) for x in leaves])
        assert tree.tokens[1] == count(text)
        for _ in range(6):
            a = rng.randint(-2, len(text) + 2)
            b, insert = a + rng.randint(-1, 30), "".join(rng.choice(ODD) for _ in range(rng.randint(0, 8)))
            tree.edit(a, b, insert, count)
            text = replace(text, a, b, insert)
            assert "".join(tree.leaves) == text and tree.tokens[1] == count(text) and tree.chars[1] == len(text)


def test_an_edit_encodes_only_what_is_near(count):
    text = " ".join(f"word{i}" for i in range(20000))
    leaves = E.cuts(text)
    tree = E.Tree(leaves, [count(x) for x in leaves])
    assert tree.edit(70000, 70010, "new words", count) < 4 * E.LEAF + 200


def test_query_against_whole_encoding(spark, count):
    from epiframe.llm.queries import QUERIES, edit_log
    from tests.conftest import SF_SMALL

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op3_token_counts"](spark, SF_SMALL).collect()}
    edits = {}
    for e in edit_log(docs).orderBy("seq").collect():
        edits.setdefault(e["doc_id"], []).append(e)
    for d in docs.collect():
        text = d["text"] or ""
        assert got[d["doc_id"]]["n_tokens"] == count(text)
        for e in edits[d["doc_id"]]:
            text = replace(text, e["start"], e["stop"], e["insert"])
        assert got[d["doc_id"]]["n_edited"] == count(text) and got[d["doc_id"]]["n_edits"] == 3


def test_edges_and_rounds(spark, make_docs, count, monkeypatch):
    docs = make_docs([None, "", "some words " * 400, "x", "x"]).withColumn("version", F.lit(1)).withColumn("edits", F.lit("x"))
    state = E.trees(docs.unionByName(docs), RANKS, PATTERN)
    log = [(2, i, 7 * i, 7 * i + 3, " é" * (i % 3)) for i in range(25)] + [
        (0, 1, None, None, None), (1, 1, 5, 2, "new"), (99, 1, 0, 0, "x"), (None, 1, 0, 0, "x"), (3, None, 0, 1, "yy z")]
    edits = spark.createDataFrame(log, "doc_id long, seq int, start int, stop int, insert string")
    text = "some words " * 400
    for _, _, a, b, s in log[:25]:
        text = replace(text, a, b, s)
    want = {0: 0, 1: count("new"), 2: count(text), 3: count("yy z"), 4: 1}
    for at_once in (10_000, 10):
        monkeypatch.setattr(E, "EDITS_AT_ONCE", at_once)
        rows = E.recount(docs, state, edits, RANKS, PATTERN).collect()
        assert {r["doc_id"]: r["n_edited"] for r in rows} == want and len(rows) == 5
        assert {r["doc_id"]: r["n_edits"] for r in rows} == {0: 1, 1: 1, 2: 25, 3: 1, 4: 0}
    none = edits.where("false")
    assert all(r["n_edited"] == r["n_tokens"] for r in E.recount(docs, state, none, RANKS, PATTERN).collect())
    empty = make_docs([])
    assert E.recount(empty, E.trees(empty, RANKS, PATTERN), edits, RANKS, PATTERN).collect() == []
