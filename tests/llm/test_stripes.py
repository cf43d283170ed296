"""Collocations against DuckDB SQL and a plain count."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from epiframe.llm import stripes
from epiframe.llm.oracles import ORACLES
from epiframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "lang string, text string"


def brute(rows, longest=5, least=100, share=100, top=2000):
    f, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]", piece) if w]
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    found = {}
    cand = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    for (lang, p), a in cand.items():
        if any(x == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q)))
               for (x, q), b in cand.items()):
            continue
        n = totals[lang]
        score, k = min((1000 * a * n // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n))
    return {(lang, i, p.decode(), -a, l, r, n, -s) for lang, rows in found.items() for i, (s, a, p, l, r, n) in enumerate(sorted(rows)[:top], 1)}


def test_query_matches_sql(spark):
    df = QUERIES["op12_collocations"](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    rel = con.sql(ORACLES["op12_collocations"])
    assert df.columns == rel.columns and dict(df.dtypes) == dict(lang="string", rank="bigint", phrase="string", a="bigint", l="bigint", r="bigint", n="bigint", score="bigint")
    got = {tuple(r) for r in df.collect()}
    assert got == set(rel.fetchall()) and len(got) > 50


@pytest.mark.parametrize("share,top", [(100, 2000), (60, 5)])
def test_matches_a_plain_count(spark, share, top):
    rng = random.Random(share)
    vocabulary = ["New", "york", "city", "a", "été", "K", "b b", "x\x00", "the"]
    rows = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
        if i % 3 == 0:
            words.append("One fixed phrase of six words")
        rows.append((rng.choice(["en", "fr", None, "und"]), "".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n"]) for w in words)))
    rows += [("en", None), ("en", ""), ("fr", ".,\n")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {tuple(r) for r in stripes.collocations(docs, least=8, share=share, top=top, salts=3).collect()}
    want = brute(rows, least=8, share=share, top=top)
    assert got == want and any(len(x[2].split(" ")) >= 4 for x in want)


def test_flushes_do_not_change_counts(spark):
    texts = spark.createDataFrame([("en", "a b c. a b"), ("fr", "a b"), ("fr", "a b"), ("en", "b c a")], "lang string, text string").coalesce(1)
    for held in (1, 100):
        got = {tuple(r) for r in stripes.stripes(texts, 2, held_words=held).collect()}
        assert got == {("en", "a", "b", 2), ("en", "b", "c", 2), ("en", "c", "", 1), ("en", "b", "", 1), ("en", "c", "a", 1),
                       ("en", "a", "", 1), ("fr", "a", "b", 2), ("fr", "b", "", 2)}
        assert {tuple(r) for r in stripes.stripes(texts, 3, held_words=held).collect()} == {("en", "a b", "c", 1), ("en", "b c", "a", 1)}


def test_a_saturated_filter_changes_nothing(spark):
    """With one cell for all phrases everything passes; the counts decide."""
    rows = [("en", "p q r s t u. " * 12 + " ".join(f"w{i}" for i in range(400)))]
    docs = spark.createDataFrame(rows, SCHEMA)
    texts = docs.select("lang", "text")
    level = stripes.stripes(texts, 2).where("next <> '' and n >= 10").select("lang", F.concat_ws(" ", "prefix", "next").alias("phrase"))
    wide = stripes.frequent_runs(texts, stripes.phrase_filter(level, 2, bits=6), 2)
    tight = stripes.frequent_runs(texts, stripes.phrase_filter(level, 2), 2)
    def count(t):
        return {tuple(r) for r in stripes.stripes(t, 3).where("n >= 10").collect()}
    assert count(wide) == count(tight) and len(count(tight)) == 4


def test_very_long_texts_are_cut_between_pieces_only():
    import pyarrow as pa
    text = "ab cd. " * 50 + "x" * 30
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["lang", "text"])
    parts = [t for _, t in stripes._texts(iter([batch]), long=10) if t]
    assert "".join(parts) == text and len(parts) > 10 and all(p.rstrip().endswith(".") or p == parts[-1] for p in parts)


def test_empty_and_clashing_columns(spark):
    assert stripes.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([("en", "a b " * 5, "x", 1, 2)], "lang string, text string, phrase string, n long, a long")
    got = {tuple(r) for r in stripes.collocations(docs, least=2).collect()}
    assert got == brute([("en", "a b " * 5)], least=2)
