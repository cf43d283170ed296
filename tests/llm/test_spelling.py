"""Spelling variants against comparison of all pairs, small tables."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from epiframe.llm import spelling
from epiframe.llm.queries import QUERIES, table
from tests.conftest import SF_SMALL


def brute(rows, shortest=5, least=3):
    """(doc_id, text) rows -> word -> (form, root, n, n_near, form_n)."""
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    words = {w: n for w, n in total.items() if len(w) >= shortest and n >= least}
    # two different words are one edit apart if they share a deletion at the same
    # place (replaced), or one is a deletion of the other
    holes = defaultdict(set)
    near = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1:]].add(w)
            if w[:i] + w[i + 1:] in words:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    out = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        out[w] = [form, None, n, len(near[w]), words.get(form)]
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def rows_of(df):
    rows = df.collect()
    assert len(rows) == len({r["word"] for r in rows})
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_query_matches_brute_force(spark):
    docs = [tuple(r) for r in table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()]
    got = rows_of(QUERIES["op13_spelling_variants"](spark, SF_SMALL))
    assert got == brute(docs) and sum(x[0] is not None for x in got.values()) > 20


@pytest.mark.parametrize("block", [2, 3, 1024])
def test_blocks_do_not_change_links(spark, block):
    """Every cut into tiles finds every pair once, also short words of one letter and long ones."""
    words = ["aaaaa", "aaaa", "aaaaaa", "baaaa", "aaaab", "ab", "a", "b", "abcdefgh" * 8, "abcdefgh" * 8 + "x", "Àéaaa", "aaaéÀ", "aaéaa"]
    words += [f"w{i:03d}xyz" for i in range(60)]
    vocabulary = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long").repartition(3)
    got = [tuple(sorted((r["u"], r["v"]))) for r in spelling.links(vocabulary, block=block).collect()]
    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    want = {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_chains_ties_nulls_and_clashing_columns(spark):
    text = " ".join(["maison"] * 40 + ["maisen"] * 12 + ["maisan"] * 12 + ["mausan"] * 4 + ["Maisons"] * 3 + ["seul×x"] * 5)
    rows = [(5, text, "a", 1), (None, None, "b", 2), (7, "", "c", 3), (5, "12 _ āāāāāā", "d", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n long")
    got = rows_of(spelling.variants(docs, every=0))
    assert got["maisen"] == ("maison", "maison", 12, 2, 40) and got["maisan"] == ("maison", "maison", 12, 3, 40)
    assert got["mausan"] == ("maisan", "maison", 4, 1, 12) and got["maison"] == (None, "maison", 40, 3, None)
    assert got["maisons"] == ("maison", "maison", 3, 1, 40) and got["seul×x"] == (None, "seul×x", 5, 0, None)


def test_form_needs_twice_the_count_and_ties_go_to_the_smaller_word(spark):
    vocabulary = spark.createDataFrame([("abcde", 5), ("abcdx", 9), ("abcdy", 10), ("abcda", 10)], "word string, n long")
    got = {r["word"]: (r["form"], r["n_near"]) for r in spelling.forms(vocabulary, spelling.links(vocabulary)).collect()}
    assert got == {"abcde": ("abcda", 3), "abcdx": (None, 3), "abcdy": (None, 3), "abcda": (None, 3)}


def test_empty_table_and_a_very_long_text(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(docs).count() == 0
    long = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("repeat('alpha alphb alpha alpha alpha ', 200000)").alias("text"))
    got = rows_of(spelling.variants(long, every=0))
    assert got == {"alpha": (None, "alpha", 800000, 1, None), "alphb": ("alpha", "alpha", 200000, 1, 800000)}
