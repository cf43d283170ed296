import random

import xxhash
from pyspark.sql import functions as F

from epiframe.llm import simhash as S


def brute_fingerprint(text, n=3):
    words, w = [], ""
    for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")):
        if c in " \t\n\x0b\x0c\r":
            words += [w] if w else []
            w = ""
        else:
            w += c
    words += [w] if w else []
    if not words:
        return 0
    grams = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits):
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if bin((fps[a] ^ fps[b]) & (2**64 - 1)).count("1") <= bits and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_fingerprint_matches_brute_force():
    rng = random.Random(1)
    texts = ["", None, " \n", "One", "one two", "A B c\x0bd\x1ce é", "x " * 5000]
    texts += [" ".join(rng.choice(["Ab", "cd", "éf", "g"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    for t in texts:
        assert S.simhash(t) % 2**64 == brute_fingerprint(t)


def test_links_match_brute_force_in_sparse_and_crowded_buckets(spark):
    rng = random.Random(2)
    fps = set()
    for _ in range(12):  # groups of close fingerprints
        base = rng.getrandbits(64)
        fps |= {base ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for _ in range(12)}
    base = rng.getrandbits(64)  # one crowd that shares most bits
    fps |= {base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    signed = [f - 2**64 if f >= 2**63 else f for f in (x % 2**64 for x in fps)]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a < b and bin((a ^ b) % 2**64).count("1") <= 2}
    assert {tuple(r) for r in S.links(df, 2, crowd=1000).collect()} == want
    label = brute_components(dict(zip(signed, signed)), 2)
    for crowd in (2, 8):
        got = {tuple(r) for r in S.links(df, 2, crowd=crowd).collect()}
        assert got <= want
        from epiframe.llm.common import components
        roots = {r["node"]: r["root"] for r in components(S.links(df, 2, crowd=crowd)).collect()}
        assert all(roots.get(f, f) == label[f] for f in signed)
    want3 = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % 2**64).count("1") <= 3}
    assert {tuple(r) for r in S.links(df, 3).collect()} == want3


def test_groups_nulls_empty_texts_and_repeats(spark, make_docs):
    base = " ".join(f"w{i}" for i in range(400))
    near = base.replace("w7 ", "x7 ")
    docs = make_docs([None, "", "  ", base, near, base, "alone in the world", "alone in the world"])
    docs = docs.unionByName(docs.where("doc_id = 3")).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    rows = S.simhash_groups(docs).collect()
    assert len(rows) == 9
    fps = {r["doc_id"]: r["fp"] % 2**64 for r in rows}
    assert fps[0] == fps[1] == fps[2] == 0
    label = brute_components(fps, 2)
    assert {r["doc_id"]: r["component_id"] for r in rows} == label
    kept = S.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label.values()))
    assert kept.columns == docs.columns


def test_keep_one_judges_rows_by_their_text(spark, make_docs):
    def words(k):
        return " ".join(f"{k}{i}" for i in range(100))

    base = make_docs([words("a"), words("b"), words("a"), words("b"), words("c"), words("d"), words("d"), words("e")])
    ids = F.element_at(F.array(*[F.lit(x).cast("long") for x in (5, 5, 3, None, None, None, None, 5)]), (F.col("doc_id") + 1).cast("int"))
    docs = base.withColumn("doc_id", ids)
    kept = sorted(((r["doc_id"], r["text"][:1]) for r in S.keep_one(docs).collect()), key=str)
    assert kept == [(3, "a"), (5, "b"), (5, "e"), (None, "c"), (None, "d")]


def test_empty_table(make_docs):
    assert S.simhash_groups(make_docs([])).collect() == []


def test_whole_table_against_brute_force(spark):
    import numpy as np

    from epiframe.llm.queries import QUERIES
    from tests.conftest import SF_SMALL

    got = QUERIES["op1_simhash_groups"](spark, SF_SMALL).toPandas()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert dict(zip(got.doc_id, got.fingerprint)) == {i: f"{brute_fingerprint(t):016x}" for i, t in texts.items()}
    fp = {i: int(f, 16) for i, f in zip(got.doc_id, got.fingerprint)}
    assert dict(zip(got.doc_id, got.component_id)) == brute_components(fp, 2)
    assert np.all(got.component_id <= got.doc_id)


def test_keep_one_returns_columns_of_any_name_unchanged(spark):
    rows = [(1, "one two three four", 7, "x", 5), (2, "one two three four", 8, "y", 6), (3, "else", 9, "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _simhash_row long, doc string, row int")
    got = S.keep_one(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]
