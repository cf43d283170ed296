"""Names within an edit distance against comparison of all pairs."""

import random

import pytest

from epiframe.operators.similar import nearest_names, similar_pairs


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def table(spark, names, column="name"):
    return spark.createDataFrame([(n,) for n in names], f"`{column}` string")


def words(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 12))) for _ in range(n)]
    out = base + ["", "a", "aa", "aaa", "aaaa", "aaaaaaaa", "United Kingdom", "Untied Kingdom"]
    for w in base[: n // 2]:  # some edited once or twice
        for _ in range(rng.randrange(1, 3)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abc") + w[i:], w[:i] + "x" + w[i + 1:]])
        out.append(w)
    return out


@pytest.mark.parametrize("edits,q", [(1, 2), (2, 2), (3, 2), (2, 3)])
def test_every_pair_within_the_distance_is_found_once(spark, edits, q):
    left, right = words(edits, 60), words(edits + 10, 60) + words(edits, 20)
    got = [tuple(r) for r in similar_pairs(table(spark, left), table(spark, right, "other name"), edits, q).collect()]
    want = {(a, b, distance(a, b)) for a in set(left) for b in set(right) if distance(a, b) <= edits}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_nearest_with_ties_nulls_and_none(spark):
    left = table(spark, ["nation_2", "Nation_2", None, "nowhere at all", "nation_2", ""])
    right = table(spark, ["nation_1", "nation_0", "nation two", None, "nation_22"])
    got = {r["name"]: (r["nearest"], r["distance"]) for r in nearest_names(left, right).collect()}
    assert got == {"nation_2": ("nation_0", 1), "Nation_2": ("nation_22", 2), "nowhere at all": (None, None), "": (None, None)} or \
        got == {"nation_2": ("nation_0", 1), "Nation_2": ("nation_0", 2), "nowhere at all": (None, None), "": (None, None)}
    assert got["Nation_2"] == min((distance("Nation_2", x), x) for x in ["nation_1", "nation_0", "nation_22"])[::-1]
    assert nearest_names(left.limit(0), right).count() == 0
    assert [r["nearest"] for r in nearest_names(left, right.limit(0)).collect()] == [None] * 4


def test_no_join_compares_all_pairs(spark):
    names = table(spark, words(3, 50))
    plan = similar_pairs(names, names)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan
