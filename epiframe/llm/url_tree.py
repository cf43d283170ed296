"""URL verdicts from rules and from a tree of path templates per host."""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from epiframe.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OUTCOMES = ("block", "allow", "none")


class Rule(NamedTuple):
    """Fits ``host`` and its subdomains where the path starts with ``path``."""
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null.

    Ties go to block, then to the rule that sorts first.  The rules are a
    parameter and become part of the plan: a list of some hundreds at most."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.verdict == "block", [-ord(c) for c in r.host + r.path])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def shapes(path: Column) -> Column:
    """The path's segments, those that look variable as a wildcard: numbers, hexadecimal, mixed or long ones."""
    def shape(s):
        dot = F.regexp_extract(s, r"^[0-9]+(\.[A-Za-z0-9]{1,5})$", 1)
        return (F.when(s.rlike(r"^[0-9]+$"), "{num}")
                .when(dot != "", F.concat(F.lit("{num}"), dot))
                .when(s.rlike(r"^[0-9a-fA-F-]{8,}$"), "{hex}")
                .when(s.rlike(r"[0-9{}|]"), "{mix}")
                .when(F.length(s) > 24, "{long}").otherwise(s))

    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), shape)


def similar(a: dict[str, float], b: dict[str, float], z: float = 2.0) -> bool:
    """Whether two branches' counts may come from one distribution (G-test, normal bound of the chi-square)."""
    keys = set(a) | set(b)
    na, nb = sum(a.values()), sum(b.values())
    g = 0.0
    for k in keys:
        both = a.get(k, 0) + b.get(k, 0)
        for x, n in ((a.get(k, 0), na), (b.get(k, 0), nb)):
            if x:
                g += 2 * x * math.log(x * (na + nb) / (both * n))
    df = max(len(keys) - 1, 1)
    # Wilson-Hilferty: the chi-square at z standard deviations.
    return g <= df * (1 - 2 / (9 * df) + z * math.sqrt(2 / (9 * df))) ** 3


def merge_siblings(rows: list[tuple[str, str, str, float]]) -> dict[str, str]:
    """(branch, "next" or "label", feature, count) rows of one parent -> branch: merged name.

    Largest branch first, each joins the first cluster it is similar to: in what
    comes next on the paths and, where both have labelled urls, in their labels.
    A branch without labels is known by its paths alone, so labels pass to it
    from branches it looks like.  Merged names list their members in order."""
    vectors: dict[str, dict[str, dict[str, float]]] = {}
    for branch, kind, feature, n in rows:
        counts = vectors.setdefault(branch, {"next": {}, "label": {}})[kind]
        counts[feature] = counts.get(feature, 0) + n
    clusters: list[tuple[dict[str, dict[str, float]], list[str]]] = []
    for branch in sorted(vectors, key=lambda b: (-sum(vectors[b]["next"].values()), b)):
        v = vectors[branch]
        for total, members in clusters:
            if similar(total["next"], v["next"]) and (not total["label"] or not v["label"] or similar(total["label"], v["label"])):
                for kind, counts in v.items():
                    for k, n in counts.items():
                        total[kind][k] = total[kind].get(k, 0) + n
                members.append(branch)
                break
        else:
            clusters.append(({kind: dict(counts) for kind, counts in v.items()}, [branch]))
    return {b: "|".join(sorted(members)) for _, members in clusters for b in members}


def templates(labelled: DataFrame, share: float = 0.02, least: int = 3) -> DataFrame:
    """(host, shape, template, block, allow, none): the template of every host and path shape.

    ``labelled`` holds host, shape (array of segments) and outcome (block,
    allow or none).  From the root of each host, wherever the paths of a node
    part: a literal segment with fewer than ``least`` urls or less than ``share``
    of its node's becomes {word}, so a node has at most 1 / share literal
    branches; then similar branches (``merge_siblings``) are merged.  Segments
    that all paths of a node share are passed in one step, and a node with one
    shape is done, so there are as many rounds as a path has forks, however
    long it is.  Everything runs on counts per host and shape, aggregated before
    shuffles; each round is written and only has the shapes still undecided."""
    counts = [F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in OUTCOMES]
    rows = cut(labelled.groupBy("host", "shape").agg(*counts).withColumn("prefix", F.lit("")).withColumn("rest", F.col("shape")), "shapes")
    n = reduce(lambda a, b: a + b, map(F.col, OUTCOMES))
    out = []
    while True:
        node = rows.groupBy("host", "prefix").agg(F.count("*").alias("shapes"), F.min("rest").alias("low"), F.max("rest").alias("high"))
        # arrays are ordered by segments: what the least and the greatest share, all share
        parts = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), False)
        node = node.select("host", "prefix", "shapes", F.greatest(parts - 1, F.lit(0)).cast("int").alias("same"))
        here = cut(rows.join(node, ["host", "prefix"]), "nodes")
        out.append(here.where("shapes = 1").select("host", "shape", F.col("prefix").alias("template"), *OUTCOMES))
        here = here.where("shapes > 1")
        if here.isEmpty():
            break
        here = here.select("host", "shape", *OUTCOMES, "prefix", F.concat_ws("/", F.col("prefix"), F.slice("rest", F.lit(1), F.col("same"))).alias("stem"),
                           F.get("rest", F.col("same")).alias("seg"), F.slice("rest", F.col("same") + 2, F.size("rest")).alias("rest"))
        # a path that ends where others go on is a template of its own
        out.append(here.where("seg is null").select("host", "shape", F.concat("stem", F.lit("/$")).alias("template"), *OUTCOMES))
        here = here.where("seg is not null")
        parent = here.groupBy("host", "prefix").agg(F.sum(n).alias("parent_n"))
        child = here.groupBy("host", "prefix", "seg").agg(F.sum(n).alias("child_n"))
        few = (F.col("child_n") < least) | (F.col("child_n") < share * F.col("parent_n"))
        wild = F.when(few & ~F.col("seg").startswith("{") & (F.col("seg") != ""), "{word}").otherwise(F.col("seg"))
        branch = child.join(parent, ["host", "prefix"]).select("host", "prefix", "seg", wild.alias("branch"))
        here = cut(here.join(branch, ["host", "prefix", "seg"]), "level")
        after = F.get("rest", F.lit(0))
        after = F.when(after.isNull(), "end").when(after.startswith("{"), after).otherwise("word")
        features = [F.struct(F.lit("next").alias("kind"), after.alias("feature"), n.alias("n"))]
        features += [F.struct(F.lit("label").alias("kind"), F.lit(o).alias("feature"), F.col(o).alias("n")) for o in OUTCOMES[:2]]
        seen = (here.select("host", "prefix", "branch", F.inline(F.array(*features))).where("n > 0")
                .groupBy("host", "prefix", "branch", "kind", "feature").agg(F.sum("n").cast("double").alias("n")))

        def merge(group: pd.DataFrame) -> pd.DataFrame:
            named = merge_siblings(list(group[["branch", "kind", "feature", "n"]].itertuples(index=False, name=None)))
            return pd.DataFrame({"host": group["host"].iloc[0], "prefix": group["prefix"].iloc[0],
                                 "branch": list(named), "name": list(named.values())})

        # A group holds one node's branches: at most 1 / share literals and the wildcards.
        names = seen.groupBy("host", "prefix").applyInPandas(merge, "host string, prefix string, branch string, name string")
        rows = here.join(names, ["host", "prefix", "branch"])
        rows = cut(rows.select("host", "shape", *OUTCOMES, F.concat("stem", F.lit("/"), "name").alias("prefix"), "rest"), "shapes")
    return reduce(DataFrame.unionByName, out)


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", threshold: float = 0.8,
          strength: float = 5.0) -> DataFrame:
    """(id, host, path, rule, verdict): a row per row of ``pages``.

    Where a rule fits, its verdict.  Elsewhere the url's template decides: the
    urls with a rule are its labels, and it is blocked if some are blocked and its
    smoothed purity (block + strength * p) / (labels + strength) reaches
    ``threshold``, p being the share of block among all labels: a template with
    few labels leans on p.  Null
    urls, and those without ``://``, have an empty host and path."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    urls = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("_hit", first_rule(F.col("host"), F.col("path"), rules))
    urls = urls.withColumn("_shape", shapes(F.col("path")))
    labelled = urls.select("host", F.col("_shape").alias("shape"), F.coalesce("_hit.verdict", F.lit("none")).alias("outcome"))
    tree = templates(labelled)
    sums = tree.groupBy("host", "template").agg(F.sum("block").alias("b"), F.sum("allow").alias("a"))
    share = tree.agg((F.sum("block") / F.nullif(F.sum("block") + F.sum("allow"), F.lit(0))).alias("p")).first()["p"] or 0.0
    purity = (F.col("b") + strength * share) / (F.col("a") + F.col("b") + strength)
    bad = sums.where((F.col("b") > 0) & (purity >= threshold)).select("host", "template")
    bad = tree.join(bad, ["host", "template"], "left_semi").select("host", F.col("shape").alias("_shape"), F.lit(True).alias("_bad"))
    out = urls.join(bad, ["host", "_shape"], "left")
    verdict = F.coalesce("_hit.verdict", F.when(F.col("_bad"), "block"), F.lit("allow"))
    return out.select(id_col, "host", "path", F.col("_hit.rule").alias("rule"), verdict.alias("verdict"))
