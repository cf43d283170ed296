import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from epiframe.llm import url_tree as U
from epiframe.llm.queries import QUERIES, RULES
from tests.conftest import SF_SMALL


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    path = rest[n:]
    m = min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    return host, path[:m]


def brute_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def brute_templates(rows, share=0.02, least=3):
    """rows: (host, segments tuple, outcome) -> (host, segments): template."""
    count, out = defaultdict(Counter), {}
    for host, segs, outcome in rows:
        count[host, segs][outcome] += 1

    def walk(host, prefix, shapes):
        """shapes: whole -> what is left of it."""
        if len(shapes) == 1:
            out[host, next(iter(shapes))] = prefix
            return
        same = 0
        while all(len(r) > same for r in shapes.values()) and len({r[same] for r in shapes.values()}) == 1:
            same += 1
        stem = "/".join([prefix, *next(iter(shapes.values()))[:same]])
        for s in [s for s, r in shapes.items() if len(r) == same]:
            out[host, s] = stem + "/$"
        left = {s: r[same:] for s, r in shapes.items() if len(r) > same}
        size = {s: sum(count[host, s].values()) for s in left}
        child, total = Counter(), sum(size.values())
        for s, r in left.items():
            child[r[0]] += size[s]
        branch, seen = {}, Counter()
        for s, r in left.items():
            few = child[r[0]] < least or child[r[0]] < share * total
            branch[s] = "{word}" if few and r[0] and not r[0].startswith("{") else r[0]
            after = "end" if len(r) == 1 else r[1] if r[1].startswith("{") else "word"
            seen[branch[s], "next", after] += size[s]
            for o in ("block", "allow"):
                if count[host, s][o]:
                    seen[branch[s], "label", o] += count[host, s][o]
        names = U.merge_siblings([(*k, n) for k, n in sorted(seen.items())])
        for name in set(names.values()):
            walk(host, f"{stem}/{name}", {s: r[1:] for s, r in left.items() if names[branch[s]] == name})

    hosts = defaultdict(dict)
    for host, segs in count:
        hosts[host][segs] = segs
    for host, shapes in hosts.items():
        walk(host, "", shapes)
    return out, count


def brute_judge(pages, rules, shapes, threshold=0.8, strength=5.0):
    parts = {i: brute_parts(u) for i, u in pages.items()}
    rule = {i: brute_rule(*p, rules) for i, p in parts.items()}
    rows = {i: (parts[i][0], shapes[i], rule[i].verdict if rule[i] else "none") for i in pages}
    prefix, count = brute_templates(rows.values())
    b, a = Counter(), Counter()
    for k, c in count.items():
        b[k[0], prefix[k]] += c["block"]
        a[k[0], prefix[k]] += c["allow"]
    p = sum(b.values()) / max(sum(b.values()) + sum(a.values()), 1)
    out = {}
    for i, (host, segs, _) in rows.items():
        t = host, prefix[host, segs]
        bad = b[t] > 0 and (b[t] + strength * p) / (a[t] + b[t] + strength) >= threshold
        out[i] = (*parts[i], rule[i].host + rule[i].path if rule[i] else None,
                  rule[i].verdict if rule[i] else "block" if bad else "allow")
    return out


def shapes_of(spark, pages):
    df = spark.createDataFrame(list(pages.items()), "page_id long, url string")
    return {r["page_id"]: tuple(r["s"]) for r in df.select("page_id", U.shapes(U.path_of(F.col("url"))).alias("s")).collect()}


@pytest.mark.parametrize("sf", [SF_SMALL, "/root/testdata/sf0.01"])
def test_query_matches_brute_force(spark, sf):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    want = brute_judge(pages, RULES, shapes_of(spark, pages))
    got = {r["page_id"]: tuple(r)[1:] for r in QUERIES["op10_url_filter"](spark, sf).collect()}
    assert got == want


def test_learned_templates_reject_and_spare(spark):
    rng = random.Random(1)
    urls = []
    for i in range(400):
        host = rng.choice(["a.shop.net", "b.news.net"])
        top = rng.choice(["ads", "promo", "story"])
        urls.append(f"https://{host}/{top}/x{rng.choice(['', 'bad'])}/{i}.html")
    rules = [U.Rule("block", "shop.net", "/ads/xbad/"), U.Rule("block", "shop.net", "/ads/x/"), U.Rule("allow", "news.net", "/story/"),
             U.Rule("block", "shop.net", "/promo/xbad/1"), U.Rule("block", "shop.net", "/promo/xbad/2")]
    pages = dict(enumerate(urls))
    got = {r["page_id"]: tuple(r)[1:] for r in U.judge(
        spark.createDataFrame(list(pages.items()), "page_id long, url string"), rules).collect()}
    assert got == brute_judge(pages, rules, shapes_of(spark, pages))
    learned = [g for i, g in got.items() if g[2] is None and "/promo/xbad/" in g[1] and g[0] == "a.shop.net"]
    assert learned and all(g[3] == "block" for g in learned)
    assert all(g[3] == "allow" for g in got.values() if g[0] == "b.news.net")


def test_similar_branches_merge_and_others_do_not():
    def merged(*rows):
        return U.merge_siblings([r for branch, n, label in rows for r in
                                 [(branch, "next", "{num}", n)] + ([(branch, "label", label, n)] if label else [])])
    assert merged(("es", 80, "block"), ("fr", 70, "block"), ("en", 90, "allow")) == {"es": "es|fr", "fr": "es|fr", "en": "en"}
    # a branch without labels goes with the largest it looks like
    assert merged(("en", 500, None), ("es", 80, "block"), ("fr", 70, "block")) == dict.fromkeys(["en", "es", "fr"], "en|es|fr")
    other = U.merge_siblings([("a", "next", "{num}", 50.0), ("b", "next", "word", 50.0)])
    assert other == {"a": "a", "b": "b"}


def test_siblings_of_blocked_branches_are_rejected_where_they_look_alike(spark):
    """On a host whose labelled branches are all blocked, an unlabelled one of the same
    form goes too; one of another form, or beside allowed branches, stays."""
    urls = [f"x://a.net/{lang}/{i}" for lang in ("es", "fr", "en") for i in range(40)]
    urls += [f"x://a.net/about/us/{c}" for c in "abcdefgh" for _ in range(5)]
    urls += [f"x://b.com/{lang}/{i}" for lang in ("en", "de") for i in range(40)]
    urls += [f"x://c.net/{lang}/{i}" for lang in ("es", "en") for i in range(2)]  # too few labels
    rules = [U.Rule("block", "net", "/es/"), U.Rule("block", "net", "/fr/"), U.Rule("allow", "com", "/")]
    pages = dict(enumerate(urls))
    got = {r["page_id"]: tuple(r)[1:] for r in U.judge(spark.createDataFrame(list(pages.items()), "page_id long, url string"), rules).collect()}
    assert got == brute_judge(pages, rules, shapes_of(spark, pages))
    verdict = {u: got[i][3] for i, u in pages.items()}
    assert all(v == "block" for u, v in verdict.items() if "a.net/en/" in u)
    assert all(v == "allow" for u, v in verdict.items() if "/about/" in u or "b.com" in u or "c.net/en" in u)


def test_deep_paths_part_below_any_depth(spark):
    deep = "/".join(["s"] * 40)
    urls = [f"x://h.net/{deep}/{leaf}/{i}" for leaf in ("bad", "good") for i in range(30)] + [f"x://h.net/{deep}/more/x/y/z/{c}" for c in "abc" * 5]
    rules = [U.Rule("block", "h.net", f"/{deep}/bad/1"), U.Rule("allow", "h.net", f"/{deep}/good/1"), U.Rule("block", "h.net", f"/{deep}/bad/2")]
    pages = dict(enumerate(urls))
    got = {r["page_id"]: tuple(r)[1:] for r in U.judge(spark.createDataFrame(list(pages.items()), "page_id long, url string"), rules).collect()}
    assert got == brute_judge(pages, rules, shapes_of(spark, pages))
    free = {u: got[i][3] for i, u in pages.items() if got[i][2] is None}
    assert {v for u, v in free.items() if "/bad/" in u} == {"block"} and {v for u, v in free.items() if "/bad/" not in u} == {"allow"}


def test_the_tree_rejects_some_urls_of_the_given_pages(spark):
    rows = QUERIES["op10_url_filter"](spark, "/root/testdata/sf0.01").where("rule is null").groupBy("verdict").count().collect()
    assert dict((r["verdict"], r["count"]) for r in rows).get("block", 0) > 0


def test_edges(spark):
    pages = {0: None, 1: "", 2: "no scheme", 3: "HTTP://WWW.Example.COM", 4: "x://Example.com/en/a?b#c", 5: "x://a.net/es/",
             6: "x://net/fr/1", 7: "x://internet/fr/1", 8: "x://com?://b.com/en/", 9: "x:///p//q/", 10: "x://h.org/" + "a/" * 3000,
             11: "x://h.org/{num}/|", 12: "x://ÄB.org/é"}
    df = spark.createDataFrame(list(pages.items()), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("n", F.lit(1))
    rows = U.judge(df.unionByName(df), RULES).collect()
    assert len(rows) == 2 * len(pages)
    for r in rows:
        host, path = brute_parts(pages[r["page_id"]])
        rule = brute_rule(host, path, RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.host + rule.path if rule else None)
        assert r["verdict"] == (rule.verdict if rule else "allow")
    assert U.judge(df.where("false"), RULES).collect() == []
