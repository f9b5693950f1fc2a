import re
from itertools import combinations

import numpy as np
import pytest

from meshwave.llm import url_rules as U


def test_contract(spark, small):
    got = {r["page_id"]: r for r in U.op8_url_rules(spark, small).collect()}
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", p["url"] or "")
        host, path = (m[1].translate({i: i + 32 for i in range(65, 91)}), m[2]) if m else ("", "")
        fits = [(h + q, v) for h, q, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(q)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        r = got[p["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def labelled(spark, n=400):
    return spark.createDataFrame([(f"http://bad{i % 3}.example.org/x/{i}" if i % 2 else f"https://good.example.org/y/{i}?a=1", bool(i % 2)) for i in range(n)], "url string, blocked boolean")


def test_rules_against_brute_force(spark):
    """The mined rules are all token sets, of any size, that counting lets pass, with their confidence and support."""
    rows = [(f"http://s{i % 7}.example.org/{'ad' if i % 5 < 2 else 'news'}/{'x' if i % 3 else 'y'}?id={i}", (i % 5 < 2) and (i % 3 > 0) or i % 11 == 0) for i in range(700)]
    df = spark.createDataFrame(rows, "url string, blocked boolean")
    found = {tuple(r["items"]): r for r in U.mine_rules(df, min_share=0.05).collect()}
    tokens = [frozenset(r[0]) for r in df.select(U.url_tokens(df["url"])).collect()]
    label = [b for _, b in rows]
    # tokens of the very same urls are one, and those of nearly all none
    where = {}
    for i, t in enumerate(tokens):
        for x in t:
            where.setdefault(x, []).append(i)
    first = {}
    for x in sorted(where):
        first.setdefault(tuple(where[x]), x)
    useful = {x for w, x in first.items() if len(w) <= U.USUAL * len(rows)}
    tokens = [t & useful for t in tokens]
    blocked = [t for t, b in zip(tokens, label, strict=True) if b]
    counts = {}
    for t in blocked:
        for size in range(1, len(t) + 1):
            for c in combinations(sorted(t), size):
                counts[c] = counts.get(c, 0) + 1
    passing = {}
    for c, n in counts.items():
        if n >= max(U.MIN_COUNT, 0.05 * len(blocked)):
            share = n / sum(set(c) <= t for t in tokens)
            if share >= max(U.MIN_CONFIDENCE, len(blocked) / len(rows) + U.GAIN):
                passing[c] = (n, share)
    want = {c: v for c, v in passing.items() if not any(set(p) < set(c) and w[1] + U.GAIN > v[1] for p, w in passing.items())}
    assert set(found) == set(want) and want
    for c, r in found.items():
        assert r["support"] == want[c][0] and abs(r["confidence"] - want[c][1]) < 1e-12 and r["anchor"] in c
    # matching by the index equals matching by every rule
    urls = df.select(df["url"].alias("key"), U.url_tokens(df["url"]).alias("tokens"))
    got = {r["key"]: r["mined"] for r in U.match_rules(urls, U.mine_rules(df, min_share=0.05)).collect()}
    assert got == {u: " & ".join(max((c for c in want if set(c) <= t), key=lambda c: (want[c][1], -len(c), " ".join(c)))) for (u, _), t in zip(rows, tokens, strict=True) if any(set(c) <= t for c in want)}


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_rules_are_mined_and_used(spark, scale):
    """Rules come out of the real labels, fit pages, and agree with what is stated for most of them."""
    rows = U.op8_url_rules(spark, f"/root/testdata/{scale}").collect()
    fit = [r for r in rows if r["mined"]]
    assert fit and np.mean([r["verdict"] == "block" for r in fit]) >= U.MIN_CONFIDENCE
    assert all(r["verdict"] == "block" for r in fit if r["rule"] is None)


def test_host_path_rule_in_sql(spark, small):
    import oracle

    from meshwave.llm import queries

    df = U.op8_url_rules(spark, small).select("page_id", "host", "path", "rule")
    assert queries and not oracle.difference(df, oracle.connect(small), U.HOST_PATH_RULE_SQL)


def test_edge_cases(spark):
    data = [(1, "http://bad1.example.org/x/5"), (2, None), (3, "no url"), (4, "HTTP://WWW.Example.COM/en/a?b#c"), (5, "http://a.net"), (6, "x://a.net/es/1"), (7, "http://example.com/de"), (8, "://"), (9, "a://b://net/fr/"), (9, "a://b://net/fr/"), (None, "http://x.com/\n?q"), (10, "http://h#://net/es/"), (11, ""), (12, "http://É.com/" + "p" * 100_000)]
    pages = spark.createDataFrame([(*d, "h", "r") for d in data], "page_id long, url string, host string, rule string")
    got = sorted(((r["page_id"], r["host"], r["path"][:9], r["rule"], r["verdict"]) for r in U.judge_urls(pages, labelled(spark)).collect()), key=str)
    want = [(1, "bad1.example.org", "/x/5", None, "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "www.example.com", "/en/a", "www.example.com/en/", "allow"), (5, "a.net", "", None, "allow"), (6, "a.net", "/es/1", "net/es/", "block"),
            (7, "example.com", "/de", "com/", "allow"), (8, "", "", None, "allow"), (9, "b:", "//net/fr/", None, "allow"), (9, "b:", "//net/fr/", None, "allow"), (None, "x.com", "/\n", "com/", "allow"), (10, "h", "", None, "allow"), (11, "", "", None, "allow"), (12, "É.com", "/pppppppp", "com/", "allow")]
    assert got == sorted(want, key=str)
    assert U.judge_urls(pages.limit(0), labelled(spark)).count() == 0
    assert U.judge_urls(pages, labelled(spark).limit(0)).where("verdict = 'block'").count() == 1
