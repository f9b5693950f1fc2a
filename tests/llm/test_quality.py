import random

import numpy as np
from meshwave.llm import quality as Q
from pyspark.sql import functions as F


def test_held_out(spark):
    """Learn on half of the labels, judge the other half."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    labels = spark.read.parquet(f"{d}/labels.parquet")
    found = Q.score(docs, docs.join(labels.where("doc_id % 2 = 0"), "doc_id"))
    assert found.count() == docs.count()
    held = found.join(labels.where("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("q"), F.col("toxic").alias("t")), "doc_id").collect()
    assert np.mean([(r["quality"] >= 0.5) == r["q"] for r in held]) > 0.95
    assert np.mean([(r["toxic"] >= 0.5) == r["t"] for r in held]) > 0.85


def rates_of(spark, rows):
    counts, rate, k_host, k_path = Q.site_counts(spark.createDataFrame(rows, "host string, path string, y int"))
    host, path = Q.shrunk("", F.lit(None).cast("int"), rate, k_host, k_path)
    return {(r["host"], r["path"]): (r["h"], r["p"]) for r in counts.select("host", "path", host.alias("h"), path.alias("p")).collect()}, rate


def test_sparse_sites_shrink(spark):
    rng = random.Random(0)
    rows = [(f"h{h}", f"p{h}{i % 3}", int(rng.random() < (0.95 if h % 2 else 0.1))) for h in range(40) for i in range(60)]
    rows += [("one", "x", 1), ("h1", "rare", 0), (None, None, 1), (None, None, None)]
    got, rate = rates_of(spark, rows)
    host = {h: r[0] for (h, _), r in got.items()}
    path = {k: r[1] for k, r in got.items()}
    assert abs(rate - np.mean([r[2] for r in rows if r[2] is not None])) < 0.01
    assert host["h1"] > 0.85 and host["h2"] < 0.2
    assert rate < host["one"] < 0.95 and 0.2 < path["h1", "rare"] < host["h1"]
    assert (None, None) in path and 0 < host[None] < 1


def test_posterior_against_brute_force(spark):
    """Rates without the document's own label and posterior odds, from plain counts, for quality and for toxicity."""
    rng = random.Random(1)
    good, bad = "a calm clear useful sentence here", "BUY!!! $$$ $$$ NOW NOW NOW"
    rows = []
    for i in range(300):
        h = rng.randrange(6)
        rows.append((i, good if rng.random() < 0.5 else bad, None if h == 5 else f"h{h}", None if i % 7 == 0 else f"p{i % 3}", int(rng.random() < 0.2 + 0.12 * h), int(rng.random() < 0.5 - 0.08 * h)))
    labelled = spark.createDataFrame(rows, "doc_id long, text string, host string, path string, quality int, toxic int")
    docs = spark.createDataFrame([r[:4] for r in rows] + [(900, good, "h1", "new"), (901, bad, "new", "new"), (5, good, "h0", "p0")], "doc_id long, text string, host string, path string")
    got = Q.score(docs, labelled).collect()
    assert len(got) == 303
    per = {}
    for name, y in (("quality", 4), ("toxic", 5)):
        _, rate, k_host, k_path = Q.site_counts(labelled.select("host", "path", F.col(name).alias("y")))
        total, hits = len(rows), sum(r[y] for r in rows)
        assert abs(rate - (hits + 0.5) / (total + 1)) < 1e-12
        groups = {}
        for r in rows:
            groups.setdefault(r[2], []).append(r[y])
        spread = hits / total * (1 - hits / total)
        between = sum(len(g) * (np.mean(g) - hits / total) ** 2 for g in groups.values())
        excess = (between - spread * (len(groups) - 1)) / (total - sum(len(g) ** 2 for g in groups.values()) / total)
        assert np.isclose(k_host, np.clip(spread / excess - 1, *Q.STRENGTH) if excess > 0 else Q.STRENGTH[1])
        for d in docs.collect():
            own = next((r[y] for r in rows if r[0] == d["doc_id"] and (r[2], r[3]) == (d["host"], d["path"])), None)
            mine = lambda rs: (sum(rs) - (own or 0), len(rs) - (own is not None))  # noqa: B023, E731
            g, n = mine([r[y] for r in rows if r[2] == d["host"]])
            host = (g + k_host * rate) / (n + k_host)
            g, n = mine([r[y] for r in rows if (r[2], r[3]) == (d["host"], d["path"])])
            per.setdefault((d["doc_id"], d["text"], d["host"]), {})[name] = host, (g + k_path * host) / (n + k_path), rate
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    logit = lambda p: np.log(p / (1 - p))
    for (doc, _, _), want in per.items():
        host, path, rate = want["quality"]
        r = min(by[doc], key=lambda r: abs(r["path_rate"] - path))  # noqa: B023
        assert np.isclose(r["host_rate"], host) and np.isclose(r["path_rate"], path)
        assert np.isclose(logit(r["quality"]), logit(r["evidence"]) + logit(path) - logit(rate))
    # texts are of two kinds, so the toxic evidence is one of two numbers
    left = {round(float(logit(r["toxic"]) - logit(per[k]["toxic"][1]) + logit(per[k]["toxic"][2])), 6) for k in per if k[0] != 5 for r in by[k[0]]}
    assert len(left) <= 2


def test_strength_follows_the_spread(spark):
    rng = np.random.default_rng(0)
    for size in (2.0, 20.0, 200.0):
        p = rng.beta(0.5 * size, 0.5 * size, 800)
        rows = [(200, int(g)) for g in rng.binomial(200, p)]
        assert 0.6 * size < Q.strength(spark.createDataFrame(rows, "n long, good long"), "n", "good") < 1.7 * size


def test_edge_cases(spark):
    good, bad = "a calm clear useful sentence here", "BUY!!! $$$ $$$ NOW NOW NOW"
    rows = [(i, good if i % 2 else bad, f"s{i % 4}", "p", i % 2, int(i % 10 == 0)) for i in range(200)]
    labelled = spark.createDataFrame(rows, "doc_id int, text string, host string, path string, quality int, toxic int")
    data = [(1, None, None, None), (2, "", "s1", "p"), (3, good, "new", "new"), (4, bad, "s0", "p"), (4, bad, "s0", "p"), (None, "word " * 50_000, "s1", None)]
    docs = spark.createDataFrame([(*d, 9.0, "z") for d in data], "doc_id long, text string, host string, path string, evidence double, keep string")
    got = Q.score(docs, labelled).collect()
    assert len(got) == 6 and all(0 <= r[c] <= 1 for r in got for c in ("evidence", "host_rate", "path_rate", "quality", "toxic"))
    by = {r["doc_id"]: r for r in got}
    assert by[3]["quality"] > 0.5 > by[4]["quality"] and not by[4]["keep"]
    none = Q.score(docs, labelled.limit(0)).collect()
    assert len(none) == 6 and all(r["evidence"] == 0.5 and abs(r["quality"] - 0.5) < 1e-9 for r in none)
    assert Q.score(docs.limit(0), labelled).count() == 0
