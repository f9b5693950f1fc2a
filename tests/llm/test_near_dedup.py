import random
from collections import Counter

import numpy as np
import pyarrow as pa
from meshwave.llm import components as C
from meshwave.llm import near_dedup as N


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)}).split()


def counted(text):
    w = lower(text)
    return Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows, similarity=0.8):
    ids = sorted({d for d, _ in rows if d is not None})
    up = {d: d for d in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, t in rows:
        for e, u in rows:
            if d is None or e is None or e >= d:
                continue
            a, b = counted(t), counted(u)
            common = sum((a & b).values())
            total = sum(a.values()) + sum(b.values()) - common
            if (t or "") == (u or "") or (total and common / total >= similarity):
                x, y = sorted((root(d), root(e)))
                up[y] = x
    return {d: root(d) for d in ids}


def noisy(rng, words, rate):
    return " ".join(rng.choice("uvwxyz") * 3 + str(rng.random())[2:6] if rng.random() < rate else w for w in words)


def test_classes_against_brute_force(spark):
    """A family of copies at all distances, so that leaders differ, chains matter and many pairs lie near the threshold."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(300)}" for _ in range(200)]
    rows = [(i, noisy(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.03]))) for i in range(60)]
    rows += [(100 + i, " ".join(f"x{rng.randrange(500)}" for _ in range(80))) for i in range(20)]
    rows += [(200, None), (201, ""), (202, None), (203, "one"), (204, "ONE"), (205, "two words"), (206, "spam " * 3000), (207, "spam " * 2900), (208, "spam " * 1000)]
    rows += [(3, rows[3][1]), (None, "one"), (None, None)]
    df = spark.createDataFrame([(*r, "sig", 1) for r in rows], "doc_id long, text string, sig string, class_id int")
    got = N.near_duplicates(df).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None and r["class_id"] is None for r in got) == 2
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == brute_classes(rows)


def test_empty(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_agreement_is_the_weighted_jaccard_index():
    rng = random.Random(1)
    a = [f"w{rng.randrange(40)}" for _ in range(150)]
    b = a[:120] + [f"v{rng.randrange(40)}" for _ in range(40)]
    x, y = counted(" ".join(a)), counted(" ".join(b))
    want = sum((x & y).values()) / sum((x | y).values())
    of, cell = N.cells(pa.array([" ".join(a), " ".join(b)]))
    s = N.dart_signatures(of, cell, 2, 4000)
    assert abs((s[0] == s[1]).mean() - want) < 0.04
    assert np.isclose(N.weighted_jaccard(pa.array([" ".join(a)]), pa.array([" ".join(b)]))[0], want)


def test_fractional_weights():
    cell = np.arange(1, 41, dtype=np.uint64) * np.uint64(7919)
    of = np.repeat([0, 1], 40)
    share = np.concatenate([np.full(40, 1.0), np.full(40, 0.5)])
    s = N.dart_signatures(of, np.concatenate([cell, cell]), 2, 3000, share)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.05


def test_signature_is_the_text_own(spark):
    """Neither the slice nor the texts beside it enter a signature."""
    texts = ["a b c d e f g", "q w e r t y u i o p", "one"]
    of, cell = N.cells(pa.array(texts))
    whole = N.dart_signatures(of, cell, 3, 25)
    for i, t in enumerate(texts):
        of, cell = N.cells(pa.array([t]))
        assert (N.dart_signatures(of, cell, 1, 25)[0] == whole[i]).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(1000, x) for x in range(1001, 1030)] + [(rng.randrange(2000, 2060), rng.randrange(2000, 2060)) for _ in range(30)] + [(5, None), (7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r["id"]: r["component"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0
