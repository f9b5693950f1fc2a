import random

import numpy as np
import pytest
from meshwave.llm import decontaminate as D


def fold(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    return "".join(map(chr, D.fold(data, np.array([0, len(data)]))[0]))


def nearest(item, region):
    """Edits from the whole item to the nearest part of the region, by the plain table."""
    row = [0] * (len(region) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(region, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def spoil(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        i = rng.randrange(len(t))
        what = rng.randrange(3)
        t[i : i + (what != 1)] = [] if what == 0 else [rng.choice("qxz")]
    return "".join(t)


def codes(text):
    return np.array([ord(c) for c in text], np.uint32)


def test_alignment_against_the_table():
    """With all diagonals it is the plain table; with few, the nearest path that keeps to them; candidates do not disturb each other."""
    rng = random.Random(0)
    cases = [("".join(rng.choice("abc ") for _ in range(rng.randrange(1, 25))), "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 40))), rng.randrange(0, 8)) for _ in range(200)]
    x = codes("".join(r for _, r, _ in cases))
    begin = np.cumsum([0] + [len(r) for _, r, _ in cases])
    low = begin[:-1] - np.array([len(i) for i, *_ in cases])
    width = np.array([len(i) + len(r) + 1 for i, r, _ in cases])
    cost, first, last = D.banded_alignments(x, [codes(i) for i, *_ in cases], np.arange(len(cases)), np.array([m for *_, m in cases]), low, width, begin[:-1], begin[1:])
    for k, (item, region, most) in enumerate(cases):
        want = nearest(item, region)
        assert (cost[k] < 0) == (want > most)
        if cost[k] >= 0:
            part = region[first[k] - begin[k] : last[k] - begin[k]]
            assert cost[k] == want and edits_between(item, part) == want


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_band_is_enough():
    """A region within the budget lies within one of the overlapping bands of 2 (e + 1) diagonals."""
    rng = random.Random(1)
    for _ in range(100):
        item = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(10, 60)))
        e = len(item) // 10
        other = spoil(rng, item, e)
        text = "".join(rng.choice("xyz") for _ in range(rng.randrange(30))) + other + "zyx"
        bands = range(-len(item) // (e + 1) - 1, len(text) // (e + 1) + 1)
        got = D.banded_alignments(codes(text), [codes(item)], np.zeros(len(bands), int), np.full(len(bands), e), np.array(bands) * (e + 1), np.full(len(bands), 2 * (e + 1)), np.zeros(len(bands), int), np.full(len(bands), len(text)))
        found = [int(c) for c in got[0] if c >= 0]
        assert min(found) == nearest(item, text)


def test_grams():
    x = codes("the quick brown fox the quick")
    for q in D.QS:
        g = D.grams(x, q).tolist()
        seen = {}
        for i, h in enumerate(g):
            assert seen.setdefault(h, tuple(x[i : i + q])) == tuple(x[i : i + q])
        assert len(g) == len(x) - q + 1 and len(set(g)) == len({tuple(x[i : i + q]) for i in range(len(g))})


def test_memory_of_one_repeated_word():
    """A long text and an item that both repeat one word: hits are counted in parts."""
    import tracemalloc

    (index,) = D.index_items([(1, "spam " * 200)])
    data = np.frombuffer(("spam " * 20_000).encode(), np.uint8)
    x, begin, *_ = D.fold(data, np.array([0, len(data)]))
    tracemalloc.start()
    found = D.leaks_in(x, begin, index)
    assert found and all(r[2] == 0 for r in found) and tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randrange(6, 40))) for i in range(12)] + [(20 + i, text(rng.randrange(2, 9))) for i in range(8)] + [(40, "éàü " + text(4)), (50, None), (51, ""), (52, "zz"), (3, "again " + text(12))]
    docs = []
    for i in range(80):
        body, (_, item) = text(rng.randrange(5, 60)), items[rng.randrange(21)]
        if i % 2:
            inner = spoil(rng, item, rng.choice([0, 1, len(item) // 10, len(item) // 10, len(item) // 6])).upper().replace(" ", ",\n ")
            cut = rng.randrange(len(body))
            body = body[:cut] + " " + inner + " " + body[cut:]
        docs.append((i, body))
    docs += [(100, None), (101, ""), (None, items[0][1]), (5, docs[5][1])]
    df = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, item_id int, edits string")
    found = D.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    want = set()
    for d, t in docs:
        for i, it in items:
            m = fold(it).strip()
            if t and m and nearest(m, fold(t)) <= int(len(m) * 0.1):
                want.add((d, i))
    assert got == want and len(want) > 15
    by = dict(docs)
    for r in found:
        part = by[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]].decode()
        assert min(nearest(fold(it).strip(), fold(part)) for i, it in items if i == r["item_id"]) == r["edits"]


@pytest.mark.parametrize("size", [8 << 20, 300])
def test_blocks_do_not_matter(spark, small, monkeypatch, size):
    monkeypatch.setattr(D, "BLOCK_BYTES", size)
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench.limit(6)).collect()}
    items = {r["item_id"]: r["text"] for r in bench.limit(6).collect()}
    exact = {(r["doc_id"], i) for r in docs.collect() for i, t in items.items() if fold(t).strip() in fold(r["text"])}
    assert exact <= got and len(got) <= len(exact) + 2


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some benchmark text here")], "item_id long, text string")
    assert D.find_leaks(none, items).count() == 0
    assert D.find_leaks(spark.createDataFrame([(1, "some benchmark text here")], "doc_id long, text string"), items.limit(0)).count() == 0


def test_rows_of_one_id(spark):
    docs = spark.createDataFrame([(1, "some benchmark text here", 5), (1, "another text", 6), (None, "so some benchmark text here", 7), (None, None, 8)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, "some benchmark text here")], "item_id long, text string")
    assert sorted(r["item_id"] for r in D.without_leaks(docs, items).collect()) == [6, 8]
