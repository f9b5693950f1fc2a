import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from meshwave.llm import packing
from tokenizers import Tokenizer


def brute_knapsack(values, lengths, capacity):
    best = 0.0
    for use in product(*(range(capacity // n + 1) for n in lengths)):
        if sum(u * n for u, n in zip(use, lengths, strict=True)) <= capacity:
            best = max(best, sum(u * v for u, v in zip(use, values, strict=True)))
    return best


@given(st.lists(st.tuples(st.integers(1, 12), st.floats(0.1, 5)), min_size=1, max_size=4, unique_by=lambda x: x[0]))
@settings(max_examples=60, deadline=None)
def test_knapsack(items):
    items.sort()
    lengths, values = np.array([a for a, _ in items]), np.array([b for _, b in items])
    use = packing.price_knapsack(values, lengths, 12)
    assert (use * lengths).sum() <= 12 and np.isclose((use * values).sum(), brute_knapsack(values, lengths, 12))


@given(st.dictionaries(st.integers(1, 16), st.integers(1, 40), min_size=1, max_size=16))
@settings(max_examples=60, deadline=None)
def test_plan_is_exact_and_near_the_bound(hist):
    lengths, counts = np.array(list(hist)), np.array(list(hist.values()))
    plan = packing.plan_packing(lengths, counts, 16)
    got = {}
    for pattern, n in plan:
        assert n > 0 and sum(pattern) <= 16
        for x in pattern:
            got[x] = got.get(x, 0) + n
    assert got == hist
    used, (order,) = sum(n for _, n in plan), [np.argsort(lengths)]
    fractional, bound = packing.configuration_program(lengths[order], counts[order], 16)
    assert bound - 1e-6 <= used <= 1.25 * bound + 2
    cover = sum(x * c for c, x in fractional)
    assert np.allclose(cover, counts[order]) and all((c * lengths[order]).sum() <= 16 for c, _ in fractional)


@pytest.mark.parametrize("scale,best_fit", [("sf0.001", 193), ("sf0.01", 964), ("sf0.1", 9872)])
def test_program_decides(scale, best_fit):
    """On real histograms the fractional cover is within 1 % of the proven bound, most sequences are configurations rounded down, and there
    are no more than by plain best-fit decreasing."""
    import pyarrow.parquet as pq

    ids = packing._encoder("byte_bpe_50k")
    hist = {}
    for text in pq.read_table(f"/root/testdata/{scale}/documents.parquet", columns=["text"])["text"].to_pylist():
        n = len(ids(text or "")) + 1
        for size in [1024] * (n // 1024 if n > 1024 else 0) + [n % 1024 if n > 1024 else n]:
            if size:
                hist[size] = hist.get(size, 0) + 1
    lengths = np.array(sorted(hist))
    counts = np.array([hist[x] for x in lengths.tolist()])
    fractional, bound = packing.configuration_program(lengths, counts, 1024)
    total = sum(x for _, x in fractional)
    used = sum(n for _, n in packing.plan_packing(lengths, counts))
    assert total <= 1.01 * bound and sum(int(x + 1e-6) for _, x in fractional) > 0.9 * used and used <= best_fit


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for off, n in sorted(places):
            assert off == at
            at += n
        assert at <= capacity
    return len(by)


def test_documents(spark, small):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.op2_best_fit_packing(spark, small).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    sequences = check(rows, 1024)
    total, by = 0, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(texts)
    for doc, pieces in by.items():
        ids = np.array([*tok.encode(texts[doc] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(pieces, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert k == 0 or r["length"] == 1024
            at += r["length"]
        assert at == len(ids)
        total += at
    assert sequences <= -(-total // 1024) * 1.01 + 2


def test_edge_cases(spark):
    """Nulls, empty and special strings, repeated rows, clashing columns."""
    data = [(1, None, 5, 5), (1, None, 5, 5), (2, "", 0, 0), (None, "a <|endoftext|> b", 0, 0), (3, "word " * 3000, 0, 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, length int, offset int")
    rows = packing.pack_documents(df, 64).collect()
    check(rows, 64)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = [r for r in rows if r["doc_id"] is None]
    assert special[0]["ids_crc32"] == zlib.crc32(np.array([*tok.encode("a <|endoftext|> b", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sum(r["doc_id"] == 1 and r["length"] == 1 for r in rows) == 2
    assert packing.pack_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("lengths", [[1024] * 5, [1] * 3000, [513] * 7])
def test_equal_lengths(spark, lengths):
    df = spark.createDataFrame([(i, 0, n, 7) for i, n in enumerate(lengths)], "doc_id long, piece int, length long, extra int")
    rows = packing.pack(df).collect()
    assert len(rows) == len(lengths) and check(rows, 1024) == {1024: 5, 1: 3, 513: 7}[lengths[0]]
    assert all(r["extra"] == 7 for r in rows)
