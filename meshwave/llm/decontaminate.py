"""Benchmark leaks by the q-gram lemma over characters.

A region within e edits of an item of m characters shares at least m + 1 - q (e + 1) of its q-grams with it, all on at most e + 1
neighbouring diagonals (place in the text less place in the item). Hits are counted in overlapping bands of 2 (e + 1) diagonals;
bands that reach the bound are retained and aligned within their diagonals. Q is 8, and less for items that are too short for it.

Texts compare as code points in lower case; each run of ASCII characters other than letters and digits is one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwave.llm.common import map_texts, text_bytes

#: An item has the first of these for which the lemma's bound is LEAST at least, or the last one that leaves a bound at all.
QS = (8, 4, 2, 1)
LEAST = 4
EDITS = 0.1
#: UTF-8 bytes of benchmark texts that go to the executors at a time.
BLOCK_BYTES = 8 << 20
#: Hits that are looked at together; what they count is added up.
HITS = 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D


def _fold_table() -> np.ndarray:
    table = np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        low = chr(i).lower()
        if len(low) == 1:
            table[i] = ord(low)
    for i in range(128):
        if not chr(i).isalnum():
            table[i] = 32
    return table


_FOLD = _fold_table()


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded code points, where each text's begin, the first byte of each in data, the byte behind it)."""
    raw = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if len(raw) != len(lead):  # not UTF-8: bytes stand for themselves
        raw, lead = data.astype(np.uint32), np.arange(len(data))
    x = _FOLD[np.minimum(raw, (1 << 16) - 1)]
    high = np.flatnonzero(raw >= (1 << 16) - 1)
    x[high] = raw[high]
    begin = np.searchsorted(lead, offsets)
    space = x == 32
    keep = np.ones(len(x), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    first = begin[:-1][begin[:-1] < len(x)]
    keep[first] = ~space[first]  # no space at the start of a text
    kept = np.flatnonzero(keep)
    ends = np.append(lead[1:], len(data))
    return x[kept], np.searchsorted(kept, begin), lead[kept], ends[kept]


def grams(x: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit number for the q-gram (q: a power of two) at each place, equal for equal ones."""
    if len(x) < q:
        return np.zeros(0, np.uint64)
    h, n = x.astype(np.uint64), 1
    while n < q:
        h = h[:-n] * np.uint64(pow(_BASE, n, 1 << 64)) + h[n:]
        n *= 2
    return h


@dataclass
class Index:
    """The items of one q."""

    q: int
    ids: list
    items: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    gram: np.ndarray  # sorted, with repeats
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray
    shift: np.uint64


def _q_of(m: int, e: int) -> int:
    for q in QS:
        if m + 1 - q * (e + 1) >= LEAST:
            return q
    return next(q for q in QS if m + 1 - q * (e + 1) >= 1)


def index_items(rows: list[tuple], edits: float = EDITS) -> list[Index]:
    """rows of (item_id, text). The edit budget of an item of m characters after folding is floor(m * edits), at most m - 1; items
    that fold to nothing, and null texts, match nothing."""
    by_q: dict[int, list] = {}
    for item_id, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        x, *_ = fold(data, np.array([0, len(data)]))
        if len(x) and x[-1] == 32:
            x = x[:-1]
        if len(x):
            e = min(int(len(x) * edits), len(x) - 1)
            by_q.setdefault(_q_of(len(x), e), []).append((item_id, x, e))
    out = []
    for q, own in sorted(by_q.items(), reverse=True):
        m, e = np.array([len(x) for _, x, _ in own], np.int64), np.array([e for *_, e in own], np.int64)
        g = [grams(x, q) for _, x, _ in own]
        gram, item, place = np.concatenate(g), np.repeat(np.arange(len(g)), [len(x) for x in g]), np.concatenate([np.arange(len(x)) for x in g])
        order = np.argsort(gram, kind="stable")
        bits = int(np.clip(np.ceil(np.log2(24 * len(gram))), 12, 26))
        table = np.zeros(1 << bits, bool)
        table[((gram * _MUL) >> np.uint64(64 - bits)).astype(np.int64)] = True
        out.append(Index(q, [i for i, *_ in own], [x for _, x, _ in own], e, m + 1 - q * (e + 1), gram[order], item[order], place[order], table, np.uint64(64 - bits)))
    return out


def banded_alignments(x: np.ndarray, items: list[np.ndarray], item: np.ndarray, edits: np.ndarray, low: np.ndarray, width: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end in x) of candidates: the part of x[begin:end] nearest to the whole item along the diagonals low..low + width - 1
    (place in x less place in the item); edits is -1 where it takes more than `edits`. Ties: the earliest end, then the latest start.

    All candidates advance together, one character of the items at a time; a row has the widest band's cells.
    """
    n = len(item)
    size = np.array([len(items[i]) for i in item.tolist()], np.int64)
    order = np.argsort(-size, kind="stable")
    item, edits, low, width, begin, end, size = (z[order] for z in (item, edits, low, width, begin, end, size))
    w = int(width.max())
    k = np.arange(w)
    inf = np.int32(1 << 20)
    flat = np.full((n, int(size[0])), np.uint32(0xFFFFFFFF))
    for r, i in enumerate(item.tolist()):
        flat[r, : size[r]] = items[i]
    at = low[:, None] + k  # the place in x that the first character of the item meets
    cost = np.where((k < width[:, None]) & (at >= begin[:, None]) & (at <= end[:, None]), 0, inf).astype(np.int32)
    origin = at.copy()
    best, first, last = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    top = len(x) - 1
    live = n
    for i in range(int(size[0])):
        live = int(np.searchsorted(-size, -i, side="left"))  # items of over i characters
        cost, origin, at = cost[:live], origin[:live], at[:live]
        there = (at >= begin[:live, None]) & (at < end[:live, None])
        same = there & (x[np.clip(at, 0, top)] == flat[:live, i][:, None])
        step = np.where(there, cost + ~same, inf)  # along a diagonal: one more character of both
        came = origin
        skip = np.full((live, w), inf, np.int32)  # a character of the item alone: from the next diagonal
        skip[:, :-1] = cost[:, 1:] + 1
        less = skip < step
        came = came.copy()
        came[:, :-1] = np.where(less[:, :-1], origin[:, 1:], came[:, :-1])
        step = np.where(less, skip, step)
        # characters of the text alone run along the row: the least of step[j] + (k - j) over j <= k
        run = step - k
        low_run = np.minimum.accumulate(run, 1)
        source = np.maximum.accumulate(np.where(run == low_run, k, 0), 1)
        cost = np.minimum(low_run + k, inf).astype(np.int32)
        cost[(k >= width[:live, None])] = inf
        origin = np.take_along_axis(came, source, 1)
        at = at + 1  # the place behind the last character used
        done = np.flatnonzero(size[:live] == i + 1)
        if len(done):
            j = cost[done].argmin(1)
            c = cost[done, j]
            ok = c <= edits[done]
            best[done[ok]], first[done[ok]], last[done[ok]] = c[ok], origin[done, j][ok], at[done, j][ok]
    back = np.argsort(order)
    return best[back], first[back], last[back]


def _hits(g: np.ndarray, begin: np.ndarray, index: Index) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, item, diagonal), at most about HITS at a time."""
    maybe = np.flatnonzero(index.table[((g * _MUL) >> index.shift).astype(np.int64)])
    lo = np.searchsorted(index.gram, g[maybe], side="left")
    ok = (lo < len(index.gram)) & (index.gram[np.minimum(lo, len(index.gram) - 1)] == g[maybe])
    maybe, lo = maybe[ok], lo[ok]
    text = np.searchsorted(begin, maybe, side="right") - 1
    ok = maybe + index.q <= begin[text + 1]
    maybe, lo, text = maybe[ok], lo[ok], text[ok]
    count = np.searchsorted(index.gram, g[maybe], side="right") - lo
    total = np.concatenate([[0], np.cumsum(count)])
    i = 0
    while i < len(maybe):
        j = max(i + 1, int(np.searchsorted(total, total[i] + HITS, side="right")) - 1)
        n = count[i:j]
        posting = np.repeat(lo[i:j] - (total[i:j] - total[i]), n) + np.arange(int(n.sum()))
        t = np.repeat(text[i:j], n)
        yield t, index.item[posting], np.repeat(maybe[i:j], n) - begin[t] - index.place[posting]
        i = j


def leaks_in(x: np.ndarray, begin: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end) in folded characters, by text and item; of regions that overlap the one of fewest edits, then the
    first. Memory: HITS hits, and a count for each text, item and band that has one."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    items = len(index.ids)
    # a band's key: the text's and item's number, and the band, of which a text has fewer than its length and the item's
    most = int(np.diff(begin).max(initial=0) + max(map(len, index.items))) + 2
    base = most + 2
    for text, item, diagonal in _hits(grams(x, index.q), begin, index):
        band = np.floor_divide(diagonal, index.edits[item] + 1) + most
        pair = (text * items + item) * (2 * base)
        key = np.concatenate([keys, pair + band, pair + band - 1])
        weight = np.concatenate([counts, np.ones(2 * len(band), np.int64)])
        keys, inverse = np.unique(key, return_inverse=True)
        counts = np.bincount(inverse, weights=weight, minlength=len(keys)).astype(np.int64)
    pair, band = keys // (2 * base), keys % (2 * base) - most
    text, item = pair // items, pair % items
    ok = counts >= index.bound[item] if len(keys) else np.zeros(0, bool)
    text, item, band = text[ok], item[ok], band[ok]
    out: list[tuple[int, int, int, int, int]] = []
    for i in range(0, len(text), 1024):
        t, k, b = text[i : i + 1024], item[i : i + 1024], band[i : i + 1024]
        e = index.edits[k]
        cost, first, last = banded_alignments(x, index.items, k, e, begin[t] + b * (e + 1), 2 * (e + 1), begin[t], begin[t + 1])
        got = np.flatnonzero(cost >= 0)
        out += zip(t[got].tolist(), k[got].tolist(), cost[got].tolist(), first[got].tolist(), last[got].tolist(), strict=True)
    best: list[tuple[int, int, int, int, int]] = []
    for r in sorted(out, key=lambda r: (r[0], r[1], r[3], r[4])):
        if best and best[-1][:2] == r[:2] and r[3] < best[-1][4]:
            if r[2] < best[-1][2]:
                best[-1] = r
        else:
            best.append(r)
    return best


def _blocks(benchmark: DataFrame, edits: float) -> Iterator:
    """The indexes of the benchmark's items, broadcast in blocks of about BLOCK_BYTES of text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield benchmark.sparkSession.sparkContext.broadcast(index_items([(r["item_id"], r["text"]) for r in part.collect()], edits))


LEAKS = "doc_id long, item_id long, edits int, start_byte long, end_byte long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """doc_id, item_id, edits, start_byte, end_byte (in the UTF-8 text): the regions of docs (doc_id, text) within floor(m * edits) edits
    of a whole item of benchmark (item_id, text) of m characters, both folded.

    Items of any length count; an item of under 10 characters has no edits. Null and empty texts on either side, and empty tables, give no
    rows; repeated rows and ids give rows each. Long texts are taken whole; repeats within them cost time, not memory. Ties: of regions of one
    item that overlap, the one of fewest edits, then the first. Other columns are not read. The benchmark is a query set: it goes to the
    executors in blocks of about BLOCK_BYTES, each against all documents.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for handed in _blocks(benchmark, edits):

        def make(handed=handed):
            indexes = handed.value

            def f(batch: pa.RecordBatch) -> pa.RecordBatch | None:
                data, offsets = text_bytes(batch.column("text"))
                x, begin, byte, behind = fold(data, offsets)
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[t], index.ids[i], e, int(byte[s] - offsets[t]), int(behind[end - 1] - offsets[t])) for index in indexes for t, i, e, s, end in leaks_in(x, begin, index)]
                if not rows:
                    return None
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "edits", "start_byte", "end_byte"])

            return f

        out = map_texts(own, "text", LEAKS, make)
        found = out if found is None else found.union(out)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """docs without the rows whose text holds an item of the benchmark, as find_leaks sees it; nothing is shuffled."""
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    for handed in _blocks(benchmark, edits):

        def make(handed=handed):
            indexes = handed.value

            def f(batch: pa.RecordBatch) -> pa.RecordBatch:
                x, begin, *_ = fold(*text_bytes(batch.column("text")))
                clean = np.ones(batch.num_rows, bool)
                for index in indexes:
                    clean[[t for t, *_ in leaks_in(x, begin, index)]] = False
                return batch.filter(pa.array(clean))

            return f

        docs = map_texts(docs, "text", schema, make)
    return docs


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
