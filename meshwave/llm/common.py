"""Shared pieces: the scratch folder all executors see, staged tables, and vectorised word hashing.

Words are maximal runs of bytes other than ASCII white space; ASCII letters compare without case. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
BATCH = 2 << 20
HOT_KEYS = 1000
LEAST_HOT = 2000
FILTER_BITS = 26
SIMILARITY = 0.8
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_OWN: dict[str, str] = {}
_STAGED: list[str] = []
_POWERS: dict[str, np.ndarray] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset in local mode (tests), one temporary folder for the session. A cluster must
    set it: a folder of the driver's machine would not do."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        root = _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="meshwave-scratch-") if spark.sparkContext.applicationId not in _OWN else "")
    return root.rstrip("/")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, outlives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def keep_track(path: str) -> None:
    """Let release() delete the folder too."""
    _STAGED.append(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for t in tables:
        path = getattr(t, "staged_path", None)
        if path in _STAGED:
            _STAGED.remove(path)
            _delete(t.sparkSession, path)


def staged() -> int:
    """How many folders this process has staged and not deleted."""
    return len(_STAGED)


def release(spark: SparkSession, since: int = 0, but: int = 0) -> int:
    """Delete the folders that this process has staged, those after the first `since` and but for the last `but`, once results that read
    them are written; returns how many."""
    gone = _STAGED[since : len(_STAGED) - but]
    for path in gone:
        _STAGED.remove(path)
        _delete(spark, path)
    return len(gone)


def lookup(left: DataFrame, right: DataFrame, key: str, n: str = "n") -> DataFrame:
    """left joined with right by `key`, which is unique in right; right's column n says how many rows of left have it, and goes.

    Keys with over 1 in HOT_KEYS of these rows, fewer than HOT_KEYS, are broadcast; the rest meet in a shuffle. So no key gathers many rows.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    most = max(total // HOT_KEYS, LEAST_HOT)
    hot, rest = right.where(F.col(n) > most).drop(n), right.where(F.col(n) <= most).drop(n)
    if not hot.head(1):
        return left.join(rest, key)
    return left.join(F.broadcast(hot), key).union(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of a well-known hash, on uint64 arrays."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("r")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for key, base in (("r", _R), ("inv", _R_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[key] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["r"], _POWERS["inv"]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (nulls empty) and the n + 1 offsets."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of about `limit` text bytes; a longer text stands alone."""
    _, offsets = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, letter: np.ndarray | None = None, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and the first word of each text (n + 1 numbers). letter: which of 256 bytes are in words;
    inside: which places are."""
    n = len(data)
    if inside is None:
        if letter is None:
            letter = np.ones(256, bool)
            letter[[9, 10, 11, 12, 13, 32]] = False
        inside = letter[data]
    first = np.zeros(n + 1, bool)  # a text begins here
    first[offsets] = True
    prev = np.empty(n, bool)
    if n:
        prev[0] = False
        prev[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~prev | first[:n]))
    nxt = np.empty(n, bool)
    if n:
        nxt[-1] = False
        nxt[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~nxt | first[1 : n + 1])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, ASCII letters in lower case: one prefix sum over all bytes."""
    n = len(data)
    r, inv = _powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * r[:n], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, and where each text's begin. A text of 1 to k - 1 words has one shingle: all its words."""
    count = np.diff(first)
    have = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(have)])
    if begin[-1] == 0:
        return np.zeros(0, np.uint64), begin
    at = np.repeat(first[:-1] - begin[:-1], have) + np.arange(begin[-1])
    last = np.repeat(first[1:], have)
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        p = at + i
        inside = p < last
        part = words[np.minimum(p, len(words) - 1)]
        h = h * np.uint64(0xD6E8FEB86659FD93) + np.where(inside, part, np.uint64(0x1234567))
    return mix(h), begin


def give_back() -> None:
    """Return freed memory to the system: a worker that has done its task, and waits for one of another stage, keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_texts(df: DataFrame, column: str, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], limit: int = 1 << 20) -> DataFrame:
    """Run make()'s function over slices of about `limit` bytes of `column`, in Arrow batches of BATCH bytes. One task holds one batch
    and one slice at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))

    def run(batches):
        f = make()
        for batch in batches:
            for part in chunks(batch, column, limit):
                out = f(part)
                if out is not None and out.num_rows:
                    yield out
            pa.default_memory_pool().release_unused()
        give_back()

    return df.mapInArrow(run, schema)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def hash_long(x: np.ndarray, seed: int) -> np.ndarray:
    """Spark's xxhash64 of a long column behind a prefix whose hash is `seed`."""
    h = np.uint64((seed + int(_P5) + 8) & 0xFFFFFFFFFFFFFFFF) ^ (_turn(x.astype(np.int64).view(np.uint64) * _P2, 31) * _P1)
    h = _turn(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def id_filter(ids: DataFrame, column: str = "doc_id") -> Callable[[np.ndarray], np.ndarray]:
    """A test of arrays of ids, to run in tasks: true for the ids (distinct, of that column) and for few others. An exact join follows it.

    It is a Bloom filter of 16 bits an id, at most 2^FILTER_BITS bits (8 MB). With more ids than that is good for it is true more
    often, at last always.
    """
    spark = ids.sparkSession
    bits = min(FILTER_BITS, max(10, int(np.ceil(np.log2(16 * max(ids.count(), 1))))))
    seeds = [int(x) for x in spark.range(1).select(*(F.xxhash64(F.lit(i)) for i in range(4))).first()]
    slots = F.array(*(F.pmod(F.xxhash64(F.lit(i), F.col(column).cast("long")), F.lit(1 << bits)) for i in range(4)))
    rows = ids.select(F.explode(slots).alias("_s")).groupBy(F.shiftright("_s", 5).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("_s"), F.lit(32)).cast("int"))).alias("bits")).toPandas()
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.uint32)
    handed = spark.sparkContext.broadcast(table)

    def has(x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for seed in seeds:
            at = (hash_long(x, seed) & np.uint64((1 << bits) - 1)).astype(np.int64)
            out &= (handed.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1
        return out

    return has


def maybe_in(has: Callable[[np.ndarray], np.ndarray], column: str = "doc_id"):
    """id_filter's test as a predicate on a column; false for nulls."""

    @F.pandas_udf("boolean")
    def test(x: pd.Series) -> pd.Series:
        return pd.Series(has(x.to_numpy(np.int64)))

    return F.col(column).isNotNull() & test(F.coalesce(F.col(column), F.lit(0)).cast("long"))


def only_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    return docs.where(maybe_in(id_filter(ids, column), column))
