import numpy as np
import pyarrow as pa
from meshwave.llm import common as C
from pyspark.sql import functions as F


def test_hash_is_sparks(spark):
    df = spark.range(1000).select((F.col("id") * 987654321 - 10**11).alias("x"))
    rows = df.select("x", F.xxhash64(F.lit(3), "x").alias("h"), F.xxhash64(F.lit(3)).alias("seed")).collect()
    got = C.hash_long(np.array([r["x"] for r in rows]), rows[0]["seed"]).view(np.int64)
    assert got.tolist() == [r["h"] for r in rows]


def test_filter_has_all_ids(spark):
    ids = spark.range(0, 5000, 7).withColumnRenamed("id", "doc_id")
    docs = spark.range(5000).select(F.when(F.col("id") > 10, F.col("id")).alias("doc_id"))
    got = {r["doc_id"] for r in C.only_ids(docs, ids).collect()}
    want = {x for x in range(0, 5000, 7) if x > 10}
    assert want <= got and len(got) < 1.1 * len(want) and None not in got
    assert C.only_ids(docs, ids.limit(0)).count() == 0


def test_words_and_shingles():
    texts = ["One  two\nthree", None, "", " ÉTÉ été ", "a b c d e f", "x" * 5000 + " y"]
    data, offsets = C.text_bytes(pa.array(texts))
    starts, ends, first = C.word_bounds(data, offsets)
    raw = data.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first, first[1:], strict=False)]
    assert got == [(t or "").split() for t in texts]
    h = C.word_hashes(data, starts, ends)
    other = C.text_bytes(pa.array(["ONE TWO b"]))
    h2 = C.word_hashes(other[0], *C.word_bounds(*other)[:2])
    assert h2.tolist() == [h[0], h[1], h[first[4] + 1]] and len(set(h.tolist())) == len(h)
    s, begin = C.shingles(h, first)
    assert np.diff(begin).tolist() == [1, 0, 0, 1, 2, 1] and len(set(s.tolist())) == 5


def test_slices_cover_long_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, "b" * 1000, None, "", "c"])], names=["text"])
    parts = list(C.chunks(batch, "text", 50))
    assert [p.num_rows for p in parts] == [1, 1, 3]


def test_release(spark):
    staged = C.stage_table(spark.range(3).toDF("x"), "three")
    assert staged.count() == 3
    assert C.release(spark) >= 1 and C.release(spark) == 0
