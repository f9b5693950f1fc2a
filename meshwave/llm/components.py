"""Connected components by alternating large and small stars, in DataFrame joins; no link or label reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwave.llm.common import drop_staged, stage_table

#: Neighbours of one id are dealt over so many keys where they meet its smallest one.
SALT = 16


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.when(F.col("hub"), 1).otherwise(0))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) to (id, component): component is the smallest id it holds. Ids without edges, nulls and loops are left out.
    Rounds are logarithmic in the longest path; a hub's rows are spread over SALT keys."""
    salt = F.pmod(F.xxhash64("b"), F.lit(SALT)).cast("int").alias("_salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt")
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stage_table(now.withColumn("hub", F.lit(True)), "edges")
    before = None
    while True:
        # large star: each larger neighbour goes to the smallest one
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.select("a", "b", salt).join(low.select("a", "low", salts), ["a", "_salt"]).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        # small star: of an id's smaller neighbours, all go to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.select("a", "b", salt).join(least.select("a", "low", salts), ["a", "_salt"])
        small = small.select("a", F.col("low").alias("b")).union(small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))).distinct()
        last, now = now, stage_table(small.withColumn("hub", F.lit(True)), "edges")
        drop_staged(last)
        state = _state(now)
        if state == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
        before = state
