"""Gridding of a stream: running sums of each cell, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwave.operators.grid import GridSpec


def stream_table(spark: SparkSession, folder: str, like: DataFrame, files_a_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as they come, with the schema of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def stream_cells(rows: DataFrame, grid: GridSpec, keys: list[str], value: Column, time: str, late: str = "2 hours") -> DataFrame:
    """keys, i0.., hour (window start), n, total, z (mean): cells of an hour close when the watermark passes it; state is one row a cell
    and open hour. rows: keys, i0.. and a timestamp column."""
    inside = rows
    for a, n in enumerate(grid.shape):
        inside = inside.where((F.col(f"i{a}") >= 0) & (F.col(f"i{a}") < n))
    by = [*keys, *grid.axes("i")]
    sums = inside.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("_w"), *by).agg(F.count(value).alias("n"), F.sum(value).alias("total"))
    return sums.select(*by, F.col("_w.start").alias("hour"), "n", "total", (F.col("total") / F.col("n")).alias("z"))
