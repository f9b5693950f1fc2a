"""Fields from tables, masks from images, and parameter rows to and from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwave.operators.grid import GridSpec, grid_rows, resample, standardise

EVENTS = GridSpec((30, 24))
LINES = GridSpec((50, 11, 9))
ORDERS = GridSpec((2405,))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_cells(spark: SparkSession, sf_dir: str, how: str = "avg") -> DataFrame:
    """field_id (event type), i0 (day from 2024-01-01), i1 (hour), z."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("field_id"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("i0"), F.hour("ts").alias("i1"), "value")
    return grid_rows(rows, EVENTS, ["field_id"], F.col("value"), how)


def event_fields(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """field_id, i0, i1, z (standardised), g = 1; all event types, or the given ones, filtered before the aggregation."""
    cells = event_cells(spark, sf_dir)
    return standardise(cells.where(F.col("field_id").isin(*kinds)) if kinds else cells, ["field_id"], 2)


def event_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variates of one field: var 0 (click) and 1 (view)."""
    return event_fields(spark, sf_dir, "click", "view").select(F.when(F.col("field_id") == "click", 0).otherwise(1).alias("var"), "i0", "i1", "z", "g")


def line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i0 (quantity - 1), i1 (discount in percent), i2 (tax in percent), z, g."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("int") - 1).alias("i0"), F.round(F.col("l_discount") * 100).cast("int").alias("i1"), F.round(F.col("l_tax") * 100).cast("int").alias("i2"), "l_extendedprice")
    return standardise(grid_rows(rows, LINES, [], F.col("l_extendedprice")), [], 3)


def vector_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, i0, z, g: one field of 64 cells for each vector."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i0", "z")).select("vec_id", "i0", F.col("z").cast("double").alias("z"), F.lit(1.0).alias("g"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, z: the vectors themselves, as arrays of 64 cells."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("z"))


def order_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i0 (day from 1995-01-01), z (orders that day, standardised), g."""
    rows = table(spark, sf_dir, "orders").select(F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("i0"))
    return standardise(grid_rows(rows, ORDERS, [], F.lit(1), "count"), [], 1)


def image_mask(spark: SparkSession, path: str, target: GridSpec | None = None, margin: int = 0) -> DataFrame:
    """i0, i1, g: 1 where the first channel of an image is 0 (rows counted from the bottom), within a margin; resampled to target if given."""
    img = spark.read.format("image").load(path).select("image.height", "image.width", "image.nChannels", "image.data")
    pixels = img.select("height", "width", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("_y"))
    pixels = pixels.select("height", "width", "_y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("i1"), "nChannels", "data")
    value = F.hex(F.substring(F.col("data"), (F.col("_y") * F.col("width") + F.col("i1")) * F.col("nChannels") + 1, F.lit(1)))
    inside = (F.col("_y") >= margin) & (F.col("_y") < F.col("height") - margin) & (F.col("i1") >= margin) & (F.col("i1") < F.col("width") - margin)
    mask = pixels.where(inside).select((F.col("height") - 1 - margin - F.col("_y")).alias("i0"), (F.col("i1") - margin).alias("i1"), F.when(value == "00", 1.0).otherwise(0.0).alias("g"))
    if target is None:
        return mask
    size = img.select("height", "width").first()
    return resample(mask, GridSpec((size[0] - 2 * margin, size[1] - 2 * margin)), target)


def write_theta(theta: DataFrame, path: str, form: str = "parquet") -> None:
    """Parameter rows to parquet or json."""
    theta.write.format(form).save(path)


def read_theta(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.format(form).load(path)


def write_npy(field: DataFrame, grid: GridSpec, key: str, value: str, folder: str) -> DataFrame:
    """Each field (key, i0.., value) as <key>.npy in a folder that all executors see; returns (key, path). Files are replaced as wholes,
    so a task may run again."""
    import io
    import os

    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(grid.shape)
        x[tuple(pdf[f"i{a}"].to_numpy() for a in range(grid.ndim))] = pdf[value].to_numpy()
        name = str(pdf[key].iloc[0])
        path, data = f"{folder}/{name}.npy", io.BytesIO()
        np.save(data, x)
        plain = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
        if "://" in plain:
            from pyarrow import fs

            store, inner = fs.FileSystem.from_uri(plain)
            with store.open_output_stream(inner) as out:
                out.write(data.getvalue())
        else:
            os.makedirs(os.path.dirname(plain), exist_ok=True)
            with open(f"{plain}.{os.getpid()}.part", "wb") as out:
                out.write(data.getvalue())
            os.replace(f"{plain}.{os.getpid()}.part", plain)
        return pd.DataFrame({key: [name], "path": [path]})

    return field.groupBy(key).applyInPandas(run, f"{key} string, path string")


def read_npy(spark: SparkSession, folder: str, ndim: int) -> DataFrame:
    """name, i0.., z of the .npy files of a folder."""
    import io

    import numpy as np
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                x = np.load(io.BytesIO(content))
                at = np.indices(x.shape).reshape(x.ndim, -1).astype(np.int32)
                yield pd.DataFrame({"name": path.rpartition("/")[2].removesuffix(".npy")} | {f"i{a}": at[a] for a in range(ndim)} | {"z": x.ravel().astype(float)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder).select("path", "content")
    return files.mapInPandas(run, "name string, " + "".join(f"i{a} int, " for a in range(ndim)) + "z double")
