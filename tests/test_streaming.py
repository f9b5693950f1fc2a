from meshwave.sources import fields as src
from meshwave.streaming import grid as S
from pyspark.sql import functions as F


def rows(df):
    return df.select(F.col("event_type").alias("field_id"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("i0"), F.hour("ts").alias("i1"), F.col("ts").cast("timestamp").alias("ts"), "value")


def test_stream_equals_batch(spark, small, tmp_path):
    table = src.table(spark, small, "events")
    table.orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = S.stream_cells(rows(S.stream_table(spark, str(tmp_path / "in"), table)), src.EVENTS, ["field_id"], F.col("value"), "ts", "40 days")
    q = stream.writeStream.format("memory").queryName("cells").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("cells").groupBy("field_id", "i0", "i1").agg(F.max_by("z", "n").alias("z"))
    got = {(r["field_id"], r["i0"], r["i1"]): round(r["z"], 9) for r in last.collect()}
    want = {(r["field_id"], r["i0"], r["i1"]): round(r["z"], 9) for r in src.event_cells(spark, small).collect()}
    assert got == want
