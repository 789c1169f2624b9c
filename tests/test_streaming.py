"""Streams give what the same plan gives on the whole table."""

from pyspark.sql import functions as F

from tessella.streaming import windows


def test_windowed_counts(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = windows.read_events(spark, f"{tmp_path}/in", table.schema)
    counts = windows.windowed_counts(stream, "ts", "event_type", "1 hour", "3650 days")
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["window_start"], r["event_type"]): r["n"] for r in spark.table("counts").collect()}
    want = {(r["w"], r["event_type"]): r["n"] for r in table.groupBy(F.window("ts", "1 hour")["start"].alias("w"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want
