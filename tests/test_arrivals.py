"""Rows of a stream wait in tables, and arriving parts of many rows come in several files."""

import os

from pyspark.sql import functions as F

from threatflow.catalog import streams
from threatflow.plans.session import shared_dir
from threatflow.streaming import inorder

SECOND = 1_000_000


def batch(spark, *times):
    return spark.createDataFrame([(t * SECOND, t) for t in times], "ts_us long, packet_id long")


def test_rows_wait_in_tables_until_the_watermark_has_passed(spark):
    base = shared_dir(spark, "test-wait")
    reached = []

    def step(rows, carried, upto):
        reached.append(upto // SECOND)
        return rows, {}

    run = inorder.InOrder(spark, "ts_us long, packet_id long", step, base)
    into = inorder.Arrivals(run, "ts_us", "packet_id", "30 seconds")
    batches = [batch(spark, 100, 130, 120), batch(spark, 200, 90), batch(spark, 110, 300), batch(spark, 400)]
    for number in (0, 1, 1, 2, 2, 3):
        into(batches[number], number)
    assert reached == [100, 170, 170, 270, 270, 370]
    assert sorted(r["packet_id"] for r in run.results().collect()) == [100, 120, 130, 200, 300]
    assert sorted(r["id"] for r in run.late().collect()) == ["110", "90"]
    there = [n for n in range(4) if os.path.exists(f"{base}/arrived/{n}/rows")]
    assert there == [2, 3]  # 2 passed in the last micro-batch, which may run again


def test_arriving_parts_come_in_as_many_files(spark, tmp_path):
    events = spark.range(300).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 8000).alias("ts"),
        F.when(F.col("id") < 290, 0).otherwise(F.col("id") % 3).alias("part"),
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    source = streams.arriving(spark, str(tmp_path), F.col("part"), file_rows=50)
    seen = []
    source.writeStream.foreachBatch(lambda rows, number: seen.append(sorted(r["part"] for r in rows.select("part").distinct().collect()))).trigger(
        availableNow=True
    ).option("checkpointLocation", f"{tmp_path}/checkpoint").start().awaitTermination()
    assert seen == [[0], [1], [2]]
