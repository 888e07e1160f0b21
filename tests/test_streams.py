"""Streams fed in several files give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from threatflow.operators import correlate, rate
from threatflow.plans import views
from threatflow.plans.session import shared_dir
from threatflow.streaming import jobs, scoring, upsert

SF = "/root/testdata/sf0.001"
DAY = 86_400


@pytest.fixture(scope="module")
def feed(spark):
    """The events in four files, in time order, as a stream of four batches."""
    base = shared_dir(spark, "test-feed")
    events = views.table(spark, SF, "events")
    ordered = events.orderBy("ts", "event_id").collect()
    step = len(ordered) // 4 + 1
    for i in range(4):
        part = spark.createDataFrame(ordered[i * step : (i + 1) * step], events.schema)
        part.coalesce(1).write.mode("append").parquet(base)
    return lambda: jobs.read_table(spark, base, files_per_batch=1)


def rows(df, *cols):
    df = df.select(*cols) if cols else df.select(sorted(df.columns))
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())


def test_store_is_idempotent(spark, feed):
    base = shared_dir(spark, "test-store")
    alerts = views.as_alerts(feed()).select("alert_id", "ts_us", "source_ip")
    for i in range(2):
        # a lost checkpoint replays all batches into the same folders
        jobs.store_batches(alerts, f"{base}/alerts", f"{base}/checkpoint{i}").awaitTermination()
    assert jobs.stored_alerts(spark, f"{base}/alerts").count() == views.alerts(spark, SF).count()


def test_late_rows_are_counted(spark):
    base = shared_dir(spark, "test-late")
    hour = 3_600_000_000
    for ts in ([hour, 2 * hour], [9 * hour], [10 * hour], [hour + 1], [20 * hour]):
        spark.createDataFrame([(t, "x") for t in ts], "ts_us long, k string").coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = jobs.read_table(spark, f"{base}/in", files_per_batch=1)
    query = (
        jobs.tumbling_counts(stream, ["k"]).writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", f"{base}/checkpoint").start(f"{base}/out")
    )
    query.awaitTermination()
    assert jobs.late_rows(query) == 1
    out = spark.read.parquet(f"{base}/out")
    assert rows(out, "start_us", "n") == sorted(repr([h * hour, 1]) for h in (1, 2, 9, 10))


def test_joined_partners(spark, feed):
    """The join of two streams counts what the rolling windows count; the file source alone leaves windows open."""
    events = views.table(spark, SF, "events")
    source = jobs.read_table(spark, f"{SF}/events.parquet")
    got = jobs.run_closed(source, lambda e: jobs.joined_partners(views.as_alerts(e), DAY / 2), "t", stages=2)
    want = correlate.correlations(views.as_alerts(events), DAY / 2).withColumn("attacks", F.array_join("attack_types", ","))
    assert rows(got, "alert_id", "partners", "attacks") == rows(want, "alert_id", "partners", "attacks") != []


def test_key_table_reads_a_base_and_the_changes_after_it(spark):
    day = 86_400_000_000
    base = shared_dir(spark, "test-keys")
    table = upsert.KeyTable(spark, base, buckets=3, every=3, late_s=5 * 86_400)
    kinds = "key string, ts_us long, deleted boolean, note int"

    def change(*rows):
        return spark.createDataFrame([(k, t * day, d, n) for k, t, d, n in rows], kinds)

    batches = [
        change(("a", 1, False, 1), ("b", 1, False, 2), ("a", 2, False, 3), (None, 1, False, 4)),
        change(("b", 3, True, 5), ("c", 3, False, 6), ("c", 3, True, 7)),
        change(("b", 2, False, 8), ("d", 9, False, 9)),
        change(("e", 4, None, 10), ("a", 1, False, 11)),
        change(("b", 10, False, 12)),
    ]
    assert table.current() is None
    for number, batch in enumerate(batches):
        for _ in range(2 if number in (1, 4) else 1):
            table.apply(batch, number)  # twice, as after a lost executor
    assert table._numbers("base") == [2] and table._numbers("changes") == [0, 1, 2, 3, 4]
    folders = {f.rsplit("/part-", 1)[0].split(base)[1].split("/bucket")[0] for f in table._read().inputFiles()}
    assert folders == {"/base/2", "/changes/3", "/changes/4"}
    live = {r["key"]: r["note"] for r in table.current().collect()}
    assert live == {"a": 3, "d": 9, "e": 10, "b": 12, None: 4}
    # deletions older than what may still come have left the base
    assert {r["key"] for r in spark.read.parquet(f"{base}/base/2").where("deleted").collect()} == set()
    table.apply(batches[0], 0)
    assert {r["key"]: r["note"] for r in table.current().collect()} == live
    table.compact()
    assert table._numbers("base") == [2, 4] and {r["key"]: r["note"] for r in table.current().collect()} == live


def test_thresholds_have_versions(spark):
    path = shared_dir(spark, "test-thresholds")
    assert scoring.current_threshold(spark, path, "m") is None
    assert [scoring.set_threshold(spark, path, "m", t) for t in (0.7, 0.2)] == [1, 2]
    scoring.set_threshold(spark, path, "other", 0.9)
    assert tuple(scoring.current_threshold(spark, path, "m")) == (2, "m", 0.5)


def test_scores_in_a_stream_follow_the_threshold(spark):
    from threatflow.operators import models

    base = shared_dir(spark, "test-scores")
    rows = spark.range(400).select(F.col("id").alias("packet_id"), (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 20 >= 15).cast("int").alias("y"))
    model = models.train_classifier(rows, ["a"], n_estimators=8)
    model.save(spark, f"{base}/model")
    for part in (rows.where("packet_id < 200"), rows.where("packet_id >= 200")):
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")

    def run():
        stream = jobs.read_table(spark, f"{base}/in", files_per_batch=1)
        scoring.score_batches(stream, ["a"], f"{base}/model", f"{base}/thresholds", "m", f"{base}/alerts", f"{base}/checkpoint").awaitTermination()
        return spark.read.parquet(f"{base}/alerts")

    scoring.set_threshold(spark, f"{base}/thresholds", "m", 0.2)
    want = models.classifier_alerts(models.score(model, rows, ["a"]), 0.5)
    got = run()
    assert rows_of(got) == rows_of(want) and got.count() == 100
    scoring.set_threshold(spark, f"{base}/thresholds", "m", 0.999)
    rows.withColumn("packet_id", F.col("packet_id") + 1000).coalesce(1).write.mode("append").parquet(f"{base}/in")
    assert run().where("version = 2").count() == 0 and run().count() == 100


def rows_of(df):
    return sorted((r["packet_id"], r["confidence"]) for r in df.collect())


def test_histograms_merge(spark):
    """Quantiles of merged histograms are those of the histogram of all rows, and lie in the right bucket."""
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), ((F.col("id") * 37) % 101).cast("double").alias("v"))
    borders = [10, 25, 50, 75, 100]
    parts = df.groupBy("k").agg(*rate.bucket_counts("v", borders))
    merged = rate.merged_counts(parts, borders).select(rate.bucket_quantile(borders, 0.9).alias("q")).first()["q"]
    whole = rate.histogram_quantile(df, "v", borders, 0.9).first()
    exact = df.agg(F.percentile("v", 0.9)).first()[0]
    assert merged == whole["quantile"] and whole["n"] == 1000 and abs(merged - exact) < 3
    none = df.where("v < 0").agg(*rate.bucket_counts("v", borders)).select(rate.bucket_quantile(borders, 0.9).alias("q"))
    assert none.first()["q"] is None
    assert df.agg(rate.distinct_about(F.col("k").cast("string")).alias("n")).first()["n"] == 7
    assert df.where("k < 0").agg(rate.distinct_about(F.col("k")).alias("n")).first()["n"] == 0


def test_joined_partners_of_a_burst(spark):
    """Sixty thousand alerts between two addresses within a window; a row per pair would be 3.6 billion rows."""
    n = 60_000
    rows = spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.floor(F.col("id") / 10)).alias("ts"), F.when(F.col("id") > 0, "a").otherwise("b").alias("kind")
    )
    base = jobs.shared_dir(spark, "burst")
    rows.write.parquet(base)

    def build(e):
        return jobs.joined_partners(
            e.select(
                F.col("event_id").alias("alert_id"), F.unix_micros("ts").alias("ts_us"), F.lit("1").alias("source_ip"),
                F.lit("2").alias("dest_ip"), F.col("kind").alias("attack_type"),
            ), 1000.0
        )

    out = jobs.run_closed(jobs.read_table(spark, base), build, "burst-joined")
    # ten a second, those of the second a window ago are too old
    first = F.greatest((F.floor(F.col("alert_id") / 10) - 999) * 10, F.lit(0))
    wrong = (F.col("partners") != 2 * (F.col("alert_id") - first)) | (F.col("attacks") != F.when(first == 0, "a,b").otherwise("a"))
    got = out.agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("wrong")).first()
    assert (got["n"], got["wrong"]) == (n - 1, 0)


def test_joined_partners_of_equal_alerts(spark):
    """Rows of one time and id don't count for each other, and all copies count; times border on the window."""
    at = [0, 1, 9, 9, 10, 10, 11, 19, 20, 20, 21, 30, 40, 41]
    rows = [(i // 2, t * jobs.SECOND, s, d, k) for i, t in enumerate(at) for s, d, k in [("1", "2", "x"), ("1", "", None), ("3", "2", "y")][: 1 + i % 3]]
    base = jobs.shared_dir(spark, "equal")
    schema = "alert_id bigint, ts_us bigint, source_ip string, dest_ip string, attack_type string"
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("ts_us").cast("timestamp_ntz")).write.parquet(base)

    def build(e):
        return jobs.joined_partners(e.withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp"))), 10.0)

    got = jobs.run_closed(jobs.read_table(spark, base), build, "equal-joined")
    want = {}
    for i, t, s, d, k in rows:
        for j, u, s2, d2, k2 in rows:
            for x, y in ((s, s2), (d or f"#{i}", d2 or f"#{j}")):
                if x == y and u > t - 10 * jobs.SECOND and (u, j) < (t, i):
                    n, kinds = want.setdefault((t, i, k), (0, {k}))
                    want[t, i, k] = (n + 1, kinds | {k2})
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, n, ",".join(sorted(x for x in kinds if x))) for (_, i, _), (n, kinds) in want.items())
