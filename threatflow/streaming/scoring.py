"""Scoring a stream: a saved model per micro-batch, at the threshold in force."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from threatflow.operators import boosting, models

THRESHOLDS = "version bigint, model string, threshold double"


def set_threshold(spark: SparkSession, path, model, threshold, least=0.5):
    """Add a version of a model's threshold (never below the floor for live use) and return its number."""
    value = models.runtime_threshold(threshold, least)
    last = current_threshold(spark, path, model)
    version = (last["version"] if last else 0) + 1
    spark.createDataFrame([(version, model, value)], THRESHOLDS).coalesce(1).write.mode("append").parquet(path)
    return version


def current_threshold(spark: SparkSession, path, model):
    """The newest version of a model's threshold: a row, or None."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    rows = spark.read.schema(THRESHOLDS).parquet(path).where(F.col("model") == model)
    return rows.orderBy(F.desc("version")).first()


def score_batches(stream: DataFrame, features, model_path, thresholds_path, model, path, checkpoint):
    """Write the alerts of each micro-batch under its number, with probability, threshold and its version.

    The model is read once per run, the threshold anew for each micro-batch, so a policy can move it while the
    stream runs. A micro-batch that runs again replaces what it wrote.
    """
    spark = stream.sparkSession
    trees = boosting.BoostedTrees.load(spark, model_path)

    def write(batch, number):
        force = current_threshold(spark, thresholds_path, model)
        if force is None:
            raise ValueError(f"no threshold of {model} in {thresholds_path}")
        found = models.classifier_alerts(models.score(trees, batch, features), force["threshold"])
        found.withColumn("threshold", F.lit(force["threshold"])).withColumn("version", F.lit(force["version"])).write.mode(
            "overwrite"
        ).parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
