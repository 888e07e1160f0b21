"""A table of keys that a stream updates: a base in buckets of keys, the changes since, and compaction."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from threatflow.operators.respond import latest_per_key


class KeyTable:
    """The last change of each key (columns key, ts_us, deleted and others) below ``path``.

    ``changes/<number>`` holds the last changes of a micro-batch's keys, ``base/<number>`` all keys up to that
    micro-batch, both in files by bucket of the key. Reading takes the newest base and the changes after it, never the
    whole log. A micro-batch that runs again replaces its changes, or does nothing if a base holds them.
    """

    def __init__(self, spark: SparkSession, path, buckets=16, every=10, late_s=7 * 86_400):
        self.spark, self.path, self.buckets, self.every, self.late_us = spark, path, buckets, every, int(late_s * 1_000_000)

    def _numbers(self, folder):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        done = [s.getPath() for s in fs.listStatus(where)]
        success = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName()) for p in done if p.getName().isdigit() and fs.exists(success(p, "_SUCCESS")))

    def _write(self, rows, folder):
        # one file per bucket, whatever the number of keys
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))
        rows.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")

    def _newest(self, rows):
        """One row per key: the last by time, of equally late ones a deletion."""
        rest = [c for c in rows.columns if c != "key"]
        last = rows.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("ts_us", F.coalesce("deleted", F.lit(False)))).alias("_s"))
        return last.select("key", "_s.*")

    def _read(self, number=None):
        """The newest base and the changes after it, up to ``number``; None if there is nothing."""
        def upto(folder):
            return [n for n in self._numbers(folder) if number is None or n <= number]

        base = upto("base")[-1:]
        since = [n for n in upto("changes") if not base or n > base[0]]
        folders = [f"{self.path}/base/{n}" for n in base] + [f"{self.path}/changes/{n}" for n in since]
        parts = [self.spark.read.parquet(f).drop("bucket") for f in folders]
        whole = None
        for part in parts:
            whole = part if whole is None else whole.unionByName(part)
        return whole

    def apply(self, batch: DataFrame, number):
        """Take in a micro-batch of changes; every so many of them all are put into a new base."""
        if any(n >= number for n in self._numbers("base")):
            return
        self._write(self._newest(batch), f"changes/{number}")
        if (number + 1) % self.every == 0:
            self.compact(number)

    def compact(self, number=None):
        """Write a base of the last change of each key.

        Deletions leave the table once they are ``late_s`` older than the newest change; until then an older
        change of their key may still come.
        """
        changes = self._numbers("changes")
        if not changes:
            return
        number = changes[-1] if number is None else number
        rows = self._read(number)
        newest = rows.agg(F.max("ts_us")).first()[0]
        old = F.coalesce(F.col("deleted"), F.lit(False)) & (F.col("ts_us") < F.lit((newest or 0) - self.late_us))
        self._write(self._newest(rows).where(~old), f"base/{number}")

    def current(self):
        """The live rows: the last change of each key that is not a deletion."""
        rows = self._read()
        return None if rows is None else latest_per_key(rows)

    def run(self, stream: DataFrame, checkpoint):
        """A stream of changes into the table."""
        return stream.writeStream.foreachBatch(self.apply).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
