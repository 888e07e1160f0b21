"""Streams in event-time order: rows wait until the watermark has passed them, then batch operators take over.

Rows of a stream come late and in any order. ``Arrivals`` writes each micro-batch as a table, sorted by time within its
files, and lets go of its rows once the watermark is past them; no row waits in the memory of a task. What a
micro-batch lets go of is all there will ever be of its stretch of time, so the batch operators work on it as they are, with all
they do about hot keys, next to a small carried table: the rows that windows still reach back to, and totals. Rows that
come after their time has passed are set aside.
"""

from pyspark.sql import DataFrame, functions as F

from threatflow.plans.session import shared_dir

SECOND = 1_000_000
#: Where all rows of a finished stream have passed.
END = "2100-01-01 00:00:00"
OUT = "at_us bigint, id string, body string, late boolean, upto_us bigint"


class InOrder:
    """A run of a stream through ``step(rows, carried, upto_us) -> (out, carried)``, micro-batch by micro-batch.

    ``rows`` are those let go of, ``carried`` is a dict of tables that the step before left (empty at first), and
    ``upto_us`` says that all rows up to there have come. Results and carried tables are written under the number of the
    batch, so a batch that runs again replaces what it wrote, and carries on from the batch before it.
    """

    def __init__(self, spark, schema, step, base):
        self.spark, self.schema, self.step, self.base = spark, schema, step, base

    def _numbers(self, folder):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{folder}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(self._path(f"{folder}/{n}/done/_SUCCESS")))

    def _path(self, name):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")

    def _carried(self, number):
        """The tables that the last batch before ``number`` left, and how far it had come."""
        before = [n for n in self._numbers("steps") if n < number]
        if not before:
            return {}, None
        folder = f"{self.base}/steps/{before[-1]}"
        about = self.spark.read.parquet(f"{folder}/done").first()
        return {name: self.spark.read.parquet(f"{folder}/{name}") for name in about["carried"]}, about["upto_us"]

    def __call__(self, batch, number):
        batch = batch.persist()
        try:
            seen = batch.agg(F.max("upto_us").alias("upto"), F.count_if("late").alias("late")).first()
            if seen["late"]:
                self.set_aside(batch.where("late").select("at_us", "id"), number)
            if seen["upto"] is None:
                return
            rows = batch.where("not late").select(F.from_json("body", self.schema).alias("r")).select("r.*")
            self.advance(rows, seen["upto"], number)
        finally:
            batch.unpersist()

    def set_aside(self, rows, number):
        """Keep rows (at_us, id) of a micro-batch that came too late."""
        rows.write.mode("overwrite").parquet(f"{self.base}/late/{number}")

    def advance(self, rows, upto, number):
        """Put the rows up to ``upto`` through the step."""
        carried, before = self._carried(number)
        self._run(rows, carried, max(upto, before or upto), number)

    def _run(self, rows, carried, upto, number):
        folder = f"{self.base}/steps/{number}"
        out, left = self.step(rows, carried, upto)
        out.write.mode("overwrite").parquet(f"{folder}/out")
        for name, table in left.items():
            table.write.mode("overwrite").parquet(f"{folder}/{name}")
        about = [(sorted(left), upto)]
        self.spark.createDataFrame(about, "carried array<string>, upto_us bigint").coalesce(1).write.mode("overwrite").parquet(f"{folder}/done")

    def results(self, schema=None):
        """All rows that the steps gave out."""
        numbers = self._numbers("steps")
        if not numbers:
            return self.spark.createDataFrame([], schema) if schema else None
        return self.spark.read.parquet(*[f"{self.base}/steps/{n}/out" for n in numbers])

    def late(self):
        """Rows (at_us, id) that came after their time had passed."""
        path = self._path("late")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return self.spark.createDataFrame([], "at_us bigint, id string")
        return self.spark.read.option("recursiveFileLookup", "true").schema("at_us bigint, id string").parquet(f"{self.base}/late")


class Arrivals:
    """Takes in the micro-batches of a stream and lets rows go on to ``run`` once the watermark has passed them.

    The watermark is ``delay`` behind the latest time of all micro-batches so far, in milliseconds and never falling, as
    Spark's is; rows at or before the watermark that their micro-batch begins with are late. Each micro-batch is written under its
    number. It lets go of the rows between the watermark it begins with and the one it leaves, so a batch that runs again
    does the same again. Tables of which all rows have passed are deleted.
    """

    def __init__(self, run, at, row_id, delay):
        self.run, self.spark, self.base = run, run.spark, f"{run.base}/arrived"
        self.at, self.row_id = at, row_id
        epoch = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
        self.delay_ms = self.spark.sql(f"SELECT timestampdiff(MILLISECOND, {epoch}, {epoch} + INTERVAL {delay}) AS ms").first()["ms"]

    def _mark(self, number):
        """What the micro-batch before ``number`` left: the watermark, tables with rows that wait, and tables without."""
        before = [n for n in self.run._numbers("arrived") if n < number]
        if not before:
            return 0, {}, []
        mark = self.spark.read.parquet(f"{self.base}/{before[-1]}/done").first()
        return mark["upto_us"], dict(mark["waiting"]), mark["passed"]

    def _rows(self, numbers, schema):
        return self.spark.read.schema(schema).parquet(*[f"{self.base}/{n}/rows" for n in numbers])

    def __call__(self, batch, number):
        begin, tables, passed = self._mark(number)
        at = F.col(self.at)
        batch.sortWithinPartitions(self.at).write.mode("overwrite").parquet(f"{self.base}/{number}/rows")
        came = self._rows([number], batch.schema)
        seen = came.agg(F.max(at).alias("last"), F.count_if(at <= begin).alias("late")).first()
        if seen["late"]:
            self.run.set_aside(came.where(at <= begin).select(at.alias("at_us"), F.col(self.row_id).cast("string").alias("id")), number)
        upto = begin
        if seen["last"] is not None:
            upto = max(begin, (seen["last"] // 1000 - self.delay_ms) * 1000)
            tables[number] = seen["last"]
        if upto > begin:
            rows = self._rows(sorted(tables), batch.schema)
            self.run.advance(rows.where((at > begin) & (at <= upto)), upto, number)
        self._leave(number, upto, {n: last for n, last in tables.items() if last > upto}, [n for n, last in tables.items() if last <= upto])
        # this micro-batch may run again, so tables that passed in it stay for the next one to delete
        for n in passed:
            path = self.run._path(f"arrived/{n}/rows")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _leave(self, number, upto, waiting, passed):
        schema = "upto_us bigint, waiting map<bigint, bigint>, passed array<bigint>"
        mark = self.spark.createDataFrame([(upto, waiting, passed)], schema)
        mark.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/{number}/done")


def run_in_order(source: DataFrame, build, step, name, at="ts_us", row_id="packet_id", delay="10 minutes", closed=True, base=None):
    """Run a finite stream through ``step`` in event-time order and give back the run (see ``InOrder``).

    ``build`` makes rows with a time in microseconds (``at``) and an id from the source. With ``closed`` the input is
    finished: a row of the year 2100 comes in through a folder of its own and moves the watermark past all others, so that
    no row stays behind. A run with the same ``base`` goes on where the last one ended.
    """
    spark = source.sparkSession
    base = base or shared_dir(spark, f"stream-{name}")
    if closed:
        beats = f"{base}/beats"
        blank = [F.lit(END if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in source.schema]
        if "ts" not in source.columns:
            micros = F.unix_micros(F.lit(END).cast("timestamp"))
            blank = [(micros if f.name == at else F.lit(None)).cast(f.dataType).alias(f.name) for f in source.schema]
        beat = spark.range(1).select(*blank)
        beat.limit(0).write.mode("append").parquet(beats)
        source = source.unionByName(spark.readStream.schema(source.schema).parquet(beats))
    rows = build(source)
    run = InOrder(spark, rows.schema, step, base)
    arrivals = Arrivals(run, at, row_id, delay)

    def go():
        query = (
            rows.writeStream.foreachBatch(arrivals).outputMode("append").trigger(availableNow=True)
            .option("checkpointLocation", f"{base}/checkpoint").start()
        )
        query.awaitTermination()

    go()
    if closed:
        beat.write.mode("append").parquet(beats)
        go()
    return run
