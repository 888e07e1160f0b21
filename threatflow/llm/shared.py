"""Helpers of the operators in this package."""

from pyspark.sql import functions as F

from threatflow.plans.session import ensure_checkpoint_dir, shared_dir

#: Words are runs of anything but these white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df):
    """The table, written to the shared checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df):
    """The table as Parquet in the shared folder, read from there; removed when the session's JVM ends.

    Smaller than a checkpoint, and its columns are read one by one.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "stored")
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column):
    return F.coalesce(F.col(column), F.lit(""))


def key_of(column):
    """A key without nulls: null and every text have keys of their own."""
    return F.when(F.col(column).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(column).cast("string")))


def listed(values):
    """An array of whole numbers as a constant."""
    return F.from_json(F.lit("[" + ",".join(str(int(v)) for v in values) + "]"), "array<bigint>")


#: Edges that one task ties together.
TIED = 200_000


def _tied(batches):
    """Each node of some edges with the least node it reaches by them."""
    import pyarrow as pa

    up, kind = {}, None

    def root(n):
        while up[n] != n:
            up[n] = n = up[up[n]]
        return n

    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(up.setdefault(a, a)), root(up.setdefault(b, b))
            if a != b:
                up[max(a, b)] = min(a, b)
    if up:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, kind), pa.array([root(n) for n in nodes], kind)], ["node", "root"]
        )


def components(edges):
    """Connected components of ``edges`` (a, b): rows (node, root), ``root`` the least node reachable.

    Up to ``TIED`` edges are tied together in one task. More are turned into stars by rounds of large and
    small stars: every node's greater neighbours, then its lesser ones, are tied to its least neighbour,
    until all edges point at roots or few are left. Each round is written to the shared folder.
    """
    pairs = saved(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    kind = pairs.schema["a"].dataType.simpleString()
    while pairs.count() > TIED:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = saved(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        roots = pairs.select(F.col("b").alias("a")).distinct()
        if pairs.join(roots, "a", "left_semi").isEmpty() and pairs.groupBy("a").count().where("count > 1").isEmpty():
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                roots.select(F.col("a").alias("node"), F.col("a").alias("root"))
            )
    return saved(pairs.coalesce(1).mapInArrow(_tied, f"node {kind}, root {kind}"))


def groups(batches, key="g"):
    """Tables of the rows of one key each, from Arrow batches sorted by ``key``; holds one group and one batch."""
    import numpy as np
    import pyarrow as pa

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        start = 0
        for end in ends:
            if held and start == 0 and held[0].column(key)[0].as_py() != keys[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            if end < len(keys):
                yield pa.Table.from_batches(held)
                held = []
            start = end
    if held:
        yield pa.Table.from_batches(held)
