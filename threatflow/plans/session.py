"""Session set-up and the shared folder used for files between jobs."""

import functools
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app="threatflow", cores="*", shuffle_partitions=None, **conf):
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark, name):
    """A fresh folder below the cluster's checkpoint folder.

    The folder named in ``spark.checkpoint.dir`` is used as it is. Where the session names none, a session
    on one machine gets a local folder; on a cluster, whose executors could not see it, that is an error.
    All folders of an application lie in one, which goes when its driver's JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = _local_base(spark.sparkContext.master)
    root = os.path.join(base, "threatflow", spark.sparkContext.applicationId)
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.mkdirs(where):
        files.deleteOnExit(where)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


@functools.cache
def _local_base(master):
    """A temporary folder for sessions whose executors run in the driver's own process, one for all of them."""
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"master {master}: set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="threatflow-")


def written(df):
    """The table as Parquet in the shared folder, read from there."""
    path = shared_dir(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_checkpoint_dir(spark):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoint"))
