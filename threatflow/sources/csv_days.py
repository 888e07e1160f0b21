"""Labelled flow CSVs, one file per day."""

import csv
import warnings

from pyspark.sql import DataFrame, SparkSession, functions as F

from threatflow.functions import values as V

PUNCTUATION = " /-%()[]:.#"


def normalize_name(name):
    """Column name in lower case, punctuation as single underscores."""
    lowered = str(name).strip().lower()
    spaced = "".join(" " if ch in PUNCTUATION + "_" else ch for ch in lowered)
    return "_".join(spaced.split())


def normalize_columns(df: DataFrame):
    return df.toDF(*[normalize_name(c) for c in df.columns])


def list_files(spark: SparkSession, folder, days=None, recursive=False, pattern="*.csv"):
    """CSV files below a folder, optionally only the named days."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower()).load(folder)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("day"), "length")
    )
    if days is not None:
        found = files.where(F.col("day").isin(list(days)))
        return found
    return files


def _header(spark, path):
    """Column names in a file's first line, read through Spark's file systems without a job."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        return tuple(next(csv.reader([reader.readLine() or ""]), ()))
    finally:
        stream.close()


def read_day_files(spark: SparkSession, paths):
    """Files with the same header in one scan, different headers united by name."""
    by_header = {}
    for path in paths:
        by_header.setdefault(_header(spark, path), []).append(path)
    out = None
    for header, same in by_header.items():
        schema = ", ".join(f"`{c}` STRING" for c in header)
        part = spark.read.option("header", True).schema(schema).csv(same)
        part = part.withColumn("_day", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def clean_days(raw: DataFrame, keep_source=False, fill=0.0, drop_bad=False):
    """Numbers in all columns but the label; bad values become ``fill`` or drop the row.

    Id columns go, repeated header rows go.  The source address and the day stay text
    for splitting by group.
    """
    if "Dst Port" in raw.columns:
        raw = raw.where(~F.coalesce(F.col("`Dst Port`") == "Dst Port", F.lit(False)))
    text = [c for c in ("Label", "_day") if c in raw.columns]
    ids = {*V.CSV_ID_COLUMNS, "Src IP"}
    numeric = [c for c in raw.columns if c not in ids and c not in text]

    def number(c):
        x = F.trim(F.col(f"`{c}`")).try_cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x).alias(c)

    cols = [number(c) for c in numeric] + [F.col(c) for c in text]
    if keep_source and "Src IP" in raw.columns:
        cols.append(F.col("`Src IP`").alias("_src_ip"))
    out = raw.select(*cols)
    if drop_bad:
        return out.na.drop(subset=[f"`{c}`" for c in numeric])
    if fill is not None:
        return out.select(*[
            F.coalesce(F.col(f"`{c}`"), F.lit(fill)).alias(c) if c in numeric else F.col(c) for c in out.columns
        ])
    return out


def load_days(spark: SparkSession, folder, days=None, recursive=False, **options):
    """All named days of a folder as one cleaned table; days without a file are skipped with a warning."""
    files = {r["day"]: r["path"] for r in list_files(spark, folder, days, recursive).select("day", "path").collect()}
    for day in days or ():
        if day not in files:
            warnings.warn(f"{day} not found, skipped")
    if not files:
        raise FileNotFoundError(folder)
    return clean_days(read_day_files(spark, [files[d] for d in sorted(files)]), **options)
