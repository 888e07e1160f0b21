"""Files and messages of the table queries."""

import datetime

from pyspark.sql import functions as F

from threatflow.catalog import tables
from threatflow.sources import messages


def test_flows_are_written_to_as_many_files_as_rows_need(spark, tmp_path, monkeypatch):
    days = [datetime.datetime(1998, 5, 1), datetime.datetime(1999, 5, 1)]
    rows = [(i, 1, i % 7, float(i % 50), 100.0 + i, 0.1, 0.02, "NRA"[i % 3], days[i % 2]) for i in range(600)]
    kinds = (
        "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, "
        "l_tax double, l_returnflag string, l_shipdate timestamp"
    )
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "lineitem.parquet"))
    few = tables.loaded(spark, str(tmp_path), keep_source=True)
    assert len(few.inputFiles()) == 5
    monkeypatch.setattr(tables, "FILE_ROWS", 40)
    many = tables.loaded(spark, str(tmp_path), keep_source=True)
    assert len(many.inputFiles()) == 9 + 8
    kept = [c for c in few.columns if c != "_day"]
    assert sorted(map(tuple, many.select(*kept).collect())) == sorted(map(tuple, few.select(*kept).collect()))


def test_messages_are_parsed_once(spark):
    """Filters on what was parsed stay above the parsing."""
    raw = spark.range(10).select(F.format_string('{"src_ip": "s%d", "attacks": "X", "timestamp": %d}', "id", "id").alias("value"))
    events = messages.alerts_of(messages.normalize(messages.parse_messages(raw)))
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(timestamp") == 1 and events.count() == 10
