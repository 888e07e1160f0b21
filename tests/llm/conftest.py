"""The session of these tests, with a shared folder of its own."""

import os
import shutil
from pathlib import Path

import pytest

from threatflow.plans.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = build_session("llm-tests", cores="4", shuffle_partitions=4, **{"spark.checkpoint.dir": str(folder)})
    session.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(
        [str(Path(__file__).resolve().parents[2]), session.sparkContext.environment.get("PYTHONPATH", "")]
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    shutil.rmtree(folder, ignore_errors=True)


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, empty and long texts, ties, repeated rows, near copies and a column with a used name."""
    words = [f"w{i % 89}x{i % 7}" for i in range(400)]
    near = words[:]
    near[200] = "other"
    rows = [
        (1, " ".join(words), "a"),
        (2, " ".join(near), "a"),
        (3, " ".join(words), None),
        (3, " ".join(words), None),
        (4, None, "b"),
        (5, "", "b"),
        (6, "one", "b"),
        (7, "One\n\none", "c"),
        (8, "x y " * 30_000, "c"),
        (9, "é 日本 😀\nline two of it\nline two of it", "c"),
        (10, "line two of it\nsomething else here", None),
        (None, "no key at all", "a"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr(
        "*", "'kept' AS _range", "1 AS shard", "2 AS label", "0 AS n"
    )
