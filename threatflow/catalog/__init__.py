"""All registered queries."""

from threatflow.catalog import (  # noqa: F401
    analytics,
    detect,
    evaluate,
    fields,
    learn,
    respond,
    streams,
    tables,
)
from threatflow.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
