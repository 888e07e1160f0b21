"""Named queries over the test tables, each with its checking SQL where SQL can say it."""

from pyspark.sql import functions as F

from threatflow.plans import views

QUERIES = {}
SQL = {}


def rounded(df):
    """Doubles to six digits.

    Means of whole numbers sit on the borders of plain rounding and would fall either
    way by their last bit; the odd offset moves the borders to where no such mean lies.
    """
    return df.select(
        *[(F.floor(F.col(c) * 1e6 + 0.3127) / 1e6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def _same_rounding(sql):
    """``round(x, 6)`` in the SQL, spelled as in ``rounded``."""
    out, rest = "", sql
    while "round(" in rest:
        head, _, tail = rest.partition("round(")
        depth = end = 1
        for end, ch in enumerate(tail):
            depth += (ch == "(") - (ch == ")")
            if depth == 0:
                break
        inner, rest = tail[:end], tail[end + 1 :]
        value, _, digits = inner.rpartition(",")
        if digits.strip() == "6":
            out += f"{head}(floor(CAST({_same_rounding(value)} AS DOUBLE) * 1e6 + 0.3127) / 1e6)"
        else:
            out += f"{head}round({inner})"
    return out + rest


def query(name, sql=None, over=()):
    """Register a query; ``over`` names the views its SQL reads."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} exists already")
        QUERIES[name] = fn
        if sql is not None:
            text = views.with_views(sql, *over) if over else sql.strip()
            SQL[name] = _same_rounding(text)
        return fn

    return add
