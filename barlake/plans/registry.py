"""Query registry: a name, a function of (spark, sf_dir), and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..views import CTES

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
MODULES = ("aggregates", "joins", "series", "columns", "recordings", "streams", "storage", "imports", "reports")


#: Added before rounding: the tables' two-place values average to exact ties, which engines round differently.
NUDGE = 1e-9


def nudged(sql: str) -> str:
    """Adds NUDGE inside every rounding to six places of a query's text."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 1, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = nudged(sql[start + 6 : end - 1])
        body, comma, places = inner.rpartition(",")
        out += sql[at:start] + (f"round(({body}) + 1e-9, 6)" if comma and places.strip() == "6" else f"round({inner})")
        at = end
    return out + sql[at:]


def finished(df: DataFrame) -> DataFrame:
    """Doubles to six places (and no negative zero), small integers to long, so that engines agree on values and types."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(F.when(~F.isnan(c), c.cast("double")) + NUDGE, 6) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ("reps", "usable")) -> Callable[[Query], Query]:
    """Registers a query; sql, if given, follows the view's table expressions, separated from its own by a comma."""

    def register(fn: Query) -> Query:
        _queries[name] = lambda spark, sf_dir: finished(fn(spark, sf_dir))
        if sql:
            head = ", ".join(CTES[c] for c in ctes)
            body = nudged(sql.strip())
            _oracles[name] = (f"with {head}{',' if not body.startswith('select') else ''} " if head else "" if body.startswith("select") else "with ") + body
        return fn

    return register


def _load() -> None:
    for module in MODULES:
        import_module(f"{__package__}.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracles() -> dict[str, str]:
    _load()
    return dict(_oracles)
