"""The registered queries and, where SQL can say the same, the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = sql
        return function

    return add


def comparable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Plain column types: whole numbers as bigint, truth values as 0/1, times as epoch microseconds,
    doubles rounded (and never -0).

    A mean such as 27.4156875 lies on a rounding boundary, where the last bit of a sum decides. A
    nudge far below the kept digits takes such values off the boundary, here and in ``sql_round``.
    """

    def plain(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind in ("tinyint", "smallint", "int"):
            c = c.cast("bigint")
        elif kind == "boolean":
            c = c.cast("int").cast("bigint")
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.unix_micros(c.cast("timestamp"))
        elif kind in ("double", "float"):
            c = c.cast("double")
            c = F.round(c + F.signum(c) * F.lit(10.0 ** -(digits + 4)), digits) + F.lit(0.0)
        return c.alias(name)

    return df.select(*[plain(n, k) for n, k in df.dtypes])


def sql_round(expression: str, digits: int = 6) -> str:
    """The rounding of ``comparable`` for the check SQL."""
    value = f"CAST({expression} AS DOUBLE)"
    return f"(round({value} + sign({value}) * 1e-{digits + 4}, {digits}) + 0e0)"
