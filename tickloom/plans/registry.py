"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TIE_SHIFT = 0.314159265358979


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 4):
    """Register a query with its check.

    The order of summation differs between engines, so double columns are rounded to
    ``digits`` on both sides of the comparison; the operators themselves do not round.
    A third of the last digit is added first: the engines break exact ties differently.
    Slopes differ little between rows, and are compared in a larger unit. ``doubles`` names the double columns of the SQL.
    """
    shift = f"{TIE_SHIFT * 10 ** -digits:.17e}"

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(build(spark, sf_dir), digits)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            replaced = ", ".join(f"round({c} * {scale(c)} + {shift}, {digits}) + 0 AS {c}" for c in doubles.split())
            ORACLES[name] = f"SELECT * REPLACE ({replaced}) FROM ({sql})" if replaced else sql
        return build

    return register


def scale(column: str) -> float:
    return 1e4 if column.endswith("log_regression_slope") else 1.0


def rounded(df: DataFrame, digits: int) -> DataFrame:
    shift = F.lit(float(f"{TIE_SHIFT * 10 ** -digits:.17e}"))
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select(
        *((F.round(F.col(c) * scale(c) + shift, digits) + F.lit(0.0)).alias(c) if c in doubles else F.col(c) for c in df.columns)
    )
