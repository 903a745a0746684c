"""Market-data views over the test tables, with one definition for both engines.

Each view is ``(table, {column: expression})``.  ``MS(x)`` (epoch milliseconds of a
zone-less timestamp) is the only expression that differs between engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tickloom.session import prepare

_INST = "concat('P', CAST({key} AS VARCHAR(20)), '-USD-SWAP')"
_L_INST = _INST.format(key="l_partkey")
_P_INST = _INST.format(key="p_partkey")
_L_PRICE = "l_extendedprice / l_quantity"
_ARRIVAL = "l_orderkey * 10 + l_linenumber"

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "trades": (
        "events",
        {
            "id": "event_id",
            "time_ms": "MS(ts)",
            "market": "event_type",
            "price": "value",
            "volume": "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) + 1",
            "flag": "CAST((CASE WHEN user_id % 2 = 0 THEN 1 ELSE 2 END)"
            " + (CASE WHEN event_id % 10 = 0 THEN 4 ELSE 0 END) AS SMALLINT)",
        },
    ),
    "trades_big": (
        "lineitem",
        {
            "id": "((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey",
            "time_ms": "MS(l_shipdate) + (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 15485863) % 86400000",
            "market": "concat(l_returnflag, '/', l_linestatus)",
            "price": _L_PRICE,
            "volume": "l_quantity",
            "flag": "CAST((CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 2 END)"
            " + (CASE WHEN l_linenumber = 7 THEN 4 ELSE 0 END) AS SMALLINT)",
        },
    ),
    "depth_updates": (
        "lineitem",
        {
            "symbol": "l_returnflag",
            "side": "CASE WHEN l_linestatus = 'O' THEN 'ask' ELSE 'bid' END",
            "price": "CAST(floor(l_extendedprice / l_quantity) AS DOUBLE)",
            "qty": "CASE WHEN l_quantity <= 2 THEN 0.0E0 ELSE l_quantity END",
            "first_id": "l_orderkey",
            "final_id": "l_orderkey",
            "prev_id": "CAST(NULL AS BIGINT)",
            "event_ms": "MS(l_shipdate)",
        },
    ),
    "instruments": (
        "part",
        {
            "inst_id": _P_INST,
            "inst_type": "'SWAP'",
            "ct_val": "CAST(p_size AS DOUBLE)",
            "state": "CASE WHEN p_size % 5 = 0 THEN 'suspend' ELSE 'live' END",
        },
    ),
    "mark_price": (
        "part",
        {"inst_id": _P_INST, "mark_px": "p_retailprice", "ts": "CAST(p_partkey AS BIGINT)"},
    ),
    "open_interest": (
        "lineitem",
        {
            "inst_id": _L_INST,
            "oi": "l_quantity",
            "oi_ccy": "l_quantity * (1 + l_tax)",
            "ts": "MS(l_shipdate)",
            "arrival": _ARRIVAL,
        },
    ),
    "funding": (
        "lineitem",
        {
            "inst_id": _L_INST,
            "funding_rate": "l_discount / 100",
            "next_funding_rate": "l_tax / 100",
            "funding_time": "MS(l_shipdate)",
            "next_funding_time": "MS(l_shipdate) + 28800000",
            "ts": "MS(l_shipdate)",
            "method": "CASE WHEN l_linestatus = 'O' THEN 'current_period' ELSE 'next_period' END",
            "sett_state": "CASE WHEN l_returnflag = 'R' THEN 'processing' ELSE 'settled' END",
            "sett_funding_rate": "l_discount / 200",
            "arrival": _ARRIVAL,
        },
    ),
    "ticker": (
        "lineitem",
        {
            "inst_id": _L_INST,
            "last": _L_PRICE,
            "ask_px": _L_PRICE + " * (1 + l_discount / 100)",
            "bid_px": _L_PRICE,
            "ask_sz": "l_quantity",
            "bid_sz": "l_quantity + 1",
            "low24h": _L_PRICE + " * 0.9E0",
            "high24h": _L_PRICE + " * 1.2E0",
            "open24h": _L_PRICE + " * (1 - l_tax)",
            "sod_utc0": _L_PRICE + " * (1 - l_tax / 2)",
            "sod_utc8": _L_PRICE + " * (1 - l_tax / 4)",
            "vol24h": "l_quantity",
            "ts": "MS(l_shipdate)",
            "arrival": _ARRIVAL,
        },
    ),
    "option_chain": (
        "part",
        {
            "inst_id": "concat(CASE WHEN p_partkey % 2 = 0 THEN 'BTC-USD-' ELSE 'ETH-USD-' END, '2',"
            " CAST(3 + p_partkey % 4 AS VARCHAR(20)), lpad(CAST(1 + p_partkey % 12 AS VARCHAR(20)), 2, '0'),"
            " lpad(CAST(1 + p_partkey % 28 AS VARCHAR(20)), 2, '0'), '-', CAST(100 * p_size AS VARCHAR(20)),"
            " CASE WHEN p_partkey % 3 = 0 THEN '-C' ELSE '-P' END)",
            "oi": "CASE WHEN p_partkey % 11 = 0 THEN 0.0E0 ELSE p_retailprice END",
            "vol24h": "CAST(p_size * p_size AS DOUBLE)",
            "seq": "p_partkey",
        },
    ),
}

_MS = re.compile(r"MS\((\w+)\)")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Spark DataFrame of a view."""
    table, columns = VIEWS[name]
    source = prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")
    return source.selectExpr(
        *(f"{_MS.sub(r'unix_millis(CAST(\1 AS TIMESTAMP))', expr)} AS `{alias}`" for alias, expr in columns.items())
    )


def view_sql(name: str) -> str:
    """The same view as a DuckDB SELECT."""
    table, columns = VIEWS[name]
    fields = ", ".join(f"{_MS.sub(r'(epoch_us(\1) // 1000)', expr)} AS {alias}" for alias, expr in columns.items())
    return f"SELECT {fields} FROM {table}"


def with_views(names: str, body: str) -> str:
    """``body`` with the named views in front as CTEs; a body may start with its own ``WITH``-less CTE list."""
    ctes = ", ".join(f"{name} AS ({view_sql(name)})" for name in names.split())
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
