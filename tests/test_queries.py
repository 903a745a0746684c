"""Registered queries against their SQL; TICKLOOM_ALL=1 runs every one."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUICK = """trade_bars bars_ohlc pair_filter check_trades swap_row pick_options drop_unchanged new_rows level_stats
validate_book extrapolate_levels read_trades read_klines close_candles stream_dedupe append_trades sql_functions""".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("TICKLOOM_ALL") else QUICK)
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, name, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
