"""SQL functions give what the column functions give."""

from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.functions.registry import register_functions
from tickloom.operators import features as D


def same(spark, rows, schema, checks):
    register_functions(spark)
    df = spark.createDataFrame(rows, schema)
    names = list(checks)
    out = df.select(*(F.expr(sql).alias(f"{n}_sql") for n, (sql, _) in checks.items()), *(c.alias(n) for n, (_, c) in checks.items()))
    for r in out.collect():
        assert [r[f"{n}_sql"] for n in names] == [r[n] for n in names], r


def test_names_and_options(spark):
    rows = [(x,) for x in ["BTC/USD", " btc-usd ", "a b", "ok_1", "", "\U0001f600x", None, "BTC-USD-240628-60000-C", "BTC-USD-240628-0.5-p", "ETH-USD-249999-1-P"]]
    same(spark, rows, "s string", {
        "sanitize": ("tl_sanitize_pair(s)", S.sanitize_pair("s")),
        "parse": ("tl_parse_option_id(s)", S.parse_option_id("s")),
        "format": ("tl_format_option_id(tl_parse_option_id(s))", S.format_option_id(S.parse_option_id("s"))),
    })


def test_prices(spark):
    rows = [(99.0, 99.02, 0.5, 98.0, "next_period", "processing", 0.01, 100.0), (0.0, 5.0, 0.01, 4.0, "current_period", "processing", 0.0, 0.5),
            (1.0, 2.0, 0.25, None, None, "settled", 5e-324, 0.0), (10.0, 10.001, 1e-4, 10.0, "current_period", "processing", 0.2, None)]
    fr = F.struct(F.col("last").alias("funding_rate"), F.col("inc").alias("next_funding_rate"), "method", F.col("state").alias("sett_state"), F.col("x").alias("sett_funding_rate"))
    tick = F.struct(F.col("ask").alias("ask_px"), F.col("bid").alias("bid_px"), F.col("last").alias("last"))
    checks = {
        "grouping": ("tl_book_grouping(bid, ask, inc, 0.05D)", S.book_grouping("bid", "ask", "inc")),
        "ref": ("tl_ref_price(ask, bid, last, 0.05D)", D.ref_price(tick, 0.05)),
        "funding": ("tl_next_funding(last, inc, method, state, x)", D.next_funding(fr)),
    }
    for strict in (False, True):
        checks[f"oi{strict}"] = (f"tl_normalise_oi(bid, ask, ct, x, last, {strict})", D.normalise_oi("bid", "ask", "ct", "x", "last", strict))
    same(spark, rows, "bid double, ask double, inc double, last double, method string, state string, x double, ct double", checks)


def test_positions(spark):
    rows = [(1, 500, 25), (3, 64, 7), (1, 2, 2)]
    same(spark, rows, "a int, b int, n int", {
        f"at{back}": (f"tl_geometric_index(a, b, n, {back})", S.geometric_index(F.col("a"), F.col("b"), F.col("n"), reverse=back)) for back in (False, True)
    })
