import datetime

from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.functions.registry import register_functions
from tickloom.operators.filters import pair_filter


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "s string").select(expr).first()[0]


def test_pair_hash(spark):
    goldens = {"": 0, "BTC-PERP": 7966697908167619883, "ETH-PERP": 3846482641729352903}
    rows = spark.createDataFrame([(k,) for k in goldens], "s string").select("s", S.pair_hash("s")).collect()
    assert {r[0]: r[1] for r in rows} == goldens


def test_sanitize_pair(spark):
    assert one(spark, "ETH/USDT", S.sanitize_pair("s")) == "ETHXUSDT1716f4786210daf6"
    assert one(spark, "^DOW", S.sanitize_pair("s")) == "XDOW14f5a6fa701a0368"
    assert one(spark, "BTC-PERP", S.sanitize_pair("s")) == "BTC-PERP"


def test_option_id(spark):
    o = one(spark, "ETH-USD-230119-1300-C", S.parse_option_id("s"))
    assert (o.underlying, o.expiry, o.strike, o.side) == ("ETH-USD", datetime.date(2023, 1, 19), 1300.0, "C")
    o = one(spark, "BTC-USD-230331-5000-P", S.parse_option_id("s"))
    assert (o.underlying, o.expiry, o.strike, o.side) == ("BTC-USD", datetime.date(2023, 3, 31), 5000.0, "P")
    assert one(spark, "BTC-USD-5000-P", S.parse_option_id("s")) is None
    assert one(spark, "btc-usd-230331-0.5-p", S.format_option_id(S.parse_option_id("s"))) == "btc-usd-230331-0.5-P"


def test_names(spark):
    assert one(spark, "invalid$", S.standardize_name("s")) == "invalid_"
    assert one(spark, "invalid_  héhé", S.standardize_name("s")) == "invalid___hehe"
    assert one(spark, "trades_btc_usd", S.is_valid_name("s"))
    assert not one(spark, "invalid_$", S.is_valid_name("s"))
    assert not one(spark, "", S.is_valid_name("s"))


def test_pair_filter(spark):
    match = lambda spec, name: one(spark, name, pair_filter(spec, "s"))
    assert match("BTC-PERP", "btc-perp")
    assert match("BTC.*$", "btc/usd")
    assert not match("USDT-PERP", "CUSDT-PERP")
    assert match("", "anything") and match("# a\n// b", "anything")
    assert not match("BTC-PERP;ETH-PERP", "XRP-PERP")


def test_rounding(spark):
    r = spark.range(1).select(
        S.round_to_tick(F.lit(1.2341), F.lit(0.01)), S.round_to_tick(F.lit(101.3), F.lit(0.5)), S.bucket_start(F.lit(-5), 10, 3)
    ).first()
    assert tuple(r) == (1.24, 102.0, -7)


def test_period_ladder():
    day = 86_400_000
    assert [S.previous_period_ms(day, i) for i in range(3)] == [14_400_000, 10_800_000, 7_200_000]
    assert S.previous_period_ms(1000) == 1000 and S.previous_period_ms(120_000) == 180_000


def test_positions_strictly_increase(spark):
    lengths = spark.range(27, 400, 9).select(S.fix_index(S.geometric_index(F.lit(1), F.col("id"), F.lit(26))).alias("p"))
    for row in lengths.collect():
        assert all(a < b for a, b in zip(row.p, row.p[1:]))


def test_sql_functions_agree(spark):
    register_functions(spark)
    r = spark.sql("SELECT tl_pair_hash('BTC-PERP'), tl_parse_option_id('ETH-USD-230119-1300-C').strike, tl_round_to_tick(1.2341D, 0.01D), tl_safe_double('x', -1)").first()
    assert tuple(r) == (7966697908167619883, 1300.0, 1.24, -1.0)
