"""The scalar functions for use in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tickloom.functions.scalars import (
    OPTION_ID_PATTERN,
    PAIR_HASH_SALT_HIGH,
    PAIR_HASH_SALT_LOW,
    SMALLEST_NORMAL,
    VALID_NAME_PATTERN,
    _normalize_name,
)


def _xor_words(first: int) -> str:
    return " ^ ".join(f"CAST(conv(substring(d, {first + 16 * i}, 8), 16, 10) AS BIGINT)" for i in range(4))


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _normal(x: str) -> str:
    return f"({x} IS NOT NULL AND NOT isnan({x}) AND abs({x}) <> double('inf') AND abs({x}) >= {SMALLEST_NORMAL!r}D)"


_OPTION = _literal(OPTION_ID_PATTERN)
_YMD = f"regexp_extract(s, {_OPTION}, 2)"
_DIGITS = "greatest(ceil(-log10(2 * inc)), 0)"
_TICKED = "(ceil(p / inc) * inc)"

_OPTION_TYPE = "STRUCT<underlying: STRING, year: INT, month: INT, day: INT, expiry: DATE, strike: DOUBLE, side: STRING>"
_UNSAFE = _literal(r"[^A-Za-z0-9_\-]")
_TRIMMED = "regexp_replace(s, " + _literal(r"(?U)^\s+|\s+$") + ", '')"
_WIDENED = f"regexp_replace({_TRIMMED}, " + _literal(r"[\x{10000}-\x{10FFFF}]") + ", '  ')"
_CONTRACTS = "(oi * CASE WHEN ct_val > 0 THEN ct_val ELSE 1D END)"
_EXCESS = f"(try_divide({_CONTRACTS}, oi_ccy) - 1D)"
_OI_PRICE = "coalesce(CASE WHEN mark > 0 THEN mark END, last_price, 0D)"
_SPACED = "pow(2D, log2(a) + ? * (log2(b) - log2(a)) / (n - 1))"

# name -> (arguments, result, expression); @ stands before the name of another of them
SQL_FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "bucket_start": ("t BIGINT, period BIGINT, shift BIGINT", "BIGINT", "t - pmod(t - shift, period)"),
    "is_buy": ("flag INT", "BOOLEAN", "(flag & 1) <> 0"),
    "is_sell": ("flag INT", "BOOLEAN", "(flag & 2) <> 0"),
    "is_liquidation": ("flag INT", "BOOLEAN", "(flag & 4) <> 0"),
    "trade_side": ("flag INT", "STRING", "CASE WHEN (flag & 1) <> 0 THEN 'buy' WHEN (flag & 2) <> 0 THEN 'sell' ELSE 'none' END"),
    "safe_double": ("s STRING, fallback DOUBLE", "DOUBLE", "coalesce(try_cast(s AS DOUBLE), fallback)"),
    "safe_long": ("s STRING, fallback BIGINT", "BIGINT", "coalesce(try_cast(s AS BIGINT), fallback)"),
    "nan_to_num": ("x DOUBLE, fallback DOUBLE", "DOUBLE", "CASE WHEN x IS NULL OR isnan(x) OR abs(x) = double('inf') THEN fallback ELSE x END"),
    "pair_hash": (
        "s STRING", "BIGINT",
        f"CASE WHEN s = '' THEN 0 ELSE element_at(transform(array(sha2(s, 256)), d -> (shiftleft(({_xor_words(1)} ^ {PAIR_HASH_SALT_HIGH}L)"
        f" & 2147483647L, 32) | ({_xor_words(9)} ^ {PAIR_HASH_SALT_LOW}L))), 1) END",
    ),
    "escape_market": ("s STRING", "STRING", "lower(translate(s, '/- .', '____'))"),
    "is_valid_name": ("s STRING", "BOOLEAN", f"s RLIKE {_literal(VALID_NAME_PATTERN)}"),
    "price_key": ("p DOUBLE", "DOUBLE", "signum(log2(p)) * floor(abs(log2(p)) * 1e8) / 1e8"),
    "price_of_key": ("k DOUBLE", "DOUBLE", "pow(2, k)"),
    "round_to_tick": (
        "p DOUBLE, inc DOUBLE", "DOUBLE",
        f"signum({_TICKED}) * floor(abs({_TICKED}) * pow(10, {_DIGITS}) + 0.5) / pow(10, {_DIGITS})",
    ),
    "spread_pct": ("ask DOUBLE, bid DOUBLE", "DOUBLE", "CASE WHEN ask > 0 AND bid > 0 THEN (ask / bid - 1) * 100 ELSE 0 END"),
    "parse_option_id": (
        "s STRING", _OPTION_TYPE,
        f"CASE WHEN s RLIKE {_OPTION} THEN named_struct('underlying', regexp_extract(s, {_OPTION}, 1), 'year', try_cast(substring({_YMD}, 1, 2) AS INT),"
        f" 'month', try_cast(substring({_YMD}, 3, 2) AS INT), 'day', try_cast(substring({_YMD}, 5, 2) AS INT), 'expiry', try_cast(concat('20',"
        f" substring({_YMD}, 1, 2), '-', substring({_YMD}, 3, 2), '-', substring({_YMD}, 5, 2)) AS DATE), 'strike',"
        f" try_cast(regexp_extract(s, {_OPTION}, 3) AS DOUBLE), 'side', upper(regexp_extract(s, {_OPTION}, 4))) END",
    ),
    "format_option_id": (
        f"o {_OPTION_TYPE}", "STRING",
        "concat(o.underlying, '-', lpad(CAST(o.year AS STRING), 2, '0'), lpad(CAST(o.month AS STRING), 2, '0'), lpad(CAST(o.day AS STRING), 2, '0'), '-',"
        " CASE WHEN o.strike = floor(o.strike) AND abs(o.strike) < 1e15 THEN CAST(try_cast(o.strike AS BIGINT) AS STRING) ELSE CAST(o.strike AS STRING) END,"
        " '-', o.side)",
    ),
    "sanitize_pair": (
        "s STRING", "STRING",
        f"CASE WHEN {_WIDENED} RLIKE {_UNSAFE} THEN concat(regexp_replace({_WIDENED}, {_UNSAFE}, 'X'), CASE WHEN length(hex(@pair_hash(s))) < 8"
        f" THEN lpad(lower(hex(@pair_hash(s))), 8, '0') ELSE lower(hex(@pair_hash(s))) END) ELSE {_WIDENED} END",
    ),
    "book_grouping": (
        "bid DOUBLE, ask DOUBLE, inc DOUBLE, percent DOUBLE", "DOUBLE",
        "greatest(@round_to_tick((bid + ask) * 0.5D * (percent / 100D), inc), inc)",
    ),
    "ref_price": (
        "ask DOUBLE, bid DOUBLE, last_price DOUBLE, widest DOUBLE", "DOUBLE",
        "CASE WHEN ask > 0 AND bid > 0 AND @spread_pct(ask, bid) < widest THEN (ask + bid) * 0.5D ELSE last_price END",
    ),
    "normalise_oi": (
        "oi DOUBLE, oi_ccy DOUBLE, ct_val DOUBLE, mark DOUBLE, last_price DOUBLE, strict BOOLEAN", "DOUBLE",
        f"CASE WHEN oi_ccy > 0 AND CASE WHEN strict THEN abs({_EXCESS}) ELSE {_EXCESS} END < 0.001D AND {_OI_PRICE} > 0"
        f" THEN oi_ccy * {_OI_PRICE} ELSE {_CONTRACTS} END",
    ),
    "next_funding": (
        "rate DOUBLE, forecast DOUBLE, method STRING, state STRING, settled DOUBLE", "DOUBLE",
        f"CASE WHEN coalesce({_normal('forecast')}, false) AND NOT coalesce(method = 'current_period', false) THEN forecast"
        f" WHEN state = 'processing' AND {_normal('settled')} THEN settled ELSE rate END",
    ),
    "geometric_index": (
        "a INT, b INT, n INT, backward BOOLEAN", "ARRAY<INT>",
        f"transform(sequence(0, n - 1), j -> CASE WHEN j = n - 1 THEN b WHEN j = 0 THEN a WHEN backward THEN CAST(rint(b - ({_SPACED.replace('?', '(n - 1 - j)')} - a)) AS INT)"
        f" ELSE CAST(rint({_SPACED.replace('?', 'j')}) AS INT) END)",
    ),
}


def register_functions(spark: SparkSession, prefix: str = "tl_") -> list[str]:
    """Make the scalar functions callable from SQL, as ``tl_bucket_start`` and so on.

    They are SQL functions, so Catalyst inlines them; only name normalisation is Python.
    """
    for name, (arguments, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {result} RETURN {body.replace('@', prefix)}")
    spark.udf.register(f"{prefix}standardize_name", _normalize_name)
    return [prefix + n for n in (*SQL_FUNCTIONS, "standardize_name")]
