"""Column expressions: time buckets, flags, names, option ids, prices.

Everything here is a built-in expression except :func:`standardize_name`, for
which Spark has no Unicode normalisation and a pandas UDF is used.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Trade flag bits.
FLAG_BUY = 1
FLAG_SELL = 2
FLAG_LIQUIDATION = 4

# The standard period ladder, in milliseconds.
PERIOD_LADDER_MS = [
    1_000,
    5_000,
    10_000,
    15_000,
    30_000,
    60_000,
    180_000,
    300_000,
    900_000,
    1_800_000,
    2_700_000,
    3_600_000,
    7_200_000,
    10_800_000,
    14_400_000,
    86_400_000,
    604_800_000,
    2_592_000_000,
]

# Fixed value: the salt of the pair hash, 2^64 - 59, as two 32-bit halves.
PAIR_HASH_SALT_HIGH = 0xFFFFFFFF
PAIR_HASH_SALT_LOW = 0xFFFFFFC5

# Fixed value: what an option instrument id looks like.
OPTION_ID_PATTERN = r"(?i)^([\w-]+?)-([0-9]{6})-((?:[0-9]+\.)?[0-9]+)-(P|C)$"

# Valid table names, and the characters replaced in them.
VALID_NAME_PATTERN = r"^[A-Za-z][A-Za-z0-9_]{0,127}$"
NAME_REPLACED_CHARS = './ :@$\\"'

SMALLEST_NORMAL = 2.2250738585072014e-308


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- time ---------------------------------------------------------------------


def bucket_start(time_ms, period_ms, offset_ms=0) -> Column:
    """Start of the period a time falls in: floor((t - offset) / period) * period + offset."""
    t = _col(time_ms)
    period = period_ms if isinstance(period_ms, Column) else F.lit(period_ms).cast("bigint")
    offset = offset_ms if isinstance(offset_ms, Column) else F.lit(offset_ms).cast("bigint")
    return t - F.pmod(t - offset, period)


def previous_period_ms(period_ms: int, shift: int = 0) -> int:
    """The standard period below ``period_ms`` (``shift`` further steps down), clamped to the ladder.

    A period off the ladder starts from the next larger standard period.
    """
    ladder = PERIOD_LADDER_MS
    above = sum(1 for p in ladder if p < period_ms)
    index = above - 1 if period_ms in ladder else above
    return ladder[min(max(index - shift, 0), len(ladder) - 1)]


# --- flags --------------------------------------------------------------------


def _has_bit(flag, bit: int) -> Column:
    return _col(flag).bitwiseAND(F.lit(bit)) != 0


def is_buy(flag) -> Column:
    return _has_bit(flag, FLAG_BUY)


def is_sell(flag) -> Column:
    return _has_bit(flag, FLAG_SELL)


def is_liquidation(flag) -> Column:
    return _has_bit(flag, FLAG_LIQUIDATION)


def side_of(flag) -> Column:
    return F.when(is_buy(flag), "buy").when(is_sell(flag), "sell").otherwise("none")


# --- numbers ------------------------------------------------------------------


def is_finite(c) -> Column:
    c = _col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def is_normal(c) -> Column:
    """Finite, non-zero and not subnormal."""
    return is_finite(c) & (F.abs(_col(c)) >= F.lit(SMALLEST_NORMAL))


def nan_to_num(c, replacement: float = 0.0) -> Column:
    return F.when(is_finite(c), _col(c)).otherwise(F.lit(replacement))


def clamp(c, low, high) -> Column:
    return F.least(F.greatest(_col(c), F.lit(low)), F.lit(high))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Division giving null instead of an error on a zero denominator."""
    return F.try_divide(numerator, denominator)


def safe_double(c, default: float = 0.0) -> Column:
    """A numeric string as a double, or the default when it cannot be read."""
    return F.coalesce(_col(c).try_cast("double"), F.lit(default))


def safe_long(c, default: int = 0) -> Column:
    return F.coalesce(_col(c).try_cast("bigint"), F.lit(default).cast("bigint"))


# --- names --------------------------------------------------------------------


def pair_hash(c) -> Column:
    """63-bit hash of a market name; the empty name hashes to 0.

    The four 64-bit words of the SHA-256 digest and a salt are XOR-ed and the sign
    bit cleared, worked out on 32-bit halves so that no step overflows.
    """
    c = _col(c)
    digest = F.sha2(c, 256)

    def halves(first: int) -> Column:
        words = [F.conv(F.substring(digest, first + 16 * i, 8), 16, 10).cast("bigint") for i in range(4)]
        out = words[0]
        for w in words[1:]:
            out = out.bitwiseXOR(w)
        return out

    high = halves(1).bitwiseXOR(F.lit(PAIR_HASH_SALT_HIGH)).bitwiseAND(F.lit(0x7FFFFFFF))
    low = halves(9).bitwiseXOR(F.lit(PAIR_HASH_SALT_LOW))
    return F.when(c == "", F.lit(0).cast("bigint")).otherwise(F.shiftleft(high, 32).bitwiseOR(low))


def sanitize_pair(c, replacement: str = "X", include_hash: bool | None = None) -> Column:
    """A file-safe market name; the hash of the original is appended when anything was replaced."""
    c = _col(c)
    trimmed = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    # characters outside the basic plane count as two
    widened = F.regexp_replace(trimmed, r"[\x{10000}-\x{10FFFF}]", "  ")
    safe = F.regexp_replace(widened, r"[^A-Za-z0-9_\-]", replacement)
    digits = F.lower(F.hex(pair_hash(c)))
    suffix = F.when(F.length(digits) < 8, F.lpad(digits, 8, "0")).otherwise(digits)
    wanted = (widened.rlike(r"[^A-Za-z0-9_\-]")) if include_hash is None else F.lit(include_hash)
    return F.when(wanted, F.concat(safe, suffix)).otherwise(safe)


def escape_market(c) -> Column:
    return F.lower(F.translate(_col(c), "/- .", "____"))


@F.pandas_udf(T.StringType())
def _normalize_name(names: pd.Series) -> pd.Series:
    table = {ord(ch): "_" for ch in NAME_REPLACED_CHARS}

    def one(name):
        if name is None:
            return None
        decomposed = unicodedata.normalize("NFKD", name)
        kept = "".join(ch for ch in decomposed if unicodedata.category(ch) != "Mn")
        return unicodedata.normalize("NFKC", kept.translate(table))

    return names.map(one)


def standardize_name(c) -> Column:
    """Table-name form of a text.  Every row passes a Python worker in Arrow batches: normalise distinct names, not rows."""
    return _normalize_name(_col(c))


def is_valid_name(c) -> Column:
    return _col(c).rlike(VALID_NAME_PATTERN)


# --- option ids ---------------------------------------------------------------


def parse_option_id(c) -> Column:
    """``ULY-yyMMdd-strike-P|C`` as a struct, null when the text has another form."""
    c = _col(c)

    def part(i: int) -> Column:
        return F.regexp_extract(c, OPTION_ID_PATTERN, i)

    yymmdd = part(2)
    return F.when(
        c.rlike(OPTION_ID_PATTERN),
        F.struct(
            part(1).alias("underlying"),
            F.substring(yymmdd, 1, 2).try_cast("int").alias("year"),
            F.substring(yymmdd, 3, 2).try_cast("int").alias("month"),
            F.substring(yymmdd, 5, 2).try_cast("int").alias("day"),
            F.concat(
                F.lit("20"), F.substring(yymmdd, 1, 2), F.lit("-"), F.substring(yymmdd, 3, 2), F.lit("-"),
                F.substring(yymmdd, 5, 2),
            ).try_cast("date").alias("expiry"),
            part(3).try_cast("double").alias("strike"),
            F.upper(part(4)).alias("side"),
        ),
    )


def format_option_id(option) -> Column:
    """Inverse of :func:`parse_option_id`."""
    o = _col(option)
    strike = o["strike"]
    whole = (strike == F.floor(strike)) & (F.abs(strike) < 1e15)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(
        o["underlying"], F.lit("-"), two(o["year"]), two(o["month"]), two(o["day"]), F.lit("-"),
        F.when(whole, F.try_divide(strike, F.lit(1.0)).try_cast("bigint").cast("string")).otherwise(strike.cast("string")),
        F.lit("-"), o["side"],
    )


# --- prices -------------------------------------------------------------------


def price_key(price) -> Column:
    """Level key of a price: log2 cut to 8 decimals, toward zero."""
    log = F.log2(_col(price))
    return F.signum(log) * F.floor(F.abs(log) * 1e8) / 1e8


def price_of_key(key) -> Column:
    return F.pow(F.lit(2.0), _col(key))


def round_half_away(x: Column, digits: Column) -> Column:
    scale = F.pow(F.lit(10.0), digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def round_to_tick(price, increment) -> Column:
    """Up to the next multiple of the increment, then to the decimals the increment carries."""
    inc = _col(increment)
    digits = F.greatest(F.ceil(-F.log10(inc * 2)), F.lit(0)).cast("double")
    return round_half_away(F.ceil(_col(price) / inc) * inc, digits)


def book_grouping(bid, ask, increment, percent: float = 0.05) -> Column:
    """Grouping step of a book: a share of the mid price on the tick grid, at least one tick."""
    mid = (_col(bid) + _col(ask)) * 0.5
    return F.greatest(round_to_tick(mid * (percent / 100.0), increment), _col(increment))


def geometric_index(start, end, step, reverse: bool = True) -> Column:
    """``step`` log2-spaced integer positions from ``start`` to ``end``, both ends pinned.

    Rounding is half to even.  Worked out in double precision.
    """
    start, end, step = (x if isinstance(x, Column) else F.lit(x) for x in (start, end, step))

    def spaced(bounds: Column) -> Column:
        first, last, n, low, high = (bounds[c] for c in ("first", "last", "n", "low", "high"))

        def position(j: Column) -> Column:
            i = n - 1 - j if reverse else j
            x = F.pow(F.lit(2.0), low + i * (high - low) / (n - 1))
            x = last - (x - first) if reverse else x
            return F.when(j == n - 1, last).when(j == 0, first).otherwise(F.rint(x).cast("int"))

        return F.transform(F.sequence(F.lit(0), n - 1), position)

    bounds = F.struct(
        start.cast("int").alias("first"), end.cast("int").alias("last"), step.cast("int").alias("n"),
        F.log2(start.cast("double")).alias("low"), F.log2(end.cast("double")).alias("high"),
    )
    return let(bounds, spaced)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fix_index(positions) -> Column:
    """Positions made strictly increasing: lowered from the right (not below 0), then raised from the left."""

    def lower(p: Column) -> Column:
        gaps = lambda i: F.transform(F.sequence(i, F.size(p) - 1), lambda j: F.get(p, j) - (j - i))
        return F.transform(p, lambda _, i: F.greatest(F.lit(0), F.array_min(gaps(i))))

    def lift(p: Column) -> Column:
        gaps = lambda i: F.transform(F.sequence(F.lit(0), i), lambda j: F.get(p, j) + (i - j))
        return F.transform(p, lambda _, i: F.array_max(gaps(i)))

    return let(let(_col(positions), lower), lift)
