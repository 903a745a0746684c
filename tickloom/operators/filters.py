"""Row filters, quality checks and name filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import is_finite, is_normal

# Fixed value: a filter entry of this form is a plain name, anything else is also a pattern.
PLAIN_ENTRY = r"^[a-zA-Z][\w:/\-_]+$"
# Fixed value: books at or before this time (2008-01-01 UTC) are refused.
OLDEST_BOOK_MS = 1_199_145_600_000
DAY_MS = 86_400_000


def pair_filter(spec: str, column="market", allow_regex: bool = True) -> Column:
    """Predicate for a name filter text.

    Entries are separated by line breaks or ``;``.  ``#`` and ``//`` entries are
    comments.  Each entry matches its own name without regard to case; one that does
    not look like a plain name also matches as an unanchored pattern.  A filter without
    entries, or with ``.*`` as its only pattern, accepts every name.
    """
    col = F.col(column) if isinstance(column, str) else column
    entries = [e.strip() for e in re.split(r"[\r\n;]", spec)]
    entries = [e for e in entries if e and not e.startswith(("#", "//"))]
    names: list[str] = []
    for entry in entries:
        if entry.lower() not in (n.lower() for n in names):
            names.append(entry)
    patterns = [e for e in names if allow_regex and not re.match(PLAIN_ENTRY, e)]
    if not names or patterns == [".*"]:
        return F.lit(True)
    keep = F.lower(col).isin([n.lower() for n in names])
    for pattern in patterns:
        keep = keep | col.rlike("(?is)" + pattern)
    return keep


def valid_trades(trades: DataFrame) -> DataFrame:
    return trades.filter((F.col("price") > 0) & (F.col("volume") > 0))


def _failed(rules: dict[str, Column]) -> Column:
    names = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))
    return F.filter(names, lambda x: x.isNotNull())


def _at_least_zero(c: str) -> Column:
    return (F.col(c) >= 0) & is_finite(c)


def check_trades(trades: DataFrame) -> DataFrame:
    """Adds ``failed``: the names of the table rules a trade breaks (null values break them too)."""
    return trades.withColumn(
        "failed",
        _failed(
            {
                "time_positive": F.col("time_ms") > 0,
                "price_positive": (F.col("price") > 0) & is_finite("price"),
                "volume_positive": _at_least_zero("volume"),
                "valid_flag": (F.col("flag") >= 0) & (F.col("flag") < 8),
            }
        ),
    )


def check_futures_stats(stats: DataFrame) -> DataFrame:
    """Adds ``failed`` for futures statistics rows."""
    return stats.withColumn(
        "failed",
        _failed(
            {
                "market_positive": F.col("market_hash") > 0,
                "time_positive": F.col("time_ms") > 0,
                "open_interest_positive": _at_least_zero("open_interest"),
                "open_interest_usd_positive": _at_least_zero("open_interest_usd"),
                "next_funding_rate_finite": is_finite("next_funding_rate"),
                "spread_finite": is_finite("spread"),
                "mark_positive": _at_least_zero("mark"),
            }
        ),
    )


def check_bars(bars: DataFrame) -> DataFrame:
    """Adds ``failed`` for bars."""
    return bars.withColumn("failed", _failed({"time_positive": F.col("time_ms") > 0}))


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that passed every rule (without the rule column), and the rejected ones."""
    return checked.filter(F.size("failed") == 0).drop("failed"), checked.filter(F.size("failed") > 0)


def validate_book(books: DataFrame, now_ms: int) -> DataFrame:
    """Adds ``failed`` (rule names), ``valid`` and ``empty`` to grouped books.

    Input columns: ``market, time_ms, grouping, bids, asks`` with levels as arrays of
    ``struct<price, size>``.  An empty book is only flagged: it stays valid.
    """
    bids, asks = F.col("bids"), F.col("asks")
    empty = (F.size(bids) == 0) & (F.size(asks) == 0)
    bad_size = lambda x: (x["size"] < 0) | ~is_finite(x["size"])
    failed = _failed(
        {
            "grouping": (F.col("grouping") > 0) & is_finite("grouping"),
            "market_empty": F.length(F.trim("market")) > 0,
            "market_non_ascii": F.coalesce(F.col("market"), F.lit("")).rlike(r"\A\p{ASCII}*\z"),
            "time_too_old": F.col("time_ms") > OLDEST_BOOK_MS,
            "time_in_future": F.col("time_ms") <= now_ms + DAY_MS,
            "ask_price": ~F.exists(asks, lambda x: (x["price"] <= 0) | ~is_normal(x["price"])),
            "ask_size": ~F.exists(asks, bad_size),
            "bid_price": ~F.exists(bids, lambda x: (x["price"] < 0) | ~is_finite(x["price"])),
            "bid_size": ~F.exists(bids, bad_size),
        }
    )
    return books.withColumn("failed", failed).withColumns({"valid": F.size("failed") == 0, "empty": empty})


def live_instruments(instruments: DataFrame, state: str | None = "live", column: str = "state") -> DataFrame:
    """Instruments in a state; use ``state='TRADING', column='status'`` for exchange-info symbols."""
    return instruments.filter(F.col(column) == state) if state else instruments


def tradable_markets(markets: DataFrame, filter_spec: str = "") -> DataFrame:
    """Markets with a usable two-sided quote, one row per name (the first by quote)."""
    usable = markets.filter(
        F.col("enabled") & ~F.col("post_only") & (F.col("ask") > 0) & (F.col("bid") > 0)
        & pair_filter(filter_spec, "name")
    )
    rest = [c for c in markets.columns if c != "name"]
    # one row per name irrespective of case; ties resolved by value so that a re-run gives the same row
    first = usable.groupBy(F.lower("name").alias("_name")).agg(F.min(F.struct("name", *rest)).alias("_m"))
    return first.select(*(F.col("_m")[c].alias(c) for c in markets.columns))


def reject_epoch_books(books: DataFrame, time_col: str = "time_ms") -> tuple[DataFrame, DataFrame]:
    """Books with a real time, and those at or before the epoch (or without a time)."""
    ok = F.coalesce(F.col(time_col) > 0, F.lit(False))
    return books.filter(ok), books.filter(~ok)


def restrict_to(df: DataFrame, symbols: DataFrame, on: str = "symbol") -> DataFrame:
    """Rows whose symbol is listed."""
    return df.join(symbols.select(on).distinct(), on, "left_semi")


def missing_symbols(requested: DataFrame, received: DataFrame, on: str = "symbol") -> DataFrame:
    """Requested symbols that did not arrive."""
    return requested.select(on).distinct().join(received.select(on), on, "left_anti")


def all_instruments(*lists: DataFrame, on: str = "inst_id") -> DataFrame:
    """Every instrument named in any list, once."""
    out = lists[0].select(on)
    for other in lists[1:]:
        out = out.unionByName(other.select(on))
    return out.distinct()


def common_keys(*lists: DataFrame, on: str = "inst_id") -> DataFrame:
    """Instruments present in all lists."""
    out = lists[0].select(on)
    for other in lists[1:]:
        out = out.intersect(other.select(on))
    return out.distinct()


def except_keys(a: DataFrame, b: DataFrame, on: str = "inst_id") -> DataFrame:
    return a.select(on).subtract(b.select(on))
