"""Reading stored trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scan_trades(
    trades: DataFrame, market: str | Sequence[str] | None = None, lo_ms: int | None = None, hi_ms: int | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Trades of ``[lo_ms, hi_ms)``.

    The comparisons are on plain columns, so they reach the Parquet reader; a ``date``
    partition column, where the table has one, is pruned as well.
    """
    out = trades
    if market is not None:
        out = out.filter(F.col("market").isin([market] if isinstance(market, str) else list(market)))
    for bound, low in ((lo_ms, True), (hi_ms, False)):
        if bound is None:
            continue
        out = out.filter(F.col("time_ms") >= bound if low else F.col("time_ms") < bound)
        if "date" in trades.columns:
            day = F.to_date(F.timestamp_millis(F.lit(bound)))
            out = out.filter(F.col("date") >= day if low else F.col("date") <= day)
    return out.orderBy("time_ms", "id") if ordered else out
