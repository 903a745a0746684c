"""Queries on quantile digests: what a digest answers, held against the exact ranks of all trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators.digests import total_weight
from tickloom.plans.bars import DAY_MS
from tickloom.plans.registry import query
from tickloom.plans.views import view, with_views

PERIODS = [28 * DAY_MS, 364 * DAY_MS]
#: Share of all weight by which the rank of an answer may be off.
RANK_ERROR = 0.01


def _trades(spark, sf_dir) -> DataFrame:
    return B.bucketed(B.valid_trades(view(spark, sf_dir, "trades_big")), PERIODS)


def answered(digests: DataFrame, rows: DataFrame) -> DataFrame:
    """For each bucket and quantile: the weight of its digest, and whether the exact rank of its answer is right within ``RANK_ERROR``.

    An answer between two values has any rank between theirs.
    """
    part = [*B.GROUP, "kind"]
    names = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(kind).alias("k"), F.lit(q).alias("fraction"), F.col(n).alias("answer")) for n, (kind, q) in B.BAR_QUANTILES.items()))
    answers = B.digest_columns(digests).select(*B.GROUP, F.inline(names)).withColumnRenamed("k", "kind")
    atoms = B.bar_values(rows, F.col("volume")).groupBy(*part, "value").agg(F.sum("freq").alias("freq"))
    value, answer = F.col("value"), F.col("answer")
    near = atoms.join(answers, part).groupBy(*part, "name", "fraction").agg(
        F.max(F.when(value <= answer, value)).alias("low"), F.min(F.when(value >= answer, value)).alias("high"), F.sum("freq").alias("all")
    )
    ranks = atoms.join(near, part).groupBy(*part, "name", "fraction", "all").agg(
        F.sum(F.when(value < F.col("low"), F.col("freq")).otherwise(0.0)).alias("below"), F.sum(F.when(value <= F.col("high"), F.col("freq")).otherwise(0.0)).alias("upto")
    )
    right = (F.col("below") / F.col("all") - F.col("fraction") <= RANK_ERROR) & (F.col("fraction") - F.col("upto") / F.col("all") <= RANK_ERROR)
    weights = digests.select(*part, total_weight(F.col("digest")).alias("weight"))
    return ranks.join(weights, part).select("market", "period_ms", "offset_ms", F.col("bucket_ms").alias("time_ms"), "name", "weight", right.alias("within"))


def _sql() -> str:
    pairs = ", ".join(f"(CAST({p} AS BIGINT))" for p in PERIODS)
    names = ", ".join(f"('{n}', '{kind}')" for n, (kind, _) in B.BAR_QUANTILES.items())
    return with_views(
        "trades_big",
        f"""SELECT market, period_ms, CAST(0 AS BIGINT) AS offset_ms, time_ms - ((time_ms % period_ms) + period_ms) % period_ms AS time_ms, name,
            CAST(CASE WHEN any_value(kind) = 'p' THEN sum(volume) ELSE count(*) END AS DOUBLE) AS weight, TRUE AS within
        FROM (SELECT t.*, period_ms FROM trades_big t, (VALUES {pairs}) p(period_ms) WHERE price > 0 AND volume > 0) s, (VALUES {names}) n(name, kind)
        GROUP BY market, period_ms, time_ms - ((time_ms % period_ms) + period_ms) % period_ms, name""",
    )


@query("bar_quantile_digests", _sql(), "weight")
def bar_quantile_digests(spark, sf_dir):
    """Quantiles from digests of all trades, each within one in a hundred of the exact rank."""
    rows = _trades(spark, sf_dir)
    return answered(B.bar_digests(rows), rows)


@query("bar_digests_refreshed", _sql(), "weight")
def bar_digests_refreshed(spark, sf_dir):
    """Digests stored for four fifths of the trades; those of the late fifth are merged in without reading the others again."""
    from tickloom.session import scratch_table

    rows = _trades(spark, sf_dir)
    late = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    stored = scratch_table(B.bar_digests(rows.filter(~late)))
    fresh = scratch_table(B.bar_digests(rows.filter(late)))
    refreshed = B.refreshed_digests(stored, fresh)
    keys = [*B.GROUP, "kind"]
    return answered(scratch_table(stored.join(fresh.select(*keys), keys, "left_anti").unionByName(refreshed)), rows)
