"""Order books: level state from updates, level selection, condensing, regrouping, layout.

A book side is kept as rows ``(keys..., side, price, ...)``.  Steps along a side (position,
segment) are prefix computations in slices of price, so a deep side is not one task's work.
Arrays only appear in results, where their length is fixed by a parameter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.scalars import fix_index, geometric_index, let, price_key
from tickloom.operators.latest import top_k_per_group
from tickloom.operators.prefix import ROWS_PER_KEY, dealt, each_step, large_keys, running

# Levels kept per side.
DETAILED_LEVELS = 128
SIMPLE_LEVELS = 25
REGROUPED_LEVELS = 25
# Least filled share before unchanged levels are admitted; weights of the size deviation.
MIN_FILL = 0.8
OWN_STD_WEIGHT = 0.8
# Fixed value: price step below a lone level.
LONE_LEVEL_STEP = 1.0005
# Fixed value: logarithmic price range beyond which the far end is cut off.
MAX_LOG_RANGE = 1.0

SLICES_PER_OCTAVE = 16


# --- state ----------------------------------------------------------------------


def level_stats(updates: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """State and statistics of every price level from its updates.

    Updates are ordered by ``(final_id, event_ms, qty)``; all of them apply, as an update is
    only refused when its id is below the level's.  Levels with a last quantity of 0 are kept:
    :func:`book_view` leaves them out.
    """
    order = F.struct("final_id", "event_ms", "qty")
    return (
        updates.withColumn("level_key", price_key("price"))
        .groupBy(*keys, "side", "level_key")
        .agg(
            F.min(F.struct("final_id", "event_ms", "qty", "price")).alias("_first"),
            F.max(order).alias("_last"),
            F.count(F.lit(1)).alias("change_count"),
            F.var_pop("qty").alias("qty_var"),
            F.stddev_samp("qty").alias("qty_std"),
            F.avg("qty").alias("qty_mean"),
        )
        .select(
            *keys, "side", "level_key",
            F.col("_first")["price"].alias("price"),
            F.col("_last")["qty"].alias("qty"),
            F.col("_last")["final_id"].alias("last_id"),
            F.col("_last")["event_ms"].alias("last_ms"),
            "change_count", F.col("change_count").alias("stat_count"), "qty_var", "qty_std", "qty_mean",
        )
    )


def book_view(levels: DataFrame) -> DataFrame:
    """Levels a book shows."""
    return levels.filter((F.col("qty") > 0) & (F.col("price") > 0))


def book_extremes(snapshot: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Lowest bid, highest ask and entry counts: the range a snapshot replaces."""
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    return snapshot.groupBy(*keys).agg(
        F.min(F.when(bid, F.col("price"))).alias("min_bid"),
        F.max(F.when(ask, F.col("price"))).alias("max_ask"),
        F.count_if(bid).alias("bid_count"),
        F.count_if(ask).alias("ask_count"),
    )


def book_at_ticks(
    updates: DataFrame, tick_ms: int, keys: Sequence[str] = ("symbol",), until_ms: int | None = None,
    expiry_ms: int | None = None,
) -> DataFrame:
    """Every book at every tick: levels with their state at the tick and what changed since the one before.

    A level is reported from the tick after its first update until the symbol's last tick (or
    ``until_ms``) while its quantity is positive and, with ``expiry_ms``, its last update is
    recent enough.  Change counts and statistics cover the tick's own interval, 0 where
    nothing happened.  Rows are generated per level from its own changes.
    """
    tick = (F.floor(F.col("event_ms") / tick_ms).cast("bigint") + 1) * tick_ms
    stamped = updates.withColumn("tick_ms", tick)
    stats = level_stats(stamped, [*keys, "tick_ms"])
    ends = stamped.groupBy(*keys).agg(F.max("tick_ms").alias("_end"))
    level = Window.partitionBy(*keys, "side", "level_key").orderBy("tick_ms")
    until = F.col("_end") if until_ms is None else F.lit(until_ms).cast("bigint")
    spans = stats.join(ends, list(keys)).withColumns(
        {"_next": F.lead("tick_ms").over(level), "_price": F.first("price").over(level)}
    )
    last = F.least(F.coalesce(F.col("_next") - tick_ms, until), until)
    if expiry_ms is not None:
        last = F.least(last, F.floor((F.col("last_ms") + expiry_ms) / tick_ms).cast("bigint") * tick_ms)
    shown = spans.filter(F.col("qty") > 0).withColumn("_from", F.col("tick_ms"))
    shown = each_step(shown, F.col("tick_ms"), last, tick_ms, "tick_ms")
    own = F.col("tick_ms") == F.col("_from")
    zero = F.lit(0).cast("bigint")
    return shown.select(
        *keys, "tick_ms", "side", "level_key", F.col("_price").alias("price"), "qty", "last_id", "last_ms",
        F.when(own, F.col("change_count")).otherwise(zero).alias("change_count"),
        F.when(own, F.col("stat_count")).otherwise(zero).alias("stat_count"),
        *(F.when(own, F.col(c)).alias(c) for c in ("qty_var", "qty_std", "qty_mean")),
    )


# --- selection ------------------------------------------------------------------


def nearness() -> Column:
    """Grows toward the best price of a side."""
    return F.when(F.col("side") == "ask", -F.col("price")).otherwise(F.col("price"))


def _sampled(candidates: DataFrame, best: DataFrame, book: Sequence[str], k: int) -> DataFrame:
    """At most ``k`` candidates per book side: all of them, or the best level and ``k - 1`` in hash order."""
    names = [*book, "price"]
    counts = candidates.groupBy(*book).agg(F.count(F.lit(1)).alias("_n"))
    draw = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in names)))
    marked = (
        candidates.withColumn("_best", F.lit(False))
        .unionByName(best.select(*names).withColumn("_best", F.lit(True)))
        .groupBy(*names)
        .agg(F.max("_best").alias("_best"), F.min("_best").alias("_only_best"))
        .join(counts, list(book))
        .withColumn("_draw", draw)
    )
    # within the limit the best level is kept only where it was chosen itself
    crowded = F.col("_n") > k
    wanted = marked.filter(crowded | ~F.col("_only_best"))
    order = [F.when(crowded, F.col("_best")).otherwise(F.lit(True)).desc(), F.col("_draw")]
    return top_k_per_group(wanted, book, order, k).select(*names)


def select_levels(
    levels: DataFrame, criteria: Sequence[tuple[Sequence[Column], Column | None]], k: int,
    keys: Sequence[str] = ("symbol",), admit: Column | None = None,
) -> DataFrame:
    """Levels (``keys, side, price``) kept of each book side: the union of one top-k per criterion.

    A criterion is its descending order and a condition (or None); nearness to the best
    price decides ties.  ``admit`` is a condition for all.  Each top-k is limited in every
    task before its shuffle.  Should the union exceed ``k``, the best price and ``k - 1``
    others are kept, drawn by a hash so that a re-run draws the same.
    """
    book = [*keys, "side"]
    view = book_view(levels)
    eligible = view.filter(admit) if admit is not None else view
    chosen = None
    for order, condition in criteria:
        rows = eligible.filter(condition) if condition is not None else eligible
        top = top_k_per_group(rows, book, [*(c.desc() for c in order), nearness().desc()], k).select(*book, "price")
        chosen = top if chosen is None else chosen.unionByName(top)
    best = view.groupBy(*book).agg(F.max_by("price", nearness()).alias("price"))
    return _sampled(chosen.distinct(), best, book, k)


def select_levels_detailed(levels: DataFrame, k: int = DETAILED_LEVELS, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Kept levels by change count, quantity, and quantity variance (from 3 observations on).

    Only levels that changed are candidates, unless that fills less than 80 % of ``k``.
    """
    book = [*keys, "side"]
    c = F.col
    criteria = [
        ([c("change_count"), c("qty")], None),
        ([c("qty")], None),
        ([c("qty_var"), c("qty_mean")], c("stat_count") >= 3),
    ]
    changed = select_levels(levels, criteria, k, keys, c("change_count") > 0)
    every = select_levels(levels, criteria, k, keys)
    full = changed.groupBy(*book).agg(F.count(F.lit(1)).alias("_n")).filter(c("_n") >= MIN_FILL * k).select(*book)
    return changed.join(full, book, "left_semi").unionByName(every.join(full, book, "left_anti"))


def select_levels_simple(levels: DataFrame, k: int = SIMPLE_LEVELS, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Kept levels by order count and by quantity; levels carry ``count``."""
    return select_levels(levels, [([F.col("count"), F.col("qty")], None), ([F.col("qty")], None)], k, keys)


# --- segments -------------------------------------------------------------------


def outward() -> Column:
    """Grows from the best price of a side outward."""
    return -nearness()


def segments(levels: DataFrame, selected: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Visible levels with the kept level they fold into: the nearest kept one at a better price.

    Levels better than every kept one belong to none and are left out.  Adds ``head``
    (is kept), ``segment`` (outward coordinate of the head) and, about the segment,
    ``gap`` (positions to the next head, or to the end of the side), ``_later`` (members
    with statistics taken up after this one) for the size deviation.
    """
    book = [*keys, "side"]
    marked = book_view(levels).join(selected.withColumn("head", F.lit(True)), [*book, "price"], "left")
    marked = marked.withColumns({"head": F.coalesce("head", F.lit(False)), "_out": outward()})
    counted = F.when(~F.col("head") & (F.col("stat_count") > 2), 1).otherwise(0)
    log = F.log2("price") * SLICES_PER_OCTAVE
    chunk = F.floor(F.when(F.col("side") == "ask", log).otherwise(-log))
    placed = running(
        marked.withColumn("_counted", counted), book, ["_out"], chunk,
        sums={"_pos": F.lit(1), "_seen": F.col("_counted")}, lasts={"segment": F.when(F.col("head"), F.col("_out"))},
        totals=True, inclusive=True,
    )
    ahead = Window.partitionBy(*book).orderBy("_pos")
    heads = placed.filter("head").select(
        *book, F.col("_out").alias("segment"),
        (F.coalesce(F.lead("_pos").over(ahead), F.col("_pos_total")) - F.col("_pos")).alias("gap"),
        F.col("_seen").alias("_seen_head"),
        (F.coalesce(F.lead("_seen").over(ahead), F.col("_seen_total")) - F.col("_seen")).alias("_members"),
    )
    inner = placed.filter(F.col("segment").isNotNull()).join(heads, [*book, "segment"])
    nearer = F.col("_seen") - 1 - F.col("_seen_head")
    # asks are taken from the far end inward, bids from the head outward
    later = F.when(F.col("side") == "ask", nearer).otherwise(F.col("_members") - 1 - nearer)
    return inner.withColumn("_later", later).drop("_pos", "_seen", "_pos_total", "_seen_total", "_seen_head", "_members")


def segment_size_std() -> Column:
    """Deviation of size of a segment, an aggregate over its levels.

    A moving average (span: the gap to the next head) of the members' population
    deviations, seeded with the first positive one, mixed with the head's own sample
    deviation where both exist.
    """
    alpha = F.lit(2.0) / (F.col("gap") + 1)
    std, later = F.sqrt("qty_var"), F.col("_later")
    keep = F.when(later == 0, F.lit(1.0)).otherwise(F.pow(1 - alpha, later.cast("double")))
    member = F.col("_counted") == 1
    positive = F.when(member & (std > 0), later)
    ema = F.coalesce(F.sum(F.when(member, alpha * std * keep)), F.lit(0.0)) + F.coalesce(
        F.max_by((1 - alpha) * std * keep, positive), F.lit(0.0)
    )
    own = F.max(F.when(F.col("head") & (F.col("stat_count") >= 2), F.col("qty_std")))
    mixed = F.when(own > 0, OWN_STD_WEIGHT * own + (1 - OWN_STD_WEIGHT) * ema).otherwise(ema)
    return F.when(ema > 0, mixed).otherwise(F.coalesce(own, ema))


def segment_aggregate(members: DataFrame, keys: Sequence[str] = ("symbol",), deviation: bool = True) -> DataFrame:
    """One row per segment: the head's price and size, and the sums of its levels.

    The total change count is the sum of the members' own counts.
    """
    head = lambda c: F.max(F.when(F.col("head"), F.col(c)))
    return members.groupBy(*keys, "side", "segment").agg(
        head("price").alias("price"),
        F.sum("qty").alias("size"),
        head("qty").alias("raw_size"),
        (F.sum(F.col("price") * F.col("qty")) / F.sum("qty")).alias("mean_price"),
        head("change_count").alias("change_count"),
        F.sum("change_count").alias("total_change_count"),
        *([segment_size_std().alias("size_std")] if deviation else []),
        F.count(F.lit(1)).alias("aggregate_count"),
    )


def condense_detailed(levels: DataFrame, k: int = DETAILED_LEVELS, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """At most ``k`` records per book side, as rows.

    ``levels`` is read several times: pass a written table rather than a long plan.
    """
    members = segments(levels, select_levels_detailed(levels, k, keys), keys)
    return segment_aggregate(members, keys)


def condense_simple(levels: DataFrame, k: int = SIMPLE_LEVELS, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """At most ``k`` records (mean price, size, order count) per book side; levels carry ``count``."""
    known = levels.withColumns({"stat_count": F.lit(0)})
    members = segments(known, select_levels_simple(levels, k, keys), keys)
    return members.groupBy(*keys, "side", "segment").agg(
        (F.sum(F.col("price") * F.col("qty")) / F.sum("qty")).alias("price"),
        F.sum("qty").alias("size"),
        F.sum("count").alias("count"),
    )


def pad_levels(
    levels: Column, n: int, types: dict[str, str], price_from: str = "price", keep: Sequence[str] = ("price",)
) -> Column:
    """A side (best first) filled to ``n`` levels with the last level's price and zeros elsewhere.

    ``types`` are the fields of a level; those in ``keep`` carry ``price_from`` of the last
    level.  A side without levels is all zeros.
    """
    last = F.when(F.size(levels) > 0, F.element_at(levels, -1))
    price = F.coalesce(last[price_from], F.lit(0.0))
    filler = F.struct(*((price if f in keep else F.lit(0)).cast(t).alias(f) for f, t in types.items()))
    return F.concat(levels, F.array_repeat(filler, F.greatest(F.lit(0), n - F.size(levels))))


def side_arrays(
    rows: DataFrame, keys: Sequence[str], n: int, fields: Sequence[str], price_from: str, keep: Sequence[str]
) -> DataFrame:
    """Condensed rows as one row per book with padded ``bids`` and ``asks``, both in rising price.

    Each side has at most ``n`` rows, so the arrays are bounded.
    """
    types = {f: rows.schema[f].dataType.simpleString() for f in fields}
    entry = F.struct(F.col("segment"), *fields)
    picked = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, entry)))
    books = rows.groupBy(*keys).agg(picked("bid").alias("_b"), picked("ask").alias("_a"))

    def padded(column: str) -> Column:
        bare = F.transform(F.col(column), lambda x: F.struct(*(x[f].alias(f) for f in fields)))
        return pad_levels(bare, n, types, price_from, keep)

    return books.select(*keys, F.reverse(padded("_b")).alias("bids"), padded("_a").alias("asks"))


DETAILED_FIELDS = "price size raw_size mean_price change_count total_change_count size_std aggregate_count".split()


def condensed_book(levels: DataFrame, k: int = DETAILED_LEVELS, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Books of exactly ``k`` detailed levels per side."""
    return side_arrays(condense_detailed(levels, k, keys), keys, k, DETAILED_FIELDS, "mean_price", ("price", "mean_price"))


def condensed_book_simple(levels: DataFrame, k: int = SIMPLE_LEVELS, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Books of exactly ``k`` simple levels per side."""
    return side_arrays(condense_simple(levels, k, keys), keys, k, ["price", "size", "count"], "price", ("price",))


# --- regrouping -----------------------------------------------------------------


def extrapolate_levels(levels: Column, n: int, reverse: bool = False) -> Column:
    """A side of fewer than ``n`` levels (rising price) padded by its mean relative price step, size 0.

    With ``reverse`` the padding continues below the lowest price.  A lone level is followed
    by prices that fall by a fixed step, an empty side by zeros.
    """
    pair = lambda price: F.struct(price.alias("price"), F.lit(0.0).alias("size"))

    def mean_step(line: Column) -> Column:
        steps = F.zip_with(
            F.slice(line, F.lit(2), F.size(line) - 1), F.slice(line, F.lit(1), F.size(line) - 1),
            lambda x, before: F.try_divide(x["price"], before["price"]) - 1,
        )
        return let(
            F.filter(steps, lambda x: x.isNotNull()),
            lambda known: F.coalesce(
                F.try_divide(F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x), F.size(known)), F.lit(0.0)
            ),
        )

    def grow(line: Column) -> Column:
        more = F.sequence(F.lit(1), n - F.size(line))
        tail = let(
            F.struct(mean_step(line).alias("step"), F.element_at(line, -1)["price"].alias("price")),
            lambda end: F.transform(more, lambda j: pair(end["price"] * F.pow(1 + end["step"], j.cast("double")))),
        )
        return F.concat(line, tail)

    def lone(line: Column) -> Column:
        falling = lambda i: pair(F.get(line, F.lit(0))["price"] / F.pow(F.lit(LONE_LEVEL_STEP), i.cast("double")))
        return F.concat(line, F.transform(F.sequence(F.lit(1), F.lit(n - 1)), falling))

    def extended(side: Column) -> Column:
        grown = F.reverse(let(F.reverse(side), grow)) if reverse else grow(side)
        return (
            F.when(F.size(side) >= n, side)
            .when(F.size(side) == 0, F.array_repeat(pair(F.lit(0.0)), n))
            .when(F.size(side) == 1, lone(side))
            .otherwise(grown)
        )

    return let(levels, extended)


def regroup_positions(length: Column, cut: Column, n: int, side: str) -> Column:
    """Positions kept of a side of ``length`` levels in rising price, as a struct of ``start`` and ``kept``.

    ``cut`` drops the outermost group.  Worked out from the length alone.
    """
    extra = F.when(cut, 1).otherwise(0)
    if side == "bid":
        spaced = geometric_index(F.lit(1), length - 1, F.lit(n + 1) + extra, reverse=True)
        start, first = (lambda p: F.when(cut, F.get(p, F.lit(1))).otherwise(0)), F.lit(2) + extra
    else:
        spaced = F.transform(geometric_index(F.lit(1), length, F.lit(n) + extra, reverse=False), lambda x: x - 1)
        start, first = (lambda p: F.lit(0)), F.lit(1)
    chosen = let(
        spaced,
        lambda p: F.struct(start(p).cast("int").alias("start"), fix_index(F.slice(p, first, F.lit(n))).alias("kept")),
    )
    every = F.transform(F.sequence(F.lit(0), length - 1), lambda x: x.cast("int"))
    return F.when(length <= n, F.struct(F.lit(0).cast("int").alias("start"), every.alias("kept"))).otherwise(chosen)


def regroup_sides(
    levels: DataFrame, n: int = REGROUPED_LEVELS, keys: Sequence[str] = ("symbol",), rows_per_key: int = ROWS_PER_KEY
) -> DataFrame:
    """At most ``n`` levels per side at logarithmically spaced positions, sizes of the levels between folded in.

    Input ``keys, side, price, size``, one row per price.  Levels without size at the ends
    are cut first.  A kept level takes the levels between it and the next one farther from
    the best price.  A bid side spanning more than a factor e loses its outermost group; on the
    ask side that group folds into the outermost kept level.  Positions are worked out in
    double precision and sides may be of any length: books of up to ``rows_per_key`` levels are moved once
    and are windows of one task, deeper ones go in slices of price.  ``levels`` is read twice: pass a written table rather than a long plan.
    """
    deep, tasks = large_keys(levels, keys, rows_per_key)
    if deep is None:
        return _regrouped(_placed_whole(levels, n, keys, tasks), keys)
    flat = _placed_whole(levels.join(deep, list(keys), "left_anti"), n, keys, tasks)
    return _regrouped(flat, keys).unionByName(_regrouped(_placed_sliced(levels.join(deep, list(keys), "left_semi"), n, keys), keys))


def _side_bounds() -> dict[str, Column]:
    """Lowest and highest price of a side with size, aggregates over its levels."""
    real = F.col("size") > 0
    return {"_lo": F.min(F.when(real & (F.col("price") > 0), F.col("price"))), "_hi": F.max(F.when(real, F.col("price")))}


def _places(n: int) -> Column:
    """Positions kept of a side of ``_length`` levels between ``_lo`` and ``_hi``."""
    cut = (F.col("_length") > n) & (F.abs(F.log("_lo") - F.log("_hi")) > MAX_LOG_RANGE)
    return F.when(F.col("side") == "bid", regroup_positions(F.col("_length"), cut, n, "bid")).otherwise(
        regroup_positions(F.col("_length"), cut, n, "ask")
    )


def _placed_whole(levels: DataFrame, n: int, keys: Sequence[str], tasks: int) -> DataFrame:
    """Levels with their position ``_pos`` and the ``_places`` of their side, in one shuffle by ``keys``."""
    book = [*keys, "side"]
    side = Window.partitionBy(*book)
    inside = (
        dealt(levels.select(*book, "price", "size").dropna(subset=book), tasks, *keys)
        .withColumns({name: bound.over(side) for name, bound in _side_bounds().items()})
        .filter(F.col("price").between(F.col("_lo"), F.col("_hi")))
    )
    placed = inside.withColumns(
        {"_pos": (F.row_number().over(side.orderBy("price")) - 1).cast("bigint"), "_length": F.count(F.lit(1)).over(side).cast("int")}
    )
    # worked out once a side
    first = placed.withColumn("_at_first", F.when(F.col("_pos") == 0, _places(n)))
    return first.withColumn("_places", F.first("_at_first", ignorenulls=True).over(side)).drop("_lo", "_hi", "_length", "_at_first")


def _placed_sliced(levels: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """The same for sides of any length, in slices of price."""
    book = [*keys, "side"]
    bounds = levels.groupBy(*book).agg(*(bound.alias(name) for name, bound in _side_bounds().items()))
    inside = levels.join(bounds, book).filter(F.col("price").between(F.col("_lo"), F.col("_hi")))
    shape = inside.groupBy(*book).agg(
        F.count(F.lit(1)).cast("int").alias("_length"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")
    )
    chunk = F.floor(F.log2("price") * SLICES_PER_OCTAVE)
    placed = running(inside.drop("_lo", "_hi"), book, ["price"], chunk, sums={"_pos": F.lit(1)})
    return placed.join(shape.select(*book, _places(n).alias("_places")), book)


def _regrouped(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    kept, pos = F.col("_places")["kept"], F.col("_pos")
    below = F.size(F.filter(kept, lambda x: x < pos))
    upto = F.size(F.filter(kept, lambda x: x <= pos)) - 1
    group = F.when(F.col("side") == "bid", below).otherwise(upto)
    return (
        placed.withColumns(
            {
                "level": group,
                "_own": F.get(kept, group) == pos,
                "_counts": F.when(pos >= F.col("_places")["start"], F.col("size")).otherwise(0.0),
            }
        )
        .filter(F.col("level") < F.size(kept))
        .groupBy(*keys, "side", "level")
        .agg(F.max(F.when(F.col("_own"), F.col("price"))).alias("price"), F.sum("_counts").alias("size"))
    )


def regroup_book(levels: DataFrame, n: int = REGROUPED_LEVELS, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Books of exactly ``n`` regrouped levels per side: ``bids`` and ``asks`` in rising price."""
    rows = regroup_sides(levels, n, keys)
    entry = F.struct("level", F.struct("price", "size").alias("entry"))
    picked = lambda side: F.transform(
        F.sort_array(F.collect_list(F.when(F.col("side") == side, entry))), lambda x: x["entry"]
    )
    # books whose sides were cut away entirely still give a row
    every = levels.select(*keys).distinct()
    books = every.join(rows.groupBy(*keys).agg(picked("bid").alias("_b"), picked("ask").alias("_a")), list(keys), "left")
    empty = F.array().cast("array<struct<price:double,size:double>>")
    side = lambda c, reverse: extrapolate_levels(F.coalesce(F.col(c), empty), n, reverse)
    return books.select(*keys, side("_b", True).alias("bids"), side("_a", False).alias("asks"))


# --- layout ---------------------------------------------------------------------


def wide_columns(n: int, with_count: bool = False) -> list[tuple[str, str, str, int]]:
    """``(column, side, field, position)`` of the wide form."""
    fields = ["price", "count", "size"] if with_count else ["price", "size"]
    return [(f"{side[:-1]}_{f}_{i}", side, f, i - 1) for side in ("bids", "asks") for i in range(1, n + 1) for f in fields]


def book_to_wide(books: DataFrame, n: int, with_count: bool = False) -> DataFrame:
    """Level arrays ``bids``, ``asks`` as columns ``bid_price_1`` ... ``ask_size_n``; null past the end."""
    rest = [c for c in books.columns if c not in ("bids", "asks")]
    return books.select(*rest, *(F.get(F.col(s), F.lit(p))[f].alias(c) for c, s, f, p in wide_columns(n, with_count)))


def wide_to_book(wide: DataFrame, n: int, with_count: bool = False) -> DataFrame:
    """Inverse of :func:`book_to_wide`; positions without a price are left out."""
    columns = wide_columns(n, with_count)
    fields = list(dict.fromkeys(f for _, _, f, _ in columns))
    rest = [c for c in wide.columns if c not in {c for c, *_ in columns}]

    def side(name: str) -> Column:
        entries = F.array(*(F.struct(*(F.col(f"{name}_{f}_{i}").alias(f) for f in fields)) for i in range(1, n + 1)))
        return F.filter(entries, lambda x: x["price"].isNotNull())

    return wide.select(*rest, side("bid").alias("bids"), side("ask").alias("asks"))


def split_bid_ask(df: DataFrame, levels: str = "levels") -> DataFrame:
    """First half of a level array as ``bids``, second as ``asks``."""
    half = F.floor(F.size(levels) / 2).cast("int")
    return df.withColumns(
        {"bids": F.slice(F.col(levels), F.lit(1), half), "asks": F.slice(F.col(levels), half + 1, F.size(levels) - half)}
    ).drop(levels)


def concat_bid_ask(df: DataFrame, levels: str = "levels") -> DataFrame:
    """Bids then asks as one level array."""
    return df.withColumn(levels, F.concat("bids", "asks")).drop("bids", "asks")
