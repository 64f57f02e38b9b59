"""Request history: gaps, rolling means, prior requests, self-report history.

Everything a row needs from the same user's past is read in two steps: inside its
own (user, period) group, and from one small summary row per earlier period
(last three rows, or mergeable moments). No window ever spans a whole user's rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.functions.numbers import finite_or_null, finite_or_zero
from dayloom.functions.times import DAY_US, MINUTE_US, floor_div, from_us, to_us
from dayloom.functions.history_columns import HISTORY_COLUMNS, history_name
from dayloom.vocab import (
    CALENDAR_COLUMNS,
    HISTORY_SOURCE,
    ROLLING_COLUMNS,
    TARGETS,
)


def last_k_before(
    table: DataFrame,
    time: str,
    value: Column,
    eligible: Column,
    k: int,
    name: str,
    tie: list[str] | None = None,
    period_us: int = DAY_US,
) -> DataFrame:
    """Add ``name``: the last ``k`` eligible values of the same user before each row.

    Oldest first. Rows are ordered by ``time`` then ``tie``. ``value`` must not be
    NULL when eligible.
    """
    keys, order = ["user_id", "_period"], [time, *(tie or [])]
    rows = table.withColumn("_period", floor_div(F.col(time), period_us)).withColumn(
        "_item", F.when(eligible, F.struct(F.col(time).alias("t"), value.alias("v")))
    )
    spec = "partition by user_id, _period order by " + ", ".join(order)
    rows = rows.withColumn(
        "_recent",
        F.array(*[F.expr(f"lag(_item, {i}) ignore nulls over ({spec})") for i in range(k, 0, -1)]),
    )
    rows = rows.withColumn("_recent", F.filter("_recent", lambda x: x.isNotNull()))
    # per period: its last k items (a bounded array), then carried over later periods
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    summary = (
        rows.filter(F.col("_item").isNotNull())
        .withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") <= k)
        .groupBy(*keys)
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct((-F.col("_rank")).alias("r"), F.col("_item").alias("x")))),
                lambda e: e["x"],
            ).alias("_last")
        )
    )
    earlier = Window.partitionBy("user_id").orderBy("_period").rowsBetween(-k, -1)
    periods = (
        rows.select(*keys).distinct().join(summary, keys, "left")
    )
    # only periods with items count towards k, so look back over those
    seen = Window.partitionBy("user_id").orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    with_items = summary.withColumn("_before", F.flatten(F.collect_list("_last").over(earlier))).withColumn(
        "_upto", F.concat("_before", "_last")
    )
    carried = (
        periods.select(*keys)
        .join(with_items.select(*keys, "_upto"), keys, "left")
        .withColumn("_carry", F.last("_upto", ignorenulls=True).over(seen))
        .select(*keys, "_carry")
    )
    none = F.array().cast(rows.schema["_recent"].dataType)
    merged = F.concat(F.coalesce("_carry", none), F.col("_recent"))
    return (
        rows.join(carried, keys, "left")
        .withColumn(name, F.slice(F.reverse(merged), 1, k))
        .withColumn(name, F.reverse(F.col(name)))
        .drop("_period", "_item", "_recent", "_carry")
    )


# --- E4-E6: request gap and rolling means --------------------------------------

def rolling_from(previous: Column, columns: list[str], now_us: Column) -> list[Column]:
    """E4-E6 given the previous rows as an array of (t, v{columns}), oldest first."""
    gap = (now_us - F.element_at(previous, -1)["t"]) / float(MINUTE_US)
    out = [
        F.when(F.size(previous) > 0, gap).otherwise(0.0).alias("minutes_since_prev1_window")
    ]
    means, minus = [], []
    for c in columns:
        field = lambda c: (lambda x: x["v"][c])
        past = F.filter(F.transform(previous, field(c)), lambda v: v.isNotNull())
        total = F.aggregate(past, F.lit(0.0), lambda a, v: a + v)
        mean = F.when(F.size(past) > 0, total / F.size(past)).otherwise(0.0)
        means.append(mean.alias(f"rolling_mean_3_{c}"))
        minus.append((finite_or_zero(F.col(c)) - mean).alias(f"current_minus_rolling_mean_3_{c}"))
    return out + means + minus


def rolling_values(columns: list[str]) -> Column:
    """The values later rows may average: missing and infinite ones are skipped."""
    return F.struct(
        *[F.when(F.abs(finite_or_null(F.col(c).cast("double"))) != float("inf"), F.col(c).cast("double")).alias(c) for c in columns]
    )


def rolling_history(
    table: DataFrame, columns: list[str] | None = None, tie: list[str] | None = None
) -> DataFrame:
    """Minutes since the previous row and mean of the three previous rows."""
    names = [c for c in (columns or ROLLING_COLUMNS) if c in table.columns]
    rows = last_k_before(
        table.withColumn("_us", to_us("timestamp")), "_us", rolling_values(names),
        F.lit(True), 3, "_prev", tie,
    )
    return rows.select(*table.columns, *rolling_from(F.col("_prev"), names, F.col("_us")))


# --- C9 / F2: the last three prior request times --------------------------------

def prior_requests(requests: DataFrame, prior: DataFrame, k: int = 3) -> DataFrame:
    """For each request the last ``k`` distinct prior times strictly before it.

    ``requests`` and ``prior`` are (user_id, timestamp); the result adds
    ``prior_times``, oldest first.
    """
    asked = requests.select("user_id", "timestamp").distinct().withColumn("_is_prior", F.lit(False))
    seen = prior.select("user_id", "timestamp").distinct().withColumn("_is_prior", F.lit(True))
    rows = asked.unionByName(seen).groupBy("user_id", "timestamp").agg(
        F.bool_or("_is_prior").alias("_is_prior"), F.bool_or(~F.col("_is_prior")).alias("_asked")
    ).withColumn("_us", to_us("timestamp"))
    out = last_k_before(rows, "_us", F.lit(1), F.col("_is_prior"), k, "_prev")
    return out.filter("_asked").select(
        "user_id", "timestamp",
        F.transform("_prev", lambda x: from_us(x["t"])).alias("prior_times"),
    )


# --- E7 / E8: causal self-report history ----------------------------------------

def calendar_cycle(ts: str = "timestamp") -> list[Column]:
    """Sine and cosine of hour of day and of weekday (Monday is 0)."""
    hour = F.hour(F.col(ts).cast("timestamp")) * (2 * math.pi) / 24.0
    day = F.weekday(ts) * (2 * math.pi) / 7.0
    values = [F.sin(hour), F.cos(hour), F.sin(day), F.cos(day)]
    return [v.alias(n) for v, n in zip(values, CALENDAR_COLUMNS)]


def duplicate_reports(table: DataFrame) -> DataFrame:
    """(user_id, timestamp) pairs that occur more than once; history needs them unique."""
    return table.groupBy("user_id", "timestamp").count().filter("count > 1").drop("count")


def self_report_history(
    table: DataFrame,
    source_column: str = "answer_source",
    history_source: str = HISTORY_SOURCE,
    period_us: int = DAY_US,
    targets: list[str] | None = None,
) -> DataFrame:
    """E7 + E8: statistics over earlier reports only, per target.

    Rows of other sources get features but never feed them. All targets go side by side through
    one sort by (user, period); earlier periods arrive as one summary row each. Moments are shifted sums that merge over periods, so a constant history has
    a deviation of exactly zero.
    (user_id, timestamp) must be unique, see :func:`duplicate_reports`.
    """
    names = targets or TARGETS
    each = range(len(names))
    fed = f"{source_column} <=> '{history_source}'"
    rows = table.withColumn("_us", to_us("timestamp")).withColumns(
        {
            "_period": floor_div(F.col("_us"), period_us),
            **{f"_v{i}": F.expr(f"CASE WHEN {fed} AND NOT isnan(double({t})) THEN double({t}) END") for i, t in enumerate(names)},
        }
    )
    group = "PARTITION BY user_id, _period ORDER BY _us"
    past = f"OVER ({group} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    every = f"OVER ({group} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    # squared sums are taken around the first value of the period, so they stay small
    rows = rows.select(
        "*", *[F.expr(f"first(_v{i}) IGNORE NULLS {every}").alias(f"_k{i}") for i in each],
        *[F.expr(f"CASE WHEN _v{i} IS NOT NULL THEN struct(_us AS t, _v{i} AS v) END").alias(f"_item{i}") for i in each],
    )
    # how many values of the period follow a row: the last three have fewer than three
    upto = f"OVER ({group} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    left = [F.expr(f"count(_v{i}) {every} - count(_v{i}) {upto}").alias(f"_left{i}") for i in each]
    read = rows.select(
        "*",
        *[F.expr(f"count(_v{i}) {past}").alias(f"_n{i}") for i in each],
        *[F.expr(f"coalesce(sum(_v{i} - _k{i}) {past}, 0D)").alias(f"_s{i}") for i in each],
        *[F.expr(f"coalesce(sum((_v{i} - _k{i}) * (_v{i} - _k{i})) {past}, 0D)").alias(f"_q{i}") for i in each],
        *[
            F.expr(
                "filter(array(" + ", ".join(f"lag(_item{i}, {b}) IGNORE NULLS OVER ({group})" for b in (3, 2, 1))
                + "), x -> x IS NOT NULL)"
            ).alias(f"_recent{i}")
            for i in each
        ],
    )
    periods = rows.select("*", *left).groupBy("user_id", "_period").agg(
        *[F.first(f"_k{i}").alias(f"k{i}") for i in each],
        *[F.count(f"_v{i}").alias(f"n{i}") for i in each],
        *[F.expr(f"coalesce(sum(_v{i} - _k{i}), 0D)").alias(f"s{i}") for i in each],
        *[F.expr(f"coalesce(sum((_v{i} - _k{i}) * (_v{i} - _k{i})), 0D)").alias(f"q{i}") for i in each],
        *[F.expr(f"sort_array(collect_list(CASE WHEN _left{i} < 3 THEN _item{i} END))").alias(f"last{i}") for i in each],
    )

    by_user = "PARTITION BY user_id ORDER BY _period"
    whole = f"OVER ({by_user} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    earlier = f"OVER ({by_user} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    # sums around k, moved to the first value of the user, g
    shift = lambda k, g: f"coalesce({k} - {g}, 0D)"
    moved_s = lambda s, n, d: f"({s} + {n} * {d})"
    moved_q = lambda q, s, n, d: f"({q} + 2D * {d} * {s} + {n} * {d} * {d})"
    before = lambda i: "concat(" + ", ".join(
        f"coalesce(lag(has{i}, {b}) IGNORE NULLS OVER ({by_user}), array())" for b in (3, 2, 1)
    ) + ")"
    carried = periods.select(
        "*", *[F.expr(f"first(k{i}) IGNORE NULLS {whole}").alias(f"g{i}") for i in each],
        *[F.expr(f"CASE WHEN size(last{i}) > 0 THEN last{i} END").alias(f"has{i}") for i in each],
    ).select(
        "user_id", "_period", *[f"g{i}" for i in each], *[f"has{i}" for i in each], *[f"n{i}" for i in each],
        *[F.expr(moved_s(f"s{i}", f"n{i}", shift(f"k{i}", f"g{i}"))).alias(f"s{i}") for i in each],
        *[F.expr(moved_q(f"q{i}", f"s{i}", f"n{i}", shift(f"k{i}", f"g{i}"))).alias(f"q{i}") for i in each],
    ).select(
        "user_id", "_period", *[F.col(f"g{i}").alias(f"_g{i}") for i in each],
        *[
            F.expr(f"coalesce(sum({m}{i}) {earlier}, {z})").alias(f"_c{m}{i}")
            for i in each for m, z in (("n", "0L"), ("s", "0D"), ("q", "0D"))
        ],
        *[F.expr(before(i)).alias(f"_before{i}") for i in each],
    )
    d = [shift(f"_k{i}", f"_g{i}") for i in each]
    full = read.join(carried, ["user_id", "_period"], "left").select(
        *[F.col(f"`{c}`") for c in table.columns], "_us",
        *[F.col(f"_g{i}").alias(f"g{i}_") for i in each],
        *[F.expr(f"_n{i} + _cn{i}").alias(f"n{i}_") for i in each],
        *[F.expr(f"{moved_s(f'_s{i}', f'_n{i}', d[i])} + _cs{i}").alias(f"s{i}_") for i in each],
        *[F.expr(f"{moved_q(f'_q{i}', f'_s{i}', f'_n{i}', d[i])} + _cq{i}").alias(f"q{i}_") for i in each],
        *[F.expr(f"slice(reverse(concat(_before{i}, _recent{i})), 1, 3)").alias(f"recent{i}_") for i in each],
    )
    out = []
    for i, target in enumerate(names):
        n, s, q, recent = f"n{i}_", f"s{i}_", f"q{i}_", f"recent{i}_"
        newest, mean, c = f"get({recent}, 0)", f"g{i}_ + {s} / nullif({n}, 0)", f"nullif({n}, 0)"
        stats = {
            "last": f"{newest}.v",
            "mean": mean,
            "mean_3": f"aggregate(reverse({recent}), 0D, (a, x) -> a + x.v) / nullif(size({recent}), 0)",
            "std": f"CASE WHEN {n} > 1 THEN sqrt(greatest(({q} - {s} * {s} / {c}) / {c}, 0D)) ELSE 0D END",
            "log_count": f"log1p(double({n}))",
            "log_gap_hours": f"CASE WHEN {n} > 0 THEN log1p(greatest((_us - {newest}.t) / {60.0 * MINUTE_US!r}D, 0D)) END",
            "last_minus_mean": f"{newest}.v - ({mean})",
        }
        out += [F.expr(e).alias(history_name(target, stat)) for stat, e in stats.items()]
    return full.select(*[F.col(f"`{c}`") for c in table.columns], *out, *calendar_cycle())


def history_only(history: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """Keys and history columns in contract order."""
    return history.select("user_id", "timestamp", *HISTORY_COLUMNS)
