"""Time bins: how a hot user is split over many tasks.

Every per-user computation in the engine is keyed by ``(user_id, bin)``, never
by ``user_id`` alone, so one user holding a third of all rows still spreads over
as many tasks as there are bins of wall-clock time. What has to cross a bin edge
is carried by small per-bin summaries (at most a few rows per user and bin,
whatever the number of events).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayloom.functions.times import MINUTE_US, floor_div


def explode_bins(
    df: DataFrame, start: str, end: str, width_us: int, instants: bool = False
) -> DataFrame:
    """One row per (interval, bin it touches) with the clipped ``p_start``, ``p_end``.

    Intervals without length are dropped, or with ``instants`` belong to the bin they lie in.

    The fan-out is the interval length over the bin width; parsed events are
    shorter than 12 hours, so at most 13 rows with one-hour bins.
    """
    first = floor_div(F.col(start), width_us)
    last = floor_div(F.greatest(F.col(end) - 1, F.col(start)), width_us)
    kept = F.col(end) >= F.col(start) if instants else F.col(end) > F.col(start)
    return (
        df.filter(kept)
        .withColumn("bin", F.explode(F.sequence(first, last)))
        .withColumn("p_start", F.greatest(F.col(start), F.col("bin") * width_us))
        .withColumn("p_end", F.least(F.col(end), (F.col("bin") + 1) * width_us))
    )


def bin_width(bin_minutes: float) -> int:
    """Bin width in microseconds."""
    return int(bin_minutes * MINUTE_US)


def running(keys: list[str], order: list) -> tuple:
    """Windows for the running value and the whole-group value of one partitioning."""
    base = Window.partitionBy(*keys).orderBy(*order)
    return (
        base.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        base.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing),
    )


def carried_prefix(df: DataFrame, key: str, bin_col: str, sums: Iterable[str]) -> DataFrame:
    """Totals of all earlier bins of a user, one row per (user, bin).

    ``df`` must already be one row per (user, bin): its size per user is bounded
    by the calendar, not by the number of events.
    """
    earlier = (
        Window.partitionBy(key).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    )
    return df.select(
        key, bin_col,
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in sums],
    )


def map_sorted_bins(
    df: DataFrame,
    sort: list[str],
    sweep: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Run a sweep over whole (user, bin) groups.

    Spark shuffles by (user, bin) and sorts inside each partition (spilling when
    needed); the sweep sees Arrow batches cut at group edges, so many small
    groups share one call and nothing larger than a batch plus one group is held.
    A group is bounded where its caller cuts crowded bins (:func:`crowded_bins`).
    """
    keys = ["user_id", "bin"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            if held:
                last = held[-1].iloc[-1]
            else:
                last = batch.iloc[0]
            same = (batch["user_id"].to_numpy() == last["user_id"]) & (
                batch["bin"].to_numpy() == last["bin"]
            )
            if same.all():
                held.append(batch)
                continue
            # rows of the group still open at the end of this batch stay behind
            tail = batch.iloc[-1]
            open_rows = (batch["user_id"].to_numpy() == tail["user_id"]) & (
                batch["bin"].to_numpy() == tail["bin"]
            )
            ready = pd.concat([*held, batch[~open_rows]], ignore_index=True)
            held = [batch[open_rows]]
            yield sweep(ready)
        if held:
            yield sweep(pd.concat(held, ignore_index=True))

    return (
        df.repartition(*keys)
        .sortWithinPartitions(*keys, *sort)
        .mapInPandas(run, schema)
    )


class Groups:
    """Where the (user, bin) groups of a sweep's rows begin and end, and running totals inside them."""

    def __init__(self, p: pd.DataFrame):
        user, bins = pd.factorize(p["user_id"].to_numpy())[0], p["bin"].to_numpy()
        head = np.r_[True, (user[1:] != user[:-1]) | (bins[1:] != bins[:-1])]
        starts, number = np.flatnonzero(head), np.cumsum(head) - 1
        self.first, self.last = starts[number], np.r_[starts[1:], len(p)][number] - 1
        self.at = np.arange(len(p))

    def totals(self, value: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of whole numbers: the sum up to each of ``rows`` (itself included) and that of its group."""
        total, first = np.cumsum(value), self.first[rows]
        base = total[first] - value[first]
        return total[rows] - base, total[self.last[rows]] - base

    def latest(self, marked: np.ndarray) -> np.ndarray:
        """The last marked row of the group up to each row; -1 where there is none."""
        found = np.maximum.accumulate(np.where(marked, self.at, -1))
        return np.where(found >= self.first, found, -1)

    def next(self, marked: np.ndarray) -> np.ndarray:
        """The first marked row of the group from each row on; -1 where there is none."""
        found = np.minimum.accumulate(np.where(marked, self.at, len(self.at))[::-1])[::-1]
        return np.where(found <= self.last, found, -1)


#: Stands for a missing request time in a sweep: whole-number columns without nulls stay whole numbers there.
NO_TIME = -(1 << 62)


def crowded_bins(rows: DataFrame, limit: int) -> DataFrame:
    """(user_id, bin, parts) of bins with over ``limit`` rows; at most one for each ``limit`` rows."""
    sizes = rows.groupBy("user_id", "bin").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    return sizes.select("user_id", "bin", F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("parts"))


#: Quantiles that a bin is cut at, at most.
QUANTILES = 1024


def quantile_cuts(rows: DataFrame, crowded: DataFrame, at: list[str]) -> DataFrame:
    """``cuts``: for each crowded bin the sorted instants that share out its rows' edges ``at`` evenly.

    Quantiles come from sketches that are merged, so no task sees a bin's rows together. Any
    instants would be right; these make the parts even, down to a thousandth of the bin.
    """
    share = F.percentile_approx("_at", F.array(*[F.lit(k / QUANTILES) for k in range(1, QUANTILES)]), F.lit(5_000))
    edges = rows.join(F.broadcast(crowded), ["user_id", "bin"]).withColumn("_at", F.explode(F.array(*at)))
    sketched = edges.groupBy("user_id", "bin").agg(F.max("parts").alias("parts"), share.alias("q"))
    step = F.greatest(F.lit(1), F.floor(F.lit(QUANTILES) / (F.col("parts") * len(at))).cast("int"))
    picked = F.filter("q", lambda x, i: F.pmod(i + 1, step) == 0)
    return sketched.select("user_id", "bin", F.array_sort(F.array_distinct(picked)).alias("cuts"))
