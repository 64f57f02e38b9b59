"""Overlap resolution: one non-overlapping timeline per user.

At any instant the winner among active events depends only on those events
(priority, then latest original start, then input order), never on a request.
So the timeline is resolved once for all requests and clipped later.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.functions.times import from_us, to_us
from dayloom.operators.bins import bin_width, crowded_bins, explode_bins, map_sorted_bins, quantile_cuts
from dayloom.vocab import SOURCE_PRIORITY, WINDOW_MINUTES

#: Rows of a (user, bin) that one sweep takes; bins with more are cut at quantiles of their rows.
CROWDED = 50_000

_SLICE_SCHEMA = (
    "user_id string, bin bigint, start_us bigint, end_us bigint, "
    "ts_us bigint, priority int, category string"
)


def priority_of(source_type: Column) -> Column:
    """afk beats web, web beats everything else."""
    rank = F.lit(0)
    for name, value in SOURCE_PRIORITY.items():
        rank = F.when(source_type == name, F.lit(value)).otherwise(rank)
    return rank


def activity_union(window: DataFrame | None, web: DataFrame | None) -> DataFrame:
    """G1: window and web events as one interval table in microseconds."""
    parts = []
    for name, table in (("window", window), ("web", web)):
        if table is None:
            continue
        source = F.col("source_type") if "source_type" in table.columns else F.lit(name)
        seq = F.col("seq").cast("bigint") if "seq" in table.columns else F.lit(0).cast("bigint")
        parts.append(
            table.select(
                F.col("user_id").cast("string").alias("user_id"),
                to_us("timestamp").alias("s_us"),
                to_us("event_end").alias("e_us"),
                priority_of(source).alias("priority"),
                seq.alias("seq"),
                F.col("category").cast("string").alias("category"),
            )
        )
    if not parts:
        raise ValueError("window or web events are required")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _sweep(merge: str):
    """Give each elementary slice of a bin to its strongest event; linear in events and slices."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        n = len(p)
        user, bins = p["user_id"].to_numpy(), p["bin"].to_numpy()
        group = np.zeros(n, dtype=np.int64)
        group[1:] = np.cumsum((user[1:] != user[:-1]) | (bins[1:] != bins[:-1]))
        lo, hi = p["p_start"].to_numpy(), p["p_end"].to_numpy()
        origin = np.minimum.reduceat(lo, np.flatnonzero(np.r_[True, np.diff(group) > 0]))
        span = int((hi - origin[group]).max()) + 1
        key_lo = group * span + (lo - origin[group])
        key_hi = group * span + (hi - origin[group])
        edges = np.unique(np.concatenate([key_lo, key_hi]))
        first, last = np.searchsorted(edges, key_lo), np.searchsorted(edges, key_hi)
        winner = np.full(len(edges), -1, dtype=np.int64)
        code = pd.factorize(p["category"].to_numpy(), sort=True)[0]
        rank = np.lexsort(
            (-code, -p["seq"].to_numpy(), p["s_us"].to_numpy(), p["priority"].to_numpy())
        )
        # strongest first: a slice is written once, `free` leads past those already taken
        free = list(range(len(edges) + 1))
        for i, a, b in zip(rank[::-1].tolist(), first[rank[::-1]].tolist(), last[rank[::-1]].tolist()):
            while True:
                while free[a] != a:
                    free[a] = free[free[a]]
                    a = free[a]
                if a >= b:
                    break
                winner[a] = i
                free[a] = a + 1
        cells = np.flatnonzero(winner >= 0)
        won = winner[cells]
        if merge == "category":
            same = code[won[1:]] == code[won[:-1]]
        else:
            same = won[1:] == won[:-1]
        # a run ends where the winner changes, where nothing is active, or at a bin edge
        joined = same & (np.diff(cells) == 1) & (group[won[1:]] == group[won[:-1]])
        heads = np.flatnonzero(np.r_[True, ~joined])
        tails = np.r_[heads[1:] - 1, len(cells) - 1]
        g = group[won[heads]]
        base = origin[g] - g * span
        row = won[heads]
        return pd.DataFrame(
            {
                "user_id": user[row],
                "bin": bins[row],
                "start_us": edges[cells[heads]] + base,
                "end_us": edges[cells[tails] + 1] + base,
                "ts_us": p["s_us"].to_numpy()[row],
                "priority": p["priority"].to_numpy()[row].astype(np.int32),
                "category": p["category"].to_numpy()[row],
                **({"seq": p["seq"].to_numpy()[row], "part": p["part"].to_numpy()[row]} if "part" in p else {}),
            }
        )

    return run


def resolve_bins(
    activity: DataFrame,
    width_us: int,
    merge: str = "winner",
    collapse_copies: bool = True,
    crowded: int = CROWDED,
) -> DataFrame:
    """E1 inside bins: (user, bin) runs of one winner (or of one category).

    Copies of an event collapse in a map-side combined aggregate before the sweep,
    so a group of copies never travels to one task as rows. Bins with over ``crowded``
    rows are cut into parts, each swept by itself; whether there are any is counted first,
    one combined aggregate over three columns, so that ordinary data pays for no more.
    """
    dense = crowded_bins(explode_bins(activity.select("user_id", "s_us", "e_us"), "s_us", "e_us", width_us), crowded)
    pieces = explode_bins(activity, "s_us", "e_us", width_us)
    keys = ["user_id", "bin", "p_start", "p_end", "s_us", "priority", "category"]
    if collapse_copies:
        pieces = pieces.groupBy(*keys).agg(F.min("seq").alias("seq"))
    pieces = pieces.select(*keys, "seq")
    if dense.isEmpty():
        return map_sorted_bins(pieces, [], _sweep(merge), _SLICE_SCHEMA)
    plain = pieces.join(F.broadcast(dense), ["user_id", "bin"], "left_anti")
    runs = map_sorted_bins(plain, [], _sweep(merge), _SLICE_SCHEMA)
    parts = _parts(pieces, quantile_cuts(pieces, dense, ["p_start", "p_end"]))
    # a part takes the place of a bin in the sweep
    swept = map_sorted_bins(
        parts.withColumn("bin", F.struct("bin", "part").cast("string")), [], _sweep(merge), _PART_SCHEMA
    )
    return runs.unionByName(_stitched(swept, merge))


_PART_SCHEMA = _SLICE_SCHEMA.replace("bin bigint", "bin string") + ", seq bigint, part int"


def _parts(pieces: DataFrame, cuts: DataFrame) -> DataFrame:
    """Pieces of crowded bins by the part between two cuts.

    A piece has rows in the parts where it begins and ends. Of the pieces that cover a part from end
    to end only the strongest can win there: it is found by a combined aggregate, so a part holds its
    own edges and one row for all that runs through it.
    """
    placed = pieces.join(F.broadcast(cuts), ["user_id", "bin"]).withColumns({
        "first": F.size(F.filter("cuts", lambda c: c <= F.col("p_start"))),
        "last": F.size(F.filter("cuts", lambda c: c < F.col("p_end"))),
    })
    begin = lambda k: F.greatest(F.col("p_start"), F.coalesce(F.get("cuts", k - 1), F.col("p_start")))
    end = lambda k: F.least(F.col("p_end"), F.coalesce(F.get("cuts", k), F.col("p_end")))
    edges = placed.withColumn("part", F.explode(F.array_distinct(F.array("first", "last"))))
    columns = ["user_id", "bin", "part", "p_start", "p_end", "s_us", "priority", "category", "seq"]
    edges = edges.withColumns({"p_start": begin(F.col("part")), "p_end": end(F.col("part"))}).select(columns)
    strength = F.struct((-F.col("priority")).alias("p"), (-F.col("s_us")).alias("s"), "seq", "category")
    through = (
        placed.filter("last > first + 1")
        .withColumn("part", F.explode(F.sequence(F.col("first") + 1, F.col("last") - 1)))
        .groupBy("user_id", "bin", "part", "cuts").agg(F.min(strength).alias("top"))
        .select(
            "user_id", "bin", "part", F.get("cuts", F.col("part") - 1).alias("p_start"), F.get("cuts", F.col("part")).alias("p_end"),
            (-F.col("top.s")).alias("s_us"), (-F.col("top.p")).alias("priority"), F.col("top.category").alias("category"), F.col("top.seq").alias("seq"),
        )
    )
    return edges.unionByName(through).filter("p_end > p_start")


def _stitched(swept: DataFrame, merge: str) -> DataFrame:
    """Runs of parts as runs of their bin: those that a cut parted become one again.

    Only the first and the last run of a part can be parted, so what is windowed for each bin is
    bounded by the number of its parts.
    """
    swept = swept.withColumn("bin", F.regexp_extract("bin", r"^\{(-?[0-9]+),", 1).cast("bigint"))
    part = Window.partitionBy("user_id", "bin", "part")
    edged = swept.withColumns({"lo": F.min("start_us").over(part), "hi": F.max("end_us").over(part)})
    edged = edged.withColumn("edge", (F.col("start_us") == F.col("lo")) | (F.col("end_us") == F.col("hi")))
    order = Window.partitionBy("user_id", "bin").orderBy("start_us")
    alike = ["category"] if merge == "category" else ["ts_us", "priority", "category", "seq"]
    joined = F.lag("end_us").over(order) == F.col("start_us")
    joined &= F.lag("part").over(order) != F.col("part")
    for c in alike:
        joined &= F.lag(c).over(order) == F.col(c)
    islands = (
        edged.filter("edge").withColumn("fresh", F.coalesce(~joined, F.lit(True)).cast("int"))
        .withColumn("island", F.sum("fresh").over(order))
        .groupBy("user_id", "bin", "island").agg(
            F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
            *[F.min_by(c, "start_us").alias(c) for c in ("ts_us", "priority", "category")],
        )
    )
    columns = [f.split()[0] for f in _SLICE_SCHEMA.split(", ")]
    return edged.filter("NOT edge").select(columns).unionByName(islands.select(columns))


def resolve_overlaps(
    window: DataFrame | None,
    web: DataFrame | None,
    bin_minutes: float = WINDOW_MINUTES,
) -> DataFrame:
    """The winning event of every instant, as runs cut at bin edges."""
    slices = resolve_bins(activity_union(window, web), bin_width(bin_minutes))
    return slices.select(
        "user_id", "bin",
        from_us("start_us").alias("start"),
        from_us("end_us").alias("end"),
        from_us("ts_us").alias("timestamp"),
        "category", "priority",
    )


def merge_in_bins(slices: DataFrame) -> DataFrame:
    """E2 inside one bin: touching slices of the same category become one row."""
    order = Window.partitionBy("user_id", "bin").orderBy("start_us")
    fresh = ~(
        (F.lag("end_us").over(order) == F.col("start_us"))
        & (F.lag("category").over(order) == F.col("category"))
    )
    return (
        slices.withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int"))
        .withColumn("island", F.sum("fresh").over(order))
        .groupBy("user_id", "bin", "island")
        .agg(
            F.min("start_us").alias("start_us"),
            F.max("end_us").alias("end_us"),
            F.first("category").alias("category"),
        )
        .drop("island")
    )


def merge_segments(slices: DataFrame, width_us: int) -> DataFrame:
    """Same-category islands over the whole timeline, across bin edges.

    Only islands touching a bin edge (at most two per user and bin) go through the
    per-user window; all others are final inside their bin.
    """
    islands = merge_in_bins(slices).withColumn(
        "edge",
        (F.col("start_us") == F.col("bin") * width_us)
        | (F.col("end_us") == (F.col("bin") + 1) * width_us),
    )
    columns = ["user_id", "start_us", "end_us", "category"]
    order = Window.partitionBy("user_id").orderBy("start_us")
    fresh = ~(
        (F.lag("end_us").over(order) == F.col("start_us"))
        & (F.lag("category").over(order) == F.col("category"))
    )
    stitched = (
        islands.filter("edge")
        .withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int"))
        .withColumn("island", F.sum("fresh").over(order))
        .groupBy("user_id", "island")
        .agg(
            F.min("start_us").alias("start_us"),
            F.max("end_us").alias("end_us"),
            F.first("category").alias("category"),
        )
    )
    return islands.filter("NOT edge").select(columns).unionByName(stitched.select(columns))


def segments(
    window: DataFrame | None,
    web: DataFrame | None,
    bin_minutes: float = WINDOW_MINUTES,
) -> DataFrame:
    """E1 + E2: the category islands of every user's resolved timeline."""
    width = bin_width(bin_minutes)
    islands = merge_segments(resolve_bins(activity_union(window, web), width), width)
    return islands.select(
        "user_id", from_us("start_us").alias("start"), from_us("end_us").alias("end"), "category"
    )
