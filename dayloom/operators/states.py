"""Hourly behaviour and behaviour-state features.

Hourly rows are a map-side combined aggregate. A request reads the hours before
its own hour from per-hour arrays (at most one row per calendar hour of the look
back), shared by all requests of that user and hour; only the still running hour
is specific to a request and comes from running totals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.functions.state_model import DEFAULT_STATE_MODEL, StateModel
from dayloom.functions.times import HOUR_US, MINUTE_US, floor_div, from_us
from dayloom.operators.bins import Groups, explode_bins, map_sorted_bins
from dayloom.operators.timeline import activity_union
from dayloom.operators.window_features import KEY, probes, request_keys
from dayloom.vocab import STATE_CATEGORIES, STATE_FEATURES, WINDOW_MINUTES

DAY_HOURS = 24
_US = [f"us_{c}" for c in STATE_CATEGORIES]


def hour_split(events: DataFrame) -> DataFrame:
    """One row per (event, touched hour) with its minutes."""
    pieces = explode_bins(events, "s_us", "e_us", HOUR_US)
    return pieces.select(
        "user_id", F.col("bin").alias("hour_no"), "category", "p_start", "p_end"
    )


def _category_sums(amount: str) -> list[Column]:
    return [
        F.expr(f"sum(CASE WHEN category = '{c}' THEN {amount} ELSE 0 END)").alias(u)
        for c, u in zip(STATE_CATEGORIES, _US)
    ]


def hour_vector(table: DataFrame, keep: list[str]) -> DataFrame:
    """The 18 state features as columns ``_x0`` to ``_x17``, from per-hour exact totals.

    Overlaps count twice here by definition, and ``event_count`` covers every
    category while minutes cover the eleven state categories only. Flat arithmetic,
    so it stays inside generated code.
    """
    shares = [f"_share{i}" for i in range(len(_US))]
    entropy = "0D"
    for s in shares:
        entropy = f"({entropy} - CASE WHEN {s} > 0 THEN {s} * log2({s}) ELSE 0D END)"
    active = " + ".join(f"CASE WHEN {u} > 0 THEN 1 ELSE 0 END" for u in _US)
    values = [
        "least(_total, 60D)", "least(_total, 60D) / 60D", "double(event_count)", f"double({active})", entropy,
        "sin(_angle)", "cos(_angle)", *shares,
    ]
    return (
        table.select(*keep, "hour_no", "event_count", *_US)
        .withColumn("_total", F.expr(f"({' + '.join(_US)}) / {MINUTE_US}D"))
        .withColumns({s: F.expr(f"{u} / {MINUTE_US}D / greatest(_total, 1e-9D)") for s, u in zip(shares, _US)})
        .withColumn("_angle", F.expr(f"pmod(hour_no, 24) * {2 * math.pi!r}D / 24D"))
        .select(*keep, *_US, *[F.expr(v).alias(f"_x{i}") for i, v in enumerate(values)])
    )


def hourly_totals(activity: DataFrame) -> DataFrame:
    """Exact per (user, hour) totals; partial sums are combined before the shuffle."""
    return hour_split(activity).groupBy("user_id", "hour_no").agg(
        *_category_sums("p_end - p_start"), F.count(F.lit(1)).alias("event_count")
    )


def hourly_behavior(window: DataFrame | None, web: DataFrame | None) -> DataFrame:
    """The hourly behaviour table of all users."""
    return behavior_of_totals(hourly_totals(activity_union(window, web)))


def behavior_of_totals(totals: DataFrame) -> DataFrame:
    """D8 from :func:`hourly_totals`, which a store may keep."""
    table = hour_vector(totals, ["user_id", "hour_no"])
    return table.select(
        "user_id", from_us(F.col("hour_no") * HOUR_US).alias("hour"),
        *[F.expr(f"{u} / {MINUTE_US}D").alias(c) for u, c in zip(_US, STATE_CATEGORIES)],
        *[F.col(f"_x{i}").alias(c) for i, c in enumerate(STATE_FEATURES)],
    )


def _with_nearest(table: DataFrame, values: list[str], model: StateModel) -> DataFrame:
    """Add ``best``: struct (d, i) of the nearest centre; the lowest id wins ties.

    Flat arithmetic in two projections, so it stays inside generated code.
    """
    scaled = [
        F.expr(f"(coalesce({v}, 0D) - {float(m)!r}D) / {float(s)!r}D").alias(f"_z{i}")
        for i, (v, m, s) in enumerate(zip(values, model.mean, model.scale))
    ]
    distances = []
    for k, center in enumerate(model.centers):
        terms = [f"(_z{i} - {float(c)!r}D) * (_z{i} - {float(c)!r}D)" for i, c in enumerate(center)]
        distances.append(f"struct(sqrt({' + '.join(terms)}) AS d, {k} AS i)")
    best = F.expr(f"array_min(array({', '.join(distances)}))").alias("best")
    return table.select("*", *scaled).select(*table.columns, best)


def assign_state(table: DataFrame, model: StateModel = DEFAULT_STATE_MODEL) -> DataFrame:
    """Add ``state`` and ``state_distance_min``; missing features count as 0."""
    best = _with_nearest(table, [f"double({f})" for f in model.features], model)
    return best.select(
        *table.columns, F.col("best.i").alias("state"), F.col("best.d").alias("state_distance_min")
    )


def _label_batches(keep: list[str], model: StateModel):
    """:func:`hour_vector` and the nearest centre for batches of totals; active hours only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            spent = [p[u].to_numpy() for u in _US]
            total = sum(spent[1:], spent[0]) / float(MINUTE_US)
            shares = [u / float(MINUTE_US) / np.maximum(total, 1e-9) for u in spent]
            entropy = np.zeros(len(p))
            for s in shares:
                entropy = entropy - np.where(s > 0, s * (np.log(np.where(s > 0, s, 1.0)) / np.log(2.0)), 0.0)
            angle = p["hour_no"].to_numpy() % 24 * (2 * math.pi) / 24.0
            active = sum((u > 0).astype(float) for u in spent)
            least = np.minimum(total, 60.0)
            values = [
                least, least / 60.0, p["event_count"].to_numpy().astype(float), active, entropy,
                np.sin(angle), np.cos(angle), *shares,
            ]
            scaled = [(v - float(m)) / float(s) for v, m, s in zip(values, model.mean, model.scale)]
            far = []
            for center in model.centers:
                terms = [(z - float(c)) * (z - float(c)) for z, c in zip(scaled, center)]
                far.append(np.sqrt(sum(terms[1:], terms[0])))
            best = np.argmin(far, axis=0) if len(p) else np.zeros(0, dtype=int)
            out = {c: p[c] for c in keep}
            out |= {"state": best.astype(np.int32), "state_distance_min": np.min(far, axis=0)}
            yield pd.DataFrame(out)[least > 0]

    return run


def _labelled(totals: DataFrame, keep: list[str], model: StateModel) -> DataFrame:
    """Active hours only, as (keep..., state, state_distance_min).

    The generated code of so many terms is too long for the JVM to compile, so they are
    computed for batches. ``keep`` holds whole numbers beside ``user_id``.
    """
    schema = [f"{c} {'string' if c == 'user_id' else 'bigint'}" for c in keep] + ["state int", "state_distance_min double"]
    columns = dict.fromkeys([*keep, "hour_no", "event_count", *_US])
    return totals.select(*columns).mapInPandas(_label_batches(keep, model), ", ".join(schema))


def _entry(partial: int) -> Column:
    return F.struct(
        F.col("hour_no").alias("h"), F.lit(partial).alias("p"),
        F.col("state").alias("s"), F.col("state_distance_min").alias("d"),
    )


def interval_stats(table: DataFrame, ranges: dict[str, str], n_states: int) -> DataFrame:
    """D9 over arrays of active hours, ordered by (hour, full row before partial).

    ``ranges`` maps an output prefix to its array column, which is dropped.
    """
    rest = [c for c in table.columns if c not in ranges.values()]
    shares = table.select(
        *rest, *ranges.values(),
        *[
            F.expr(
                f"transform(sequence(0, {n_states - 1}), k -> CASE WHEN size({r}) > 0 "
                f"THEN (size({r}) - size(array_remove({r}.s, k))) / size({r}) ELSE 0D END)"
            ).alias(f"share_{p}")
            for p, r in ranges.items()
        ],
        *[F.expr(f"sort_array({r}.d)").alias(f"sorted_{p}") for p, r in ranges.items()],
    )
    out = []
    for p, r in ranges.items():
        out += [
            F.expr(f"double(size({r}))").alias(f"{p}_state_active_hours"),
            F.expr(
                f"coalesce((get(sorted_{p}, int((size({r}) - 1) div 2)) + get(sorted_{p}, int(size({r}) div 2))) / 2D, 0D)"
            ).alias(f"{p}_state_distance_median"),
            F.expr(f"array_max(share_{p})").alias(f"{p}_state_dominant_share"),
            F.expr(
                f"aggregate(share_{p}, 0D, (a, s) -> a - CASE WHEN s > 0 THEN s * log2(s) ELSE 0D END)"
            ).alias(f"{p}_state_entropy"),
            F.expr(
                f"double(size(filter(zip_with(slice({r}, 1, greatest(size({r}) - 1, 0)), "
                f"slice({r}, 2, greatest(size({r}) - 1, 0)), (a, b) -> a.s <> b.s), x -> x)))"
            ).alias(f"{p}_state_transition_count"),
            *[F.expr(f"share_{p}[{k}]").alias(f"{p}_state_share_{k}") for k in range(n_states)],
        ]
    return shares.select(*rest, *out)


def state_columns(n_states: int = DEFAULT_STATE_MODEL.n_states) -> list[str]:
    """Names of the columns :func:`behavior_states` adds."""
    stats = ["active_hours", "distance_median", "dominant_share", "entropy", "transition_count"]
    stats += [f"share_{k}" for k in range(n_states)]
    return [f"{p}_state_{s}" for p in ("current60", "prior24h", "prior7d") for s in stats]


def _running_hour(activity: DataFrame, keys: DataFrame) -> DataFrame:
    """Totals of each request's own, still running hour, cut at the request.

    For points with sign +1 at starts and -1 at ends, the minutes before ``t`` are
    ``t * sum(sign) - sum(sign * pos)``, all relative to the hour and exact.
    """
    split = hour_split(activity)
    origin = F.col("hour_no") * HOUR_US
    point = lambda pos, sign: F.struct(
        (pos - origin).alias("at"), F.lit(sign).alias("sign")
    )
    category = F.array_position(F.array(*[F.lit(c) for c in STATE_CATEGORIES]), F.col("category")) - 1
    points = split.select(
        "user_id", F.col("hour_no").alias("bin"), F.coalesce(category, F.lit(-1)).cast("int").alias("cat"),
        F.inline(F.array(point(F.col("p_start"), 1), point(F.col("p_end"), -1))),
    ).select("user_id", "bin", "at", F.lit(1).alias("kind"), "cat", "sign", F.lit(0).cast("bigint").alias("req_us"))
    asked = probes(keys.filter("req_us IS NOT NULL"), HOUR_US, {"end": 0}).select(
        "user_id", "bin", (F.col("pos") - F.col("bin") * HOUR_US).alias("at"), F.lit(0).alias("kind"),
        F.lit(-1).alias("cat"), F.lit(0).alias("sign"), "req_us",
    )
    return map_sorted_bins(
        points.unionByName(asked), ["at", "kind"], _read_running_hour,
        "user_id string, hour_no bigint, req_us bigint, event_count bigint, " + ", ".join(f"{u} bigint" for u in _US),
    )


def _read_running_hour(p: pd.DataFrame) -> pd.DataFrame:
    """Totals of the hour before each probe, from the points before it."""
    groups = Groups(p)
    at, cat, sign = (p[c].to_numpy() for c in ("at", "cat", "sign"))
    q = np.flatnonzero(p["kind"].to_numpy() == 0)
    out = {"user_id": p["user_id"].to_numpy()[q], "hour_no": p["bin"].to_numpy()[q], "req_us": p["req_us"].to_numpy()[q]}
    out["event_count"] = groups.totals((sign == 1).astype(np.int64), q)[0]
    for i, u in enumerate(_US):
        signed = np.where(cat == i, sign, 0).astype(np.int64)
        out[u] = at[q] * groups.totals(signed, q)[0] - groups.totals(signed * at, q)[0]
    return pd.DataFrame(out)


def _carried_hours(activity: DataFrame, hours: DataFrame, back: int) -> DataFrame:
    """Extra rows for earlier hours from events running across the start of ``hs``.

    Cutting the running hour keeps the original start of such an event, so its
    earlier hours appear a second time, with these events alone.
    """
    first = floor_div(F.col("s_us"), HOUR_US)
    last = floor_div(F.col("e_us") - 1, HOUR_US)
    crossing = (
        activity.filter("e_us > s_us")
        .filter(last > first)
        .withColumn("hs", F.explode(F.sequence(first + 1, last)))
        .join(hours, ["user_id", "hs"], "left_semi")
        .withColumn(
            "hour_no", F.explode(F.sequence(F.greatest(first, F.col("hs") - back), F.col("hs") - 1))
        )
    )
    inside = f"(hour_no + 1) * {HOUR_US} - greatest(s_us, hour_no * {HOUR_US})"
    return crossing.groupBy("user_id", "hs", "hour_no").agg(
        *_category_sums(inside), F.count(F.lit(1)).alias("event_count")
    )


def state_readings(
    activity: DataFrame,
    keys: DataFrame,
    model: StateModel = DEFAULT_STATE_MODEL,
    window_minutes: float = WINDOW_MINUTES,
    totals: DataFrame | None = None,
) -> DataFrame:
    """I4 keyed by (user_id, req_us): three ranges of state features.

    Range starts are floored to the hour and range ends are not. With ``totals`` (those of
    :func:`hourly_totals`), ``activity`` is only read for the running hour of the keys and for
    what runs into it.
    """
    width = int(window_minutes * 60_000_000)
    back = 7 * 24 + math.ceil(window_minutes / 60)
    start = F.col("req_us") - width
    asked = keys.select(
        *KEY,
        floor_div(F.col("req_us"), HOUR_US).alias("hs"),
        floor_div(start, HOUR_US).alias("lo"),
        floor_div(start - 1, HOUR_US).alias("upto"),
    )
    hours = asked.select("user_id", "hs").distinct()

    full = _labelled(hourly_totals(activity) if totals is None else totals, ["user_id", "hour_no"], model)
    # the hours before an hour lie in its day and a few days before: read once a day, not once an hour
    day = lambda hour: floor_div(F.col(hour), DAY_HOURS).alias("day")
    look_back = Window.partitionBy("user_id").orderBy("day").rangeBetween(-math.ceil(back / DAY_HOURS), 0)
    days = (
        full.select("user_id", day("hour_no"), _entry(0).alias("row"))
        .unionByName(hours.select("user_id", day("hs"), F.lit(True).alias("asked")), allowMissingColumns=True)
        .groupBy("user_id", "day")
        .agg(F.sort_array(F.collect_list("row")).alias("day_rows"), F.bool_or("asked").alias("asked"))
        .withColumn("days_rows", F.flatten(F.collect_list("day_rows").over(look_back)))
        .filter("asked")
        .select("user_id", "day", "days_rows")
    )
    carried = (
        _labelled(_carried_hours(activity, hours, back), ["user_id", "hs", "hour_no"], model)
        .groupBy("user_id", "hs")
        .agg(F.collect_list(_entry(1)).alias("carried_rows"))
    )
    none = F.array().cast("array<struct<h:bigint,p:int,s:int,d:double>>")
    seen = F.filter("days_rows", lambda x: (x["h"] < F.col("hs")) & (x["h"] >= F.col("hs") - back))
    before = hours.join(carried, ["user_id", "hs"], "left").withColumn("day", floor_div(F.col("hs"), DAY_HOURS))
    base = before.join(days, ["user_id", "day"]).select(
        "user_id", "hs",
        F.sort_array(F.concat(seen, F.coalesce("carried_rows", none))).alias("rows"),
    )
    running_rows = _labelled(_running_hour(activity, keys), [*KEY, "hour_no"], model).select(
        *KEY, F.array(_entry(1)).alias("now")
    )
    asked = asked.join(running_rows, KEY, "left").withColumn("now", F.coalesce("now", none))

    between = lambda rows, lo, hi: F.expr(f"filter({rows}, x -> x.h >= {lo} AND x.h <= {hi})")
    group = ["user_id", "hs", "lo", "upto"]
    order = state_columns(model.n_states)
    if window_minutes < 60:
        # the running hour can fall into the earlier ranges: nothing is shared
        table = asked.join(base, ["user_id", "hs"]).withColumn("every", F.concat("rows", "now"))
        table = table.select(
            *KEY,
            between("every", "lo", "hs").alias("near"),
            between("every", "lo - 24", "upto").alias("day"),
            between("every", "lo - 168", "upto").alias("week"),
        )
        ranges = {"current60": "near", "prior24h": "day", "prior7d": "week"}
        return interval_stats(table, ranges, model.n_states).select(*KEY, *order)
    shared = asked.select(*group).distinct().join(base, ["user_id", "hs"]).select(
        *group,
        between("rows", "lo", "hs").alias("near"),
        between("rows", "lo - 24", "upto").alias("day"),
        between("rows", "lo - 168", "upto").alias("week"),
    )
    shared = interval_stats(shared, {"prior24h": "day", "prior7d": "week"}, model.n_states)
    table = asked.join(shared, group).withColumn("near", F.concat("near", "now"))
    return interval_stats(table, {"current60": "near"}, model.n_states).select(*KEY, *order)


def behavior_states(
    window: DataFrame | None,
    web: DataFrame | None,
    requests: DataFrame,
    model: StateModel = DEFAULT_STATE_MODEL,
    window_minutes: float = WINDOW_MINUTES,
) -> DataFrame:
    """I4: behaviour-state features of every distinct (user_id, timestamp)."""
    table = state_readings(
        activity_union(window, web), request_keys(requests), model, window_minutes
    )
    return table.select("user_id", from_us("req_us").alias("timestamp"), *state_columns(model.n_states))
