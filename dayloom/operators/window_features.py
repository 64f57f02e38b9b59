"""Look-back features of every request: activity, focus, switching, input, context.

No request is ever joined with its events. Requests become *probe* points that
are sorted together with the interval points of their (user, bin); every feature
is a running total read at a probe, or a difference of two readings. With bins as
wide as the window, ``[t - w, t)`` is a suffix of one bin and a prefix of the next.
The cost is linear in events + requests, also when one user has most of both.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.functions.numbers import divide_or_zero
from dayloom.functions.times import DAY_US, MINUTE_US, SECOND_US, floor_div, from_us, to_us
from dayloom.operators.bins import (
    NO_TIME,
    Groups,
    bin_width,
    carried_prefix,
    explode_bins,
    map_sorted_bins,
    running,
)
from dayloom.session import written_once
from dayloom.operators.timeline import activity_union, resolve_bins
from dayloom.vocab import (
    CATEGORIES,
    CONTEXT_CATEGORIES,
    CONTEXT_DAYS,
    TIME_COLUMNS,
    WINDOW_MINUTES,
)

KEY = ["user_id", "req_us"]
SHORT_US = 2 * MINUTE_US


def request_keys(requests: DataFrame) -> DataFrame:
    """Distinct request instants in microseconds."""
    return requests.select(
        F.col("user_id").cast("string").alias("user_id"), to_us("timestamp").alias("req_us")
    ).distinct()


def probes(keys: DataFrame, width_us: int, roles: dict[str | int, int]) -> DataFrame:
    """Fan each request out to one probe point per role (offset back from the request)."""
    points = F.array(
        *[F.struct(F.lit(r).alias("role"), F.lit(o).cast("bigint").alias("back")) for r, o in roles.items()]
    )
    return (
        keys.select("user_id", "req_us", F.inline(points))
        .withColumn("pos", F.col("req_us") - F.col("back"))
        .withColumn("bin", floor_div(F.col("pos"), width_us))
        .drop("back")
    )


# --- activity minutes, focus blocks, context ---------------------------------

_TOTALS = sorted({c for cats in CONTEXT_CATEGORIES.values() for c in cats})
_CONTEXT_SUMS = [f"ctx{n}_{c}" for n, cats in CONTEXT_CATEGORIES.items() for c in (*cats, "any")]
_SUMS = [*CATEGORIES, "blocks", "shorts"]
_CARRIED = ["left_us", "left_cat", "right_us", "right_cat"]
#: Probes of a request in a sweep: its end, the begin of its window, and the ends of earlier ranges.
END, START = 0, 1
NO_CATEGORY, ELSEWHERE = -1, -(1 << 63)


def _category_code(category: str) -> Column:
    """A category as a whole number: its place in the list, -1 for none, a hash for any other name."""
    known = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col(category)) - 1
    return (
        F.when(F.col(category).isNull(), F.lit(NO_CATEGORY))
        .when(F.col(category).isin(CATEGORIES), known)
        .otherwise(F.xxhash64(category).bitwiseOR(F.lit(1 << 62)))
    )


def _segment_sweep(width_us: int, context: bool):
    """What each probe reads of the segments of its bin; see :func:`segment_readings`.

    Rows of a bin come in the order of ``pos`` and ``kind``: the totals of earlier bins (-1), probes
    (0) before segments (1).
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        groups = Groups(p)
        pos, kind, end, cat = (p[c].to_numpy() for c in ("pos", "kind", "seg_end", "cat"))
        seg, q = kind == 1, np.flatnonzero(kind == 0)
        length = np.where(seg, end - pos, 0)
        latest = groups.latest(seg)
        cur, tail, head = latest[q], latest[groups.last[q]], groups.next(seg)[groups.first[q]]
        at, role, edge = pos[q], p["role"].to_numpy()[q], (p["bin"].to_numpy()[q] + 1) * width_us
        is_end, is_start = role == END, role == START
        # what the latest segment has after the probe
        after = np.where(cur >= 0, np.maximum(end[cur] - at, 0), 0)
        cut = after > 0
        here = np.where(cur >= 0, cat[cur], NO_CATEGORY)
        by_role = lambda at_end, at_start: np.where(is_end, at_end, np.where(is_start, at_start, 0))
        out = {"user_id": p["user_id"].to_numpy()[q], "req_us": p["req_us"].to_numpy()[q], "role": role}
        upto, every = {}, np.zeros(len(q), dtype=np.int64)
        for i, c in enumerate(CATEGORIES):
            total, whole = groups.totals(np.where(cat == i, length, 0), q)
            every = every + total
            upto[c] = total - np.where(here == i, after, 0)
            out[c] = by_role(upto[c], whole - upto[c])
        upto["any"] = every - after
        total, whole = groups.totals(seg.astype(np.int64), q)
        out["blocks"] = by_role(total, whole - total + cut)
        total, whole = groups.totals((seg & (length < SHORT_US)).astype(np.int64), q)
        full, done, left = (cut & (x < SHORT_US) for x in (length[cur], at - pos[cur], end[cur] - at))
        # a cut segment counts with its clipped length
        out["shorts"] = by_role(total - full + done, whole - total + left)
        # the block that may continue over the bin edge, seen from either side
        runs_out = is_start & (tail >= 0) & (end[tail] == edge)
        runs_in = is_end & (head >= 0) & (pos[head] == edge - width_us) & (edge - width_us < at)
        out["left_us"] = np.where(runs_out, edge - np.maximum(pos[tail], at), 0)
        out["left_cat"] = np.where(runs_out, cat[tail], ELSEWHERE)
        out["right_us"] = np.where(runs_in, np.minimum(end[head], at) - (edge - width_us), 0)
        out["right_cat"] = np.where(runs_in, cat[head], ELSEWHERE)
        if context:
            first = groups.first[q]
            total = {c: np.where(kind[first] == -1, p[f"before_{c}"].to_numpy()[first], 0) + upto[c] for c in (*_TOTALS, "any")}
            for i, (name, cats) in enumerate(CONTEXT_CATEGORIES.items()):
                sign = np.where(is_start, 1, np.where(role == START + 1 + i, -1, 0))
                out |= {f"ctx{name}_{c}": sign * total[c] for c in (*cats, "any")}
        return pd.DataFrame(out)

    return run


def segment_readings(
    segments: DataFrame, keys: DataFrame, width_us: int, context: bool
) -> DataFrame:
    """One row per request with exact microsecond totals and focus-block counts.

    ``segments``: resolved in-bin category runs (user_id, bin, start_us, end_us, category).
    ``keys`` may have a boolean ``looks_back``: context is then read for the marked keys alone and
    is zero for the others.
    """
    roles = {END: 0, START: width_us}
    far = {START + 1 + i: width_us + CONTEXT_DAYS[n] * DAY_US for i, n in enumerate(CONTEXT_CATEGORIES)}
    marked = "looks_back" in keys.columns
    keys = keys.withColumn("req_us", F.coalesce("req_us", F.lit(NO_TIME)))
    asked = probes(keys, width_us, roles)
    if context:
        asked = asked.unionByName(probes(keys.filter("looks_back") if marked else keys, width_us, far))
    zero = F.lit(0).cast("bigint")
    before = [f"before_{c}" for c in (*_TOTALS, "any")] if context else []
    none = {c: zero for c in before}
    rows = segments.select(
        "user_id", "bin", F.col("start_us").alias("pos"), F.lit(1).alias("kind"), F.lit(-1).alias("role"),
        zero.alias("req_us"), F.col("end_us").alias("seg_end"), _category_code("category").alias("cat"),
    ).withColumns(none).unionByName(
        asked.select("user_id", "bin", "pos", F.lit(0).alias("kind"), "role", "req_us", zero.alias("seg_end"), zero.alias("cat")).withColumns(none)
    )
    if context:
        amount = {c: f"CASE WHEN category = '{c}' THEN len ELSE 0L END" for c in _TOTALS}
        amount["any"] = "coalesce(len, 0L)"
        per_bin = (
            segments.select("user_id", "bin", "category", F.expr("end_us - start_us").alias("len"))
            .unionByName(asked.filter(F.col("role") != END).select("user_id", "bin").distinct(), allowMissingColumns=True)
            .groupBy("user_id", "bin")
            .agg(*[F.expr(f"sum({e})").alias(c) for c, e in amount.items()])
        )
        rows = rows.unionByName(
            carried_prefix(per_bin, "user_id", "bin", list(amount)).select(
                "user_id", "bin", (F.col("bin") * width_us).alias("pos"), F.lit(-1).alias("kind"), F.lit(-1).alias("role"),
                zero.alias("req_us"), zero.alias("seg_end"), zero.alias("cat"), *before,
            )
        )
    sums = [*_SUMS, *(_CONTEXT_SUMS if context else [])]
    read = map_sorted_bins(
        rows, ["pos", "kind"], _segment_sweep(width_us, context),
        "user_id string, req_us bigint, role int, " + ", ".join(f"{c} bigint" for c in (*_SUMS, *_CARRIED, *sums[len(_SUMS):])),
    )
    merged = read.groupBy(*KEY).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in _CARRIED],
        (F.max("role") > START).alias("looked_back"),
    ).withColumn("joined", F.expr(f"left_us > 0 AND right_us > 0 AND left_cat = right_cat AND left_cat <> {NO_CATEGORY}"))
    one = lambda condition: f"CASE WHEN {condition} THEN 1L ELSE 0L END"
    short = lambda e: one(f"{e} < {SHORT_US}")
    return merged.select(
        "user_id", F.nullif("req_us", F.lit(NO_TIME)).alias("req_us"), *CATEGORIES,
        # rows without a user have no earlier bins
        *[F.expr(f"CASE WHEN looked_back AND user_id IS NOT NULL THEN {c} ELSE 0L END").alias(c) for c in sums[len(_SUMS):]],
        F.expr(f"blocks - {one('joined')}").alias("blocks"),
        F.expr(
            f"shorts + CASE WHEN joined THEN {short('left_us + right_us')} - {short('left_us')}"
            f" - {short('right_us')} ELSE 0L END"
        ).alias("shorts"),
        F.expr(" + ".join(CATEGORIES)).alias("active_us"),
    )


def _ratio(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} > 0 THEN {top} / {bottom} ELSE 0D END"


def activity_columns(window_minutes: float) -> list[Column]:
    """D1-D4 as expressions over :func:`segment_readings`."""
    total = f"least(active_us / {MINUTE_US}D, {float(window_minutes)!r}D)"
    values = {"total_active_minutes": total}
    values |= {t: f"{c} / {MINUTE_US}D" for c, t in zip(CATEGORIES, TIME_COLUMNS)}
    values["ratio_communication"] = _ratio(f"(communication / {MINUTE_US}D)", total)
    values["mean_focus_block_minutes"] = _ratio(f"(active_us / {MINUTE_US}D)", "blocks")
    values["short_fragment_count_2m"] = "double(shorts)"
    return [F.expr(e).alias(n) for n, e in values.items()]


def context_columns() -> list[Column]:
    """D6 as expressions over :func:`segment_readings` with context."""
    out = []
    for name, cats in CONTEXT_CATEGORIES.items():
        total = f"least(ctx{name}_any / {MINUTE_US}D, {float(CONTEXT_DAYS[name] * 24 * 60)!r}D)"
        out += [
            F.expr(_ratio(f"(ctx{name}_{c} / {MINUTE_US}D)", total)).alias(f"context_{name}_ratio_{c}")
            for c in cats
        ]
    return out


# --- app switches -------------------------------------------------------------

def _active_app_steps(p: pd.DataFrame) -> pd.DataFrame:
    """Per bin: how often adjacent apps differ in the start-ordered list of active
    events, and the last app of that list, after each start or end."""
    out_user, out_bin, out_pos, out_kind, out_seq, out_changes, out_app = ([] for _ in range(7))
    columns = [p[c].tolist() for c in ("user_id", "bin", "s_us", "p_start", "p_end", "app")]
    user, bins, start, p_start, p_end, app = columns
    n = len(user)
    i = 0
    while i < n:
        j = i
        while j < n and user[j] == user[i] and bins[j] == bins[i]:
            j += 1
        # rows i..j-1 come in start order; the list is doubly linked by row number
        moves = sorted(
            [(p_end[k], 0, k) for k in range(i, j)] + [(p_start[k], 1, k) for k in range(i, j)]
        )
        before, after, last, changes = {}, {}, None, 0
        for pos, is_start, k in moves:
            if is_start:
                before[k], after[k] = last, None
                if last is not None:
                    after[last] = k
                    changes += app[last] != app[k]
                last = k
            else:
                a, b = before.pop(k), after.pop(k)
                if a is not None:
                    after[a] = b
                    changes -= app[a] != app[k]
                if b is not None:
                    before[b] = a
                    changes -= app[k] != app[b]
                else:
                    last = a
                if a is not None and b is not None:
                    changes += app[a] != app[b]
            out_user.append(user[i])
            out_bin.append(bins[i])
            out_pos.append(pos)
            # events already active when the bin opens count as before its first instant
            out_kind.append(4 if is_start and start[k] == pos else 0)
            out_seq.append(len(out_seq))
            out_changes.append(changes)
            out_app.append(None if last is None else app[last])
        i = j
    return pd.DataFrame(
        {
            "user_id": out_user, "bin": out_bin, "pos": out_pos,
            "kind": out_kind, "seq": out_seq, "active_changes": out_changes, "active_app": out_app,
        }
    )


def _read_switches(p: pd.DataFrame) -> pd.DataFrame:
    """What each probe reads of the starts and of the active events' list of its bin."""
    groups = Groups(p)
    kind, changes, app = (p[c].to_numpy() for c in ("kind", "active_changes", "app"))
    code = pd.factorize(app)[0]
    stepped = (kind == 0) | (kind == 4)
    start = ((kind == 2) | (kind == 5)) & (code >= 0)
    state, seen, coming = groups.latest(stepped), groups.latest(start), groups.next(start)
    before = np.r_[-1, seen[:-1]]
    before = np.where(before >= groups.first, before, -1)
    differ = start & (before >= 0) & (code != code[before])
    q = np.flatnonzero((kind == 1) | (kind == 3))
    is_start = kind[q] == 3
    total, whole = groups.totals(differ.astype(np.int64), q)
    state, seen, coming = state[q], seen[q], coming[q]
    head, tail = groups.next(start)[groups.first[q]], groups.latest(start)[groups.last[q]]
    link = (seen >= 0) & (coming >= 0) & (code[seen] != code[coming])
    at_start = np.where(state >= 0, changes[state], 0) + whole - total - link
    named = lambda row, where: np.where(where & (row >= 0), app[row], None)
    return pd.DataFrame({
        "user_id": p["user_id"].to_numpy()[q], "req_us": p["req_us"].to_numpy()[q],
        "n": np.where(is_start, at_start, total),
        "last0": named(state, is_start), "first1": named(coming, is_start),
        "last1": named(tail, is_start & (coming >= 0)), "first2": named(head, ~is_start & (seen >= 0)),
    })


def switch_readings(
    window: DataFrame, keys: DataFrame, width_us: int, instants: bool = True
) -> DataFrame:
    """App changes over the window events overlapping ``[t - w, t)`` in start order.

    An event without length counts where it lies strictly inside (``instants``); of equal
    starts it comes first.

    The ordered list is: events already active at ``t - w``, then starts in the rest
    of that bin, then starts before ``t`` in the next bin; the three parts are read at
    the probes and joined at their ends.
    """
    seq = F.col("seq").cast("bigint") if "seq" in window.columns else F.lit(0).cast("bigint")
    events = window.select(
        F.col("user_id").cast("string").alias("user_id"),
        to_us("timestamp").alias("s_us"), to_us("event_end").alias("e_us"),
        F.col("app").cast("string").alias("app"), seq.alias("seq"),
    )
    pieces = explode_bins(events, "s_us", "e_us", width_us)
    steps = map_sorted_bins(
        pieces.select("user_id", "bin", "s_us", "p_start", "p_end", "app", "seq"),
        ["s_us", "seq", "app"],
        _active_app_steps,
        "user_id string, bin bigint, pos bigint, kind int, seq bigint, active_changes bigint, active_app string",
    )
    # at one place: ends, the probe at t, instants, the probe at t - w, starts
    starts = events.filter("e_us >= s_us" if instants else "e_us > s_us").select(
        "user_id", floor_div(F.col("s_us"), width_us).alias("bin"), F.col("s_us").alias("pos"),
        F.when(F.col("e_us") > F.col("s_us"), 5).otherwise(2).alias("kind"), "seq",
        F.lit(0).cast("bigint").alias("req_us"), F.lit(0).cast("bigint").alias("active_changes"), "app",
    )
    keys = keys.select("user_id", F.coalesce("req_us", F.lit(NO_TIME)).alias("req_us"))
    asked = probes(keys, width_us, {END: 0, START: width_us}).select(
        "user_id", "bin", "pos", F.when(F.col("role") == END, 1).otherwise(3).alias("kind"), F.lit(0).cast("bigint").alias("seq"),
        "req_us", F.lit(0).cast("bigint").alias("active_changes"), F.lit(None).cast("string").alias("app"),
    )
    steps = steps.select("user_id", "bin", "pos", "kind", "seq", F.lit(0).cast("bigint").alias("req_us"), "active_changes", F.col("active_app").alias("app"))
    read = map_sorted_bins(
        steps.unionByName(starts).unionByName(asked), ["pos", "kind", "seq", "app"], _read_switches,
        "user_id string, req_us bigint, n bigint, last0 string, first1 string, last1 string, first2 string",
    )
    one = read.groupBy(*KEY).agg(F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("last0", "first1", "last1", "first2")])
    differs = lambda a, b: F.coalesce((F.col(a) != F.col(b)).cast("bigint"), F.lit(0))
    total = (
        F.col("n") + differs("last0", "first1")
        + F.when(F.col("first1").isNotNull(), differs("last1", "first2")).otherwise(
            differs("last0", "first2")
        )
    )
    return one.select(
        "user_id", F.nullif("req_us", F.lit(NO_TIME)).alias("req_us"), total.cast("double").alias("app_switch_count")
    )


# --- input load ---------------------------------------------------------------

def input_readings(
    inputs: DataFrame, keys: DataFrame, width_us: int, recut: bool
) -> DataFrame:
    """D5 sums over input events overlapping ``[t - w, t)``; values are not prorated.

    ``recut``: durations end at the request (as if events were clipped there),
    otherwise ``duration_seconds`` is taken as given.
    Families of points, each sorted on its own: ``tail`` (events still running after
    ``t - w``, by falling end), ``head`` (events starting before ``t``), ``open``
    (the part of running events that lies after ``t``).
    """
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    activity = number("presses") + number("clicks") + number("mouse_distance") + number("scroll_abs")
    s_us, e_us = to_us("timestamp"), to_us("event_end")
    duration = (e_us - s_us) / SECOND_US if recut else number("duration_seconds")
    events = inputs.select(
        F.col("user_id").cast("string").alias("user_id"), s_us.alias("s_us"), e_us.alias("e_us"),
        number("presses").alias("presses"), number("clicks").alias("clicks"),
        number("mouse_distance").alias("mouse_distance"), number("scroll_abs").alias("scroll_abs"),
        F.when(activity > 0, duration).otherwise(0.0).alias("active_seconds"),
        (activity > 0).alias("is_active"),
    )
    measures = ["presses", "clicks", "mouse_distance", "scroll_abs", "active_seconds"]
    # cut at the request, an event without length is nothing
    pieces = explode_bins(events, "s_us", "e_us", width_us, instants=not recut)
    families = [
        F.struct(
            F.lit("tail").alias("family"), (-F.col("p_end")).alias("pos"),
            *[F.col(m).alias(m) for m in measures],
            F.lit(0).cast("bigint").alias("n_open"), F.lit(0).cast("bigint").alias("open_end"),
        ),
        F.when(
            F.col("s_us") >= F.col("bin") * width_us,
            F.struct(
                F.lit("head").alias("family"), F.col("p_start").alias("pos"),
                *[F.col(m).alias(m) for m in measures],
                F.lit(0).cast("bigint").alias("n_open"), F.lit(0).cast("bigint").alias("open_end"),
            ),
        ),
    ]
    if recut:
        late_end = F.col("e_us") - F.col("bin") * width_us
        for pos, sign in ((F.col("p_start"), 1), (F.col("p_end"), -1)):
            families.append(
                F.when(
                    F.col("is_active"),
                    F.struct(
                        F.lit("open").alias("family"), pos.alias("pos"),
                        *[F.lit(0.0).alias(m) for m in measures],
                        F.lit(sign).cast("bigint").alias("n_open"),
                        (late_end * sign).alias("open_end"),
                    ),
                )
            )
    points = pieces.select(
        "user_id", "bin", F.explode(F.filter(F.array(*families), lambda x: x.isNotNull())).alias("p")
    ).select("user_id", "bin", "p.*", F.lit(1).alias("kind"))
    asked = probes(keys, width_us, {"head": 0, "tail": width_us, **({"open": 0} if recut else {})})
    asked = asked.withColumn("family", F.col("role")).select(
        "user_id", "bin", "family", "req_us", F.lit(0).alias("kind"), F.col("pos").alias("at"),
        F.when(F.col("role") == "tail", -F.col("pos")).otherwise(F.col("pos")).alias("pos"),
    )
    upto, _ = running(["user_id", "bin", "family"], ["pos", "kind"])
    read = (
        points.unionByName(asked, allowMissingColumns=True)
        .select(
            "user_id", "req_us", "kind", "at", "bin",
            *[F.coalesce(F.sum(m).over(upto), F.lit(0.0)).alias(m) for m in measures],
            F.coalesce(F.sum("n_open").over(upto), F.lit(0)).alias("n_open"),
            F.coalesce(F.sum("open_end").over(upto), F.lit(0)).alias("open_end"),
        )
        .filter("kind = 0")
    )
    overhang = (F.col("open_end") - F.col("n_open") * (F.col("at") - F.col("bin") * width_us)) / SECOND_US
    return (
        read.withColumn("active_seconds", F.col("active_seconds") - overhang)
        .groupBy(*KEY)
        .agg(*[F.sum(m).alias(m) for m in measures])
    )


def input_columns(window_minutes: float) -> list[Column]:
    """D5 as expressions over :func:`input_readings`."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    width = F.lit(float(window_minutes))
    return [
        divide_or_zero(F.least(zero("active_seconds") / 60.0, width), width).alias("input_active_ratio"),
        (zero("presses") + zero("clicks") + zero("scroll_abs") / 100.0 + zero("mouse_distance") / 1000.0)
        .alias("input_load"),
    ]


# --- J1 / J2 ------------------------------------------------------------------

def feature_readings(
    window: DataFrame,
    web: DataFrame | None,
    inputs: DataFrame | None,
    keys: DataFrame,
    window_minutes: float = WINDOW_MINUTES,
    context: bool = False,
    recut: bool = False,
    collapse_copies: bool = True,
    runs: DataFrame | None = None,
    activity: DataFrame | None = None,
) -> DataFrame:
    """Current (and optional context) features keyed by (user_id, req_us).

    All parts end in an aggregate on the request key, so they join without
    another shuffle. A boolean ``looks_back`` of ``keys`` says for which of them context is
    read (all without). ``runs`` is the resolved timeline by category where it is
    already known; the events are then read for switches and inputs alone. ``activity`` is their
    :func:`activity_union` where a caller has it.
    """
    width = bin_width(window_minutes)
    if runs is None:
        activity = activity_union(window, web) if activity is None else activity
        runs = resolve_bins(activity, width, "category", collapse_copies)
        runs = written_once(runs) if context else runs  # read twice: by the probes and for the totals of bins
    table = segment_readings(runs, keys, width, context)
    table = table.select(
        *KEY, *activity_columns(window_minutes), *(context_columns() if context else [])
    )
    keys = keys.select(*KEY)
    table = table.join(switch_readings(window, keys, width, instants=not recut), KEY, "left")
    if inputs is None:
        table = table.withColumn("input_active_ratio", F.lit(0.0)).withColumn("input_load", F.lit(0.0))
    else:
        table = table.join(input_readings(inputs, keys, width, recut), KEY, "left").select(
            *table.columns, *input_columns(window_minutes)
        )
    return table.withColumn(
        "switch_rate", divide_or_zero(F.col("app_switch_count"), F.col("total_active_minutes"))
    )


CURRENT_COLUMNS = [
    "app_switch_count", "total_active_minutes", *TIME_COLUMNS, "ratio_communication", "switch_rate",
    "mean_focus_block_minutes", "short_fragment_count_2m", "input_active_ratio", "input_load",
]
CONTEXT_COLUMNS = [f"context_{n}_ratio_{c}" for n, cats in CONTEXT_CATEGORIES.items() for c in cats]


def window_features(
    window: DataFrame,
    web: DataFrame | None,
    inputs: DataFrame | None,
    requests: DataFrame,
    window_minutes: float = WINDOW_MINUTES,
) -> DataFrame:
    """Current-window features of every distinct (user_id, timestamp)."""
    table = feature_readings(window, web, inputs, request_keys(requests), window_minutes)
    return table.select(
        "user_id", from_us("req_us").alias("timestamp"),
        F.lit(window_minutes).cast("int").alias("window_minutes"), *CURRENT_COLUMNS,
    )


def context_features(
    window: DataFrame,
    web: DataFrame | None,
    requests: DataFrame,
    window_minutes: float = WINDOW_MINUTES,
) -> DataFrame:
    """24 h and 7 d category ratios before the current window."""
    width = bin_width(window_minutes)
    runs = resolve_bins(activity_union(window, web), width, "category")
    table = segment_readings(runs, request_keys(requests), width, context=True)
    return table.select("user_id", from_us("req_us").alias("timestamp"), *context_columns())
