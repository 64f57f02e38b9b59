"""Registered queries: each reads whole tables and most have checking SQL."""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.functions.times import HOUR_US, from_us, to_us
from dayloom.operators import contract, timeline, window_features as wf
from dayloom.operators import states as st
from dayloom.operators.timeline import activity_union
from dayloom.plans.production import production_features
from dayloom.vocab import (
    ACTIVITY_FEATURES,
    STATE_CATEGORIES,
    STATE_FEATURES,
    TIME_COLUMNS,
)
from querybook import fixtures as fx
from querybook import sqlparts as sp

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register one query and its checking SQL."""

    def register(run):
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


def rnd(name: str, value: Column | None = None) -> Column:
    """Rounded to ten places (no exact half occurs there), never minus zero."""
    return (F.round(F.col(name) if value is None else value, 10) + 0.0).alias(name)


def q_rnd(expr: str, name: str) -> str:
    return f"round({expr}, 10) + 0.0 AS {name}"


def _tables(spark, d):
    return fx.window_events(spark, d), fx.web_events(spark, d), fx.input_events(spark, d), fx.requests(spark, d)


# --- timeline -----------------------------------------------------------------

@query("resolve_overlaps", f"""
WITH {sp.FX},
bounds AS (
  SELECT DISTINCT user_id, s AS t FROM act UNION SELECT DISTINCT user_id, e FROM act
  UNION SELECT DISTINCT user_id, unnest(generate_series(s // {HOUR_US} + 1, (e - 1) // {HOUR_US})) * {HOUR_US} FROM act),
cells AS (SELECT * FROM (SELECT user_id, t AS t0, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS t1 FROM bounds) WHERE t1 IS NOT NULL),
slices AS (
  SELECT c.user_id, c.t0, c.t1, a.category, a.priority, a.s AS ts_us, a.seq
  FROM cells c JOIN act a ON a.user_id = c.user_id AND a.s <= c.t0 AND a.e >= c.t1
  QUALIFY row_number() OVER (PARTITION BY c.user_id, c.t0 ORDER BY a.priority DESC, a.s DESC, a.seq) = 1),
marked AS (
  SELECT *, CASE WHEN lag(t1) OVER w = t0 AND lag(seq) OVER w = seq AND t0 % {HOUR_US} <> 0 THEN 0 ELSE 1 END AS fresh
  FROM slices WINDOW w AS (PARTITION BY user_id ORDER BY t0)),
num AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t0) AS g FROM marked)
SELECT user_id, make_timestamp(min(t0)) AS start_time, make_timestamp(max(t1)) AS end_time,
       make_timestamp(any_value(ts_us)) AS event_time, any_value(category) AS category,
       CAST(any_value(priority) AS INTEGER) AS priority
FROM num GROUP BY user_id, g""")
def resolve_overlaps(spark, d):
    w, web, _, _ = _tables(spark, d)
    out = timeline.resolve_overlaps(w, web)
    return out.select(
        "user_id", F.col("start").alias("start_time"), F.col("end").alias("end_time"),
        F.col("timestamp").alias("event_time"), "category", "priority",
    )


@query("merge_segments", f"""
WITH {sp.FX}, {sp.CELLS},
marked AS (
  SELECT *, CASE WHEN lag(t1) OVER w = t0 AND lag(category) OVER w = category THEN 0 ELSE 1 END AS fresh
  FROM slices WINDOW w AS (PARTITION BY user_id ORDER BY t0)),
num AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t0) AS g FROM marked)
SELECT user_id, make_timestamp(min(t0)) AS start_time, make_timestamp(max(t1)) AS end_time, any_value(category) AS category
FROM num GROUP BY user_id, g""")
def merge_segments(spark, d):
    w, web, _, _ = _tables(spark, d)
    return timeline.segments(w, web).select(
        "user_id", F.col("start").alias("start_time"), F.col("end").alias("end_time"), "category"
    )


# --- J1 and its parts -----------------------------------------------------------

_J1_COLUMNS = {
    "app_switch_count": "coalesce(switches.app_switch_count, 0)",
    "total_active_minutes": "coalesce(mins.total_active_minutes, 0)",
    **{t: f"coalesce(mins.{t}, 0)" for t in TIME_COLUMNS},
    "ratio_communication": "CASE WHEN mins.total_active_minutes > 0 THEN mins.time_communication / mins.total_active_minutes ELSE 0 END",
    "switch_rate": "CASE WHEN mins.total_active_minutes > 0 THEN coalesce(switches.app_switch_count, 0) / mins.total_active_minutes ELSE 0 END",
    "mean_focus_block_minutes": "coalesce(focus.mean_focus_block_minutes, 0)",
    "short_fragment_count_2m": "coalesce(focus.short_fragment_count_2m, 0)",
    "input_active_ratio": "coalesce(inp.input_active_ratio, 0)",
    "input_load": "coalesce(inp.input_load, 0)",
}


def _per_request(parts: str, joins: list[str], columns: list[str]) -> str:
    join = " ".join(f"LEFT JOIN {j} ON {j}.user_id = req.user_id AND {j}.t = req.t" for j in joins)
    return f"WITH {sp.FX}{parts} SELECT req.user_id, req.\"timestamp\", {', '.join(columns)} FROM req {join}"


def _j1_oracle(columns: list[str]) -> str:
    return _per_request(
        f", {sp.CELLS}, {sp.CURRENT}, {sp.input_load(False)}",
        ["mins", "focus", "switches", "inp"],
        [q_rnd(_J1_COLUMNS[c], c) for c in columns],
    )


@query("window_features", _j1_oracle(list(_J1_COLUMNS)))
def window_features(spark, d):
    table = wf.window_features(*_tables(spark, d))
    return table.select("user_id", "timestamp", *[rnd(c) for c in _J1_COLUMNS])


def _segment_table(spark, d, context=False):
    w, web, _, r = _tables(spark, d)
    width = 60 * 60_000_000
    runs = timeline.resolve_bins(activity_union(w, web), width, "category")
    return wf.segment_readings(runs, wf.request_keys(r), width, context)


@query("activity_minutes", _j1_oracle(["total_active_minutes"]))
def activity_minutes(spark, d):
    return _segment_table(spark, d).select(
        "user_id", from_us("req_us").alias("timestamp"), *wf.activity_columns(60)
    ).select("user_id", "timestamp", rnd("total_active_minutes"))


@query("time_by_category", _j1_oracle(TIME_COLUMNS))
def time_by_category(spark, d):
    return _segment_table(spark, d).select(
        "user_id", from_us("req_us").alias("timestamp"), *wf.activity_columns(60)
    ).select("user_id", "timestamp", *[rnd(c) for c in TIME_COLUMNS])


@query("focus_blocks", _j1_oracle(["mean_focus_block_minutes", "short_fragment_count_2m"]))
def focus_blocks(spark, d):
    return _segment_table(spark, d).select(
        "user_id", from_us("req_us").alias("timestamp"), *wf.activity_columns(60)
    ).select("user_id", "timestamp", rnd("mean_focus_block_minutes"), rnd("short_fragment_count_2m"))


@query("communication_ratio", _j1_oracle(["ratio_communication"]))
def communication_ratio(spark, d):
    return _segment_table(spark, d).select(
        "user_id", from_us("req_us").alias("timestamp"), *wf.activity_columns(60)
    ).select("user_id", "timestamp", rnd("ratio_communication"))


@query("app_switch_count", _j1_oracle(["app_switch_count"]))
def app_switch_count(spark, d):
    w, _, _, r = _tables(spark, d)
    return wf.switch_readings(w, wf.request_keys(r), 60 * 60_000_000).select(
        "user_id", from_us("req_us").alias("timestamp"), rnd("app_switch_count")
    )


@query("input_features", _j1_oracle(["input_active_ratio", "input_load"]))
def input_features(spark, d):
    _, _, i, r = _tables(spark, d)
    return wf.input_readings(i, wf.request_keys(r), 60 * 60_000_000, recut=False).select(
        "user_id", from_us("req_us").alias("timestamp"), *wf.input_columns(60)
    ).select("user_id", "timestamp", rnd("input_active_ratio"), rnd("input_load"))


_CONTEXT_ORACLE = _per_request(
    f", {sp.CELLS}, {sp.context_parts()}", ["cr24h", "cr7d"],
    [q_rnd(f"coalesce({c}, 0)", c) for c in wf.CONTEXT_COLUMNS],
)


@query("context_features", _CONTEXT_ORACLE)
def context_features(spark, d):
    w, web, _, r = _tables(spark, d)
    return wf.context_features(w, web, r).select(
        "user_id", "timestamp", *[rnd(c) for c in wf.CONTEXT_COLUMNS]
    )


# --- hourly behaviour and states --------------------------------------------------

@query("hour_split", f"""
WITH {sp.FX}, {sp.HOUR_PIECES}
SELECT user_id, make_timestamp(h * {HOUR_US}) AS hour, category, {q_rnd('(b - a) / 60000000.0', 'minutes')},
       CAST(1 AS DOUBLE) AS event_count FROM pieces""")
def hour_split(spark, d):
    w, web, _, _ = _tables(spark, d)
    return st.hour_split(activity_union(w, web)).select(
        "user_id", from_us(F.col("hour_no") * HOUR_US).alias("hour"), "category",
        rnd("minutes", (F.col("p_end") - F.col("p_start")) / 60_000_000), F.lit(1.0).alias("event_count"),
    )


@query("hourly_behavior", f"""
WITH {sp.FX}, {sp.FULL_HOURS}, {sp.hour_label('hours0', ', '.join(['user_id', 'h', *[f'us_{c}' for c in STATE_CATEGORIES]]), 'hours')}
SELECT user_id, make_timestamp(h * {HOUR_US}) AS hour,
  {', '.join(q_rnd(f'us_{c} / 60000000.0', c) for c in STATE_CATEGORIES)},
  {', '.join(q_rnd(c, c) for c in STATE_FEATURES)} FROM hours""")
def hourly_behavior(spark, d):
    w, web, _, _ = _tables(spark, d)
    return st.hourly_behavior(w, web).select(
        "user_id", "hour", *[rnd(c) for c in STATE_CATEGORIES], *[rnd(c) for c in STATE_FEATURES]
    )


_ASSIGN_ORACLE = f"""
WITH {sp.FX}, {sp.FULL_HOURS}, {sp.hour_label('hours0', 'user_id, h', 'hours')}
SELECT user_id, make_timestamp(h * {HOUR_US}) AS hour, CAST(state AS INTEGER) AS state, {q_rnd('dist', 'state_distance_min')} FROM hours"""


@query("assign_state", _ASSIGN_ORACLE)
def assign_state(spark, d):
    w, web, _, _ = _tables(spark, d)
    return st.assign_state(st.hourly_behavior(w, web)).select(
        "user_id", "hour", F.col("state").cast("int").alias("state"), rnd("state_distance_min")
    )


_STATES_ORACLE = _per_request(
    ", " + sp.STATES, ["current60_c", "prior24h_c", "prior7d_c"],
    [sp.state_select(p) for p in ("current60", "prior24h", "prior7d")],
)


@query("add_behavior_states", _STATES_ORACLE)
def add_behavior_states(spark, d):
    w, web, _, r = _tables(spark, d)
    return st.behavior_states(w, web, r).select(
        "user_id", "timestamp", *[rnd(c) for c in st.state_columns()]
    )


# --- request history ---------------------------------------------------------------

from dayloom.operators import history as hs  # noqa: E402
from dayloom.operators import questionnaires as qs  # noqa: E402
from dayloom.functions.history_columns import history_name  # noqa: E402
from dayloom.vocab import ANSWER_RANGES, CALENDAR_COLUMNS, HISTORY_STATS, TARGETS  # noqa: E402

# rolling features over self-report rows: two values with gaps, many rows per user
_ROLL = """
roll AS (SELECT user_id, "timestamp", mood_valence AS input_load, arousal AS switch_rate FROM reports),
w AS (
  SELECT *, lag("timestamp") OVER o AS prev,
    avg(input_load) OVER (o ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m_load,
    avg(switch_rate) OVER (o ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m_rate
  FROM roll WINDOW o AS (PARTITION BY user_id ORDER BY "timestamp"))
"""
_ROLL_SQL = {
    # whole seconds over years: four places are exact enough and never a half
    "minutes_since_prev1_window": "round(coalesce((epoch_us(\"timestamp\") - epoch_us(prev)) / 60000000.0, 0), 4)",
    "rolling_mean_3_input_load": "coalesce(m_load, 0)",
    "rolling_mean_3_switch_rate": "coalesce(m_rate, 0)",
    "current_minus_rolling_mean_3_input_load": "coalesce(input_load, 0) - coalesce(m_load, 0)",
    "current_minus_rolling_mean_3_switch_rate": "coalesce(switch_rate, 0) - coalesce(m_rate, 0)",
}


def _roll_oracle(names):
    return f"""WITH {sp.REPORTS}, {_ROLL} SELECT user_id, "timestamp", {', '.join(q_rnd(_ROLL_SQL[n], n) for n in names)} FROM w"""


def _rolling(spark, d, names):
    table = fx.self_reports(spark, d).select(
        "user_id", "timestamp", F.col("mood_valence").alias("input_load"), F.col("arousal").alias("switch_rate")
    )
    out = hs.rolling_history(table, ["input_load", "switch_rate"])
    out = out.withColumn("minutes_since_prev1_window", F.round("minutes_since_prev1_window", 4))
    return out.select("user_id", "timestamp", *[rnd(n) for n in names])


for _name, _cols in {
    "request_gap": ["minutes_since_prev1_window"],
    "rolling_mean_3": ["rolling_mean_3_input_load", "rolling_mean_3_switch_rate"],
    "current_minus_rolling": [
        "current_minus_rolling_mean_3_input_load", "current_minus_rolling_mean_3_switch_rate"
    ],
}.items():
    query(_name, _roll_oracle(_cols))(lambda spark, d, cols=_cols: _rolling(spark, d, cols))


_PRIOR_SQL = f"""
WITH {sp.FX},
times AS (SELECT DISTINCT user_id, "timestamp" FROM fx WHERE source_type = 'input'),
ranked AS (
  SELECT r.user_id, r."timestamp", p."timestamp" AS prior_time,
         row_number() OVER (PARTITION BY r.user_id, r."timestamp" ORDER BY p."timestamp" DESC) AS back
  FROM req r JOIN times p ON p.user_id = r.user_id AND p."timestamp" < r."timestamp")
SELECT user_id, "timestamp", prior_time, CAST(back AS INTEGER) AS back FROM ranked WHERE back <= 3"""


@query("prior_requests_asof", _PRIOR_SQL)
def prior_requests_asof(spark, d):
    _, _, i, r = _tables(spark, d)
    out = hs.prior_requests(r, i)
    return out.select(
        "user_id", "timestamp", F.posexplode(F.reverse("prior_times")).alias("pos", "prior_time")
    ).select("user_id", "timestamp", "prior_time", (F.col("pos") + 1).cast("int").alias("back"))


@query("last_3_before", _PRIOR_SQL.replace(
    "SELECT user_id, \"timestamp\", prior_time, CAST(back AS INTEGER) AS back FROM ranked WHERE back <= 3",
    "SELECT user_id, \"timestamp\", count(*) AS n_prior, min(prior_time) AS oldest FROM ranked WHERE back <= 3 GROUP BY ALL"))
def last_3_before(spark, d):
    _, _, i, r = _tables(spark, d)
    return hs.prior_requests(r, i).filter(F.size("prior_times") > 0).select(
        "user_id", "timestamp", F.size("prior_times").cast("bigint").alias("n_prior"),
        F.get("prior_times", F.lit(0)).alias("oldest"),
    )


def _history_sql(targets):
    cols, ctes = [], []
    for t in targets:
        ctes.append(f"""
h_{t} AS (
  SELECT a.user_id, a."timestamp", count(b.v) AS n, arg_max(b.v, b.ts) AS last, avg(b.v) AS mean,
         stddev_pop(b.v) AS std, max(b.ts) AS last_ts,
         avg(b.v) FILTER (WHERE b.back <= 3) AS mean_3
  FROM reports a LEFT JOIN (
    SELECT x.user_id, x."timestamp" AS asked, y."timestamp" AS ts, y.{t} AS v,
           row_number() OVER (PARTITION BY x.user_id, x."timestamp" ORDER BY y."timestamp" DESC) AS back
    FROM reports x JOIN reports y ON x.user_id = y.user_id AND y."timestamp" < x."timestamp"
     AND y.answer_source = 'streamdeck' AND y.{t} IS NOT NULL) b
    ON b.user_id = a.user_id AND b.asked = a."timestamp"
  GROUP BY ALL)""")
        value = {
            "last": f"h_{t}.last", "mean": f"h_{t}.mean", "mean_3": f"h_{t}.mean_3",
            "std": f"CASE WHEN h_{t}.n > 1 THEN h_{t}.std ELSE 0 END", "log_count": f"ln(1.0 + h_{t}.n)",
            "log_gap_hours": f"ln(1.0 + (epoch_us(r.\"timestamp\") - epoch_us(h_{t}.last_ts)) / 3600000000.0)",
            "last_minus_mean": f"h_{t}.last - h_{t}.mean",
        }
        cols += [q_rnd(value[s], history_name(t, s)) for s in HISTORY_STATS]
    joins = " ".join(f'JOIN h_{t} ON h_{t}.user_id = r.user_id AND h_{t}."timestamp" = r."timestamp"' for t in targets)
    return ctes, cols, joins


_CALENDAR_SQL = {
    "history__hour_sin": "sin(2 * pi() * hour(r.\"timestamp\") / 24.0)",
    "history__hour_cos": "cos(2 * pi() * hour(r.\"timestamp\") / 24.0)",
    "history__dow_sin": "sin(2 * pi() * (isodow(r.\"timestamp\") - 1) / 7.0)",
    "history__dow_cos": "cos(2 * pi() * (isodow(r.\"timestamp\") - 1) / 7.0)",
}
_ctes, _cols, _joins = _history_sql(TARGETS)


@query("self_report_history", f"""
WITH {sp.REPORTS}, {', '.join(_ctes)}
SELECT r.user_id, r."timestamp", {', '.join(_cols)}, {', '.join(q_rnd(v, n) for n, v in _CALENDAR_SQL.items())}
FROM reports r {_joins}""")
def self_report_history(spark, d):
    table = fx.self_reports(spark, d).drop("seq")
    out = hs.self_report_history(table)
    return out.select(
        "user_id", "timestamp", *[rnd(history_name(t, s)) for t in TARGETS for s in HISTORY_STATS],
        *[rnd(c) for c in CALENDAR_COLUMNS],
    )


@query("calendar_cycle", f"""
WITH {sp.REPORTS} SELECT r.user_id, r."timestamp", {', '.join(q_rnd(v, n) for n, v in _CALENDAR_SQL.items())} FROM reports r""")
def calendar_cycle(spark, d):
    table = fx.self_reports(spark, d).select("user_id", "timestamp", *hs.calendar_cycle())
    return table.select("user_id", "timestamp", *[rnd(c) for c in CALENDAR_COLUMNS])


_ANSWERS = {
    "q1_feelings": "o_orderkey % 7 - 3", "q2_intensity": "o_orderkey % 7", "q3_tiredness": "o_custkey % 7",
    "q4_enthusiasm": "(o_orderkey + 2) % 7", "q5_immersion": "(o_custkey + 3) % 7",
    "q8_stress": "(o_orderkey + o_custkey) % 7", "q9_productivity": "(o_orderkey * 3) % 7",
}
_ANSWER_CTE = "a AS (SELECT o_orderkey AS seq, " + ", ".join(f"CAST({v} AS DOUBLE) AS {n}" for n, v in _ANSWERS.items()) + " FROM orders)"


@query("composite_targets", f"""
WITH {_ANSWER_CTE}
SELECT seq, {q_rnd('q1_feelings + 3', 'mood_valence')}, {q_rnd('q2_intensity', 'arousal')},
  {q_rnd('6 - q3_tiredness', 'restfulness')}, {q_rnd('6 - q8_stress', 'stress_management')},
  {q_rnd('q9_productivity', 'productivity')}, {q_rnd('(q4_enthusiasm + q5_immersion) / 2', 'engagement')},
  {q_rnd('(q1_feelings + 3 + (q4_enthusiasm + q5_immersion) / 2 + 6 - q8_stress) / 3', 'overall_wellbeing')} FROM a""")
def composite_targets(spark, d):
    return qs.composite_targets(fx.questionnaires(spark, d)).select("seq", *[rnd(t) for t in TARGETS])


@query("validate_answers", f"""
WITH {_ANSWER_CTE}, b AS (SELECT * REPLACE (q1_feelings * 1.5 AS q1_feelings, q3_tiredness - 1 AS q3_tiredness) FROM a)
SELECT seq, coalesce({', '.join(f"CASE WHEN {n} < {lo} OR {n} > {hi} THEN '{n}' END" for n, (lo, hi) in ANSWER_RANGES.items())}) AS answer_problem FROM b""")
def validate_answers(spark, d):
    table = fx.questionnaires(spark, d).withColumns(
        {"q1_feelings": F.col("q1_feelings") * 1.5, "q3_tiredness": F.col("q3_tiredness") - 1}
    )
    return qs.validate_answers(table).select("seq", "answer_problem")


@query("history_merge", f"""
WITH {sp.REPORTS}, h AS (SELECT user_id, "timestamp", lag(mood_valence) OVER (PARTITION BY user_id ORDER BY "timestamp") AS prev_mood FROM reports)
SELECT r.seq, r.user_id, r."timestamp", h.prev_mood FROM reports r LEFT JOIN h USING (user_id, "timestamp")""")
def history_merge(spark, d):
    from pyspark.sql import Window

    from dayloom.operators.joins import unique_left_join

    table = fx.self_reports(spark, d)
    past = table.select(
        "user_id", "timestamp",
        F.lag("mood_valence").over(Window.partitionBy("user_id").orderBy("timestamp")).alias("prev_mood"),
    )
    return unique_left_join(table.select("seq", "user_id", "timestamp"), past, ["user_id", "timestamp"])


# --- J3 -------------------------------------------------------------------------------

_STATE_PICK = {
    **{f"current60_state_share_{k}": f"current60_c.s{k}" for k in (0, 2, 4)},
    **{f"prior24h_state_share_{k}": f"prior24h_c.s{k}" for k in (4, 5, 0)},
    "prior7d_state_share_5": "prior7d_c.s5",
    "current60_state_active_hours": "CAST(current60_c.n AS DOUBLE)",
    "current60_state_distance_median": "current60_c.med",
}


def _production_sql(recut: bool, prior: str) -> str:
    """All activity features; ``prior`` is the CTE body of the prior times."""
    j1 = ", ".join(f"{e} AS {c}" for c, e in _J1_COLUMNS.items())
    ctx = ", ".join(f"coalesce({c}, 0) AS {c}" for c in wf.CONTEXT_COLUMNS)
    join = " ".join(
        f"LEFT JOIN {j} ON {j}.user_id = req.user_id AND {j}.t = req.t"
        for j in ("mins", "focus", "switches", "inp", "cr24h", "cr7d")
    )
    sjoin = " ".join(
        f"LEFT JOIN {j} ON {j}.user_id = f.user_id AND {j}.t = f.t" for j in ("current60_c", "prior24h_c", "prior7d_c")
    )
    rolling = {
        "minutes_since_prev1_window": "coalesce((f.t - p.last_t) / 60000000.0, 0)",
        "rolling_mean_3_input_load": "coalesce(p.input_load, 0)",
        "current_minus_rolling_mean_3_mean_focus_block_minutes": "f.mean_focus_block_minutes - coalesce(p.mean_focus_block_minutes, 0)",
        "current_minus_rolling_mean_3_switch_rate": "f.switch_rate - coalesce(p.switch_rate, 0)",
    }
    from dayloom.vocab import ACTION_SOURCES

    actions = {a: " + ".join(f"f.{s}" for s in src) for a, src in ACTION_SOURCES.items()}
    values = {
        c: rolling.get(c) or (f"coalesce({_STATE_PICK[c]}, 0)" if c in _STATE_PICK else actions.get(c, f"f.{c}"))
        for c in ACTIVITY_FEATURES
    }
    return f"""WITH {sp.FX.replace("req AS (", "asked AS (")}, {prior}, {sp.CELLS}, {sp.CURRENT.replace("x.e >= x.s", "x.e > x.s") if recut else sp.CURRENT}, {sp.input_load(recut)}, {sp.context_parts()}, {sp.STATES},
feat AS (SELECT req.user_id, req."timestamp", req.t, {j1}, {ctx} FROM req {join}),
ranked AS (
  SELECT r.user_id, r.t AS for_t, p.t, row_number() OVER (PARTITION BY r.user_id, r.t ORDER BY p.t DESC) AS back
  FROM asked r JOIN prior_times p ON p.user_id = r.user_id AND p.t < r.t),
past AS (
  SELECT k.user_id, k.for_t, max(k.t) AS last_t, avg(g.input_load) AS input_load,
         avg(g.switch_rate) AS switch_rate, avg(g.mean_focus_block_minutes) AS mean_focus_block_minutes
  FROM ranked k JOIN feat g ON g.user_id = k.user_id AND g.t = k.t WHERE k.back <= 3 GROUP BY ALL),
production AS (
  SELECT f.user_id, f."timestamp", f.t, f.total_active_minutes, {', '.join(f'{e} AS {c}' for c, e in values.items())}
  FROM feat f JOIN asked q ON q.user_id = f.user_id AND q.t = f.t
  LEFT JOIN past p ON p.user_id = f.user_id AND p.for_t = f.t {sjoin})"""


_PRIOR_SELF = """prior_times AS (SELECT user_id, t FROM asked), req AS (SELECT * FROM asked)"""


@query("production_features", _production_sql(False, _PRIOR_SELF) + f"""
SELECT user_id, "timestamp", {', '.join(q_rnd(c, c) for c in ACTIVITY_FEATURES)} FROM production""")
def production_features_query(spark, d):
    return production_features(*_tables(spark, d)).select(
        "user_id", "timestamp", *[rnd(c) for c in ACTIVITY_FEATURES]
    )


# --- raw events ---------------------------------------------------------------------

from dayloom.functions import text as tx  # noqa: E402
from dayloom.functions.categories import categorize_web, categorize_window  # noqa: E402
from dayloom.vocab import TAXONOMY_CATEGORY  # noqa: E402
from dayloom.functions.numbers import coerce_number, divide_or_zero  # noqa: E402
from dayloom.functions.times import normalize_timestamp  # noqa: E402
from dayloom.operators import parse  # noqa: E402

_RAW = """
base AS (
  SELECT event_id, ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, value,
    ' u' || CAST(user_id // 10 AS VARCHAR) || ' ' AS user_id, 'b-' || event_type AS bucket,
    CASE event_type WHEN 'view' THEN 'web.tab.current' WHEN 'click' THEN 'currentwindow'
      WHEN 'purchase' THEN 'os.hid.input' WHEN 'signup' THEN 'afkstatus' ELSE 'app.editor.activity' END AS type,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS ts_text,
    CAST(round((value - 5.0) * 600) AS BIGINT) AS seconds
  FROM events),
raw AS (
  SELECT b.*, c.copy, event_id * 3 + c.copy AS seq,
    CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN 'host' END AS hostname,
    CASE WHEN k % 2 = 0 THEN 'meta' END AS meta_host,
    seconds + CASE WHEN c.copy = 1 THEN 60 ELSE 0 END AS dur,
    CASE type WHEN 'currentwindow' THEN 'window' WHEN 'web.tab.current' THEN 'web' WHEN 'os.hid.input' THEN 'input' END AS stream,
    CASE WHEN k % 11 = 0 THEN 'loginwindow' WHEN k % 7 = 0 THEN 'unknown' ELSE 'app' || CAST(k % 9 AS VARCHAR) END AS app,
    'note ' || CAST(k % 13 AS VARCHAR) AS title,
    'https://www.site' || CAST(k % 10 AS VARCHAR) || '.example.com/p' AS url,
    'site' || CAST(k % 10 AS VARCHAR) || '.example.com' AS domain,
    -- only the terms that can occur in this text are needed of the rules
    timezone('Europe/Zurich', timezone('UTC', ts)) AS local_ts
  FROM base b, (SELECT unnest([0, 1, 2]) AS copy) c),
valid AS (SELECT * FROM raw WHERE stream IS NOT NULL AND dur > 0 AND dur < 43200),
snap AS (
  SELECT trim(user_id) AS user_id, bucket, stream, event_id, any_value(k) AS k, max(dur) AS dur, min(seq) AS seq,
    any_value(app) AS app, any_value(title) AS title, any_value(url) AS url, any_value(domain) AS domain,
    any_value(local_ts) AS local_ts, coalesce(nullif(any_value(hostname), ''), any_value(meta_host), 'unknown') AS host
  FROM valid GROUP BY user_id, bucket, stream, event_id),
parsed AS (SELECT *, make_timestamp(epoch_us(local_ts) + dur * 1000000) AS local_end, strftime(local_ts, '%Y-%m-%d') AS day FROM snap)
"""


def _duck_category(text: str) -> str:
    """The rule file as SQL: deepest first, in file order, case folded by the 'i' flag."""
    import json
    from pathlib import Path

    import dayloom.functions

    file = Path(dayloom.functions.__path__[0]) / "category_rules.json"
    rules = [c for c in json.loads(file.read_text(encoding="utf-8"))["categories"] if c["rule"]["type"] == "regex"]
    hits = []
    for c in sorted(rules, key=lambda c: -len(c["name"])):
        flags = "'i'" if c["rule"].get("ignore_case") else "'c'"
        pattern = c["rule"]["regex"].replace("'", "''")
        name = TAXONOMY_CATEGORY["_".join(re.findall("[a-z0-9]+", "_".join(c["name"]).lower().replace("&", " and ")))]
        hits.append(f"WHEN regexp_matches({text}, '{pattern}', {flags}) THEN '{name}'")
    return "CASE " + " ".join(hits) + " ELSE 'other' END"


_WINDOW_CATEGORY = _duck_category("(app || chr(10) || title || chr(10) || url)")
_WEB_CATEGORY = _duck_category("(title || chr(10) || url)")


@query("route_buckets", f"""WITH {_RAW} SELECT seq, type, stream FROM raw WHERE stream IS NOT NULL""")
def route_buckets(spark, d):
    raw = fx.raw_tracker_events(spark, d)
    return raw.select("seq", "type", parse.stream_of(F.col("type")).alias("stream")).filter("stream IS NOT NULL")


@query("valid_duration", f"""WITH {_RAW} SELECT seq, CAST(dur AS DOUBLE) AS duration_seconds FROM raw WHERE dur > 0 AND dur < 43200""")
def valid_duration(spark, d):
    raw = fx.raw_tracker_events(spark, d)
    return raw.select("seq", coerce_number(F.col("duration")).alias("duration_seconds")).filter(
        parse.valid_duration(F.col("duration_seconds"))
    )


@query("coerce_number", """
SELECT doc_id, CASE WHEN regexp_full_match(w, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(w AS DOUBLE) ELSE 0.0 END AS number
FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 1 THEN lang WHEN 2 THEN 'true'
  WHEN 3 THEN CAST(n_chars AS VARCHAR) || '.25' WHEN 4 THEN 'nan' ELSE '-' || CAST(n_chars AS VARCHAR) || 'e1' END AS w FROM documents)""")
def coerce_number_query(spark, d):
    n = F.col("n_chars").cast("string")
    word = (
        F.when(F.col("doc_id") % 6 == 0, n).when(F.col("doc_id") % 6 == 1, F.col("lang"))
        .when(F.col("doc_id") % 6 == 2, "true").when(F.col("doc_id") % 6 == 3, F.concat(n, F.lit(".25")))
        .when(F.col("doc_id") % 6 == 4, "nan").otherwise(F.concat(F.lit("-"), n, F.lit("e1")))
    )
    return fx.table(spark, d, "documents").select("doc_id", coerce_number(word).alias("number"))


@query("dedupe_heartbeats", f"""WITH {_RAW} SELECT user_id, bucket, stream AS source_type, seq, CAST(dur AS DOUBLE) AS duration_seconds FROM snap""")
def dedupe_heartbeats(spark, d):
    return parse.dedupe_heartbeats(fx.raw_tracker_events(spark, d)).select(
        "user_id", "bucket", "source_type", "seq", "duration_seconds"
    )


@query("base_row", f"""WITH {_RAW} SELECT user_id, seq, local_ts AS "timestamp", local_end AS event_end, day AS date FROM parsed""")
def base_row(spark, d):
    return parse.base_rows(parse.dedupe_heartbeats(fx.raw_tracker_events(spark, d))).select(
        "user_id", "seq", "timestamp", "event_end", "date"
    )


@query("hostname_fallback", f"""WITH {_RAW} SELECT user_id, seq, host AS hostname FROM snap""")
def hostname_fallback(spark, d):
    return parse.dedupe_heartbeats(fx.raw_tracker_events(spark, d)).select("user_id", "seq", "hostname")


_BASE_SQL = """bucket, user_id, host AS hostname, local_ts AS "timestamp", local_end AS event_end, day AS date, CAST(dur AS DOUBLE) AS duration_seconds, stream AS source_type"""


@query("window_rows", f"""WITH {_RAW} SELECT {_BASE_SQL}, app, {_WINDOW_CATEGORY} AS category,
  'high' AS category_confidence, '' AS category_rule, title, url, seq FROM parsed WHERE stream = 'window' AND app <> 'loginwindow'""")
def window_rows(spark, d):
    return parse.parse_events(fx.raw_tracker_events(spark, d)).window


@query("web_rows", f"""WITH {_RAW} SELECT {_BASE_SQL}, domain, {_WEB_CATEGORY} AS category,
  'high' AS category_confidence, '' AS category_rule, url, title, k % 4 = 1 AS audible,
  CAST(CASE WHEN k % 2 = 0 THEN k % 8 ELSE k % 5 END AS INTEGER) AS tab_count, seq FROM parsed WHERE stream = 'web'""")
def web_rows(spark, d):
    return parse.parse_events(fx.raw_tracker_events(spark, d)).web


@query("input_rows", f"""WITH {_RAW} SELECT {_BASE_SQL}, CAST(k AS DOUBLE) AS presses, CAST(k % 5 AS DOUBLE) AS clicks,
  CAST(k % 3 * 5 AS DOUBLE) AS mouse_distance, CAST(abs(k % 4 - 2) + k % 6 AS DOUBLE) AS scroll_abs, seq FROM parsed WHERE stream = 'input'""")
def input_rows(spark, d):
    return parse.parse_events(fx.raw_tracker_events(spark, d)).input


@query("parse_events", f"""WITH {_RAW} SELECT user_id, stream AS source_type, count(*) AS n_events, sum(CAST(dur AS DOUBLE)) AS seconds,
  min(local_ts) AS first_start, max(local_end) AS last_end FROM parsed WHERE NOT (stream = 'window' AND app = 'loginwindow') GROUP BY ALL""")
def parse_events(spark, d):
    columns = ["user_id", "source_type", "timestamp", "event_end", "duration_seconds"]
    w, web, i = (t.select(*columns) for t in parse.parse_events(fx.raw_tracker_events(spark, d)))
    return w.unionByName(web).unionByName(i).groupBy("user_id", "source_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("duration_seconds").alias("seconds"),
        F.min("timestamp").alias("first_start"), F.max("event_end").alias("last_end"),
    )


@query("normalize_timestamp", """
SELECT event_id, CASE WHEN event_id % 3 = 2 THEN ts
  ELSE timezone('Europe/Zurich', timezone('UTC', ts - CASE WHEN event_id % 3 = 1 THEN INTERVAL 5 HOUR ELSE INTERVAL 0 HOUR END)) END AS local_time
FROM events""")
def normalize_timestamp_query(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    suffix = F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+05:00").otherwise("")
    return fx.table(spark, d, "events").select(
        "event_id", normalize_timestamp(F.concat(text, suffix)).alias("local_time")
    )


_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"


@query("normalize_text", f"""SELECT page_id, trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) AS clean,
  lower(trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g'))) AS text_key FROM pages""")
def normalize_text(spark, d):
    # hidden marks and odd white space are put in here and must vanish
    noisy = F.concat(F.lit("‎  "), F.regexp_replace("title", " ", " \t "), F.lit("﻿ \x1f"))
    return fx.pages(spark, d).select(
        "page_id", tx.normalize_text(noisy).alias("clean"), tx.text_key(noisy).alias("text_key")
    )


@query("normalize_domain", """
SELECT page_id, CASE page_id % 5 WHEN 3 THEN 'about' ELSE regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1), '^www\\.', '') END AS domain FROM pages""")
def normalize_domain(spark, d):
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    url = (
        F.when(F.col("page_id") % 5 == 1, F.concat(F.lit("HTTPS://user:pw@WWW."), F.regexp_replace(bare, r"^www\.", "")))
        .when(F.col("page_id") % 5 == 2, bare)
        .when(F.col("page_id") % 5 == 3, F.lit("about:blank"))
        .when(F.col("page_id") % 5 == 4, F.regexp_replace("url", r"^([a-z]+://[^/]*)", "$1.:bad"))
        .otherwise(F.col("url"))
    )
    return fx.pages(spark, d).select("page_id", tx.normalize_domain(url).alias("domain"))


@query("categorize", f"""
WITH p AS (SELECT page_id, trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) AS title, url FROM pages)
SELECT page_id, {_duck_category("(title || chr(10) || url)")} AS web_category,
  {_duck_category("('Firefox' || chr(10) || title || chr(10) || url)")} AS window_category FROM p""")
def categorize(spark, d):
    return fx.pages(spark, d).select(
        "page_id", categorize_web(F.col("url"), F.col("title")).alias("web_category"),
        categorize_window(F.lit("Firefox"), F.col("title"), F.col("url")).alias("window_category"),
    )


# --- table checks ----------------------------------------------------------------------

_BAD = """
bad AS (
  SELECT event_id AS seq, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN '  ' ELSE ' u' || CAST(user_id // 10 AS VARCHAR) END AS user_id,
    ts AS "timestamp", ts + to_seconds(CAST(round((value - 3) * 60) AS BIGINT)) AS event_end,
    CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN 'gardening' ELSE ' media ' END AS category FROM events)
"""


def _bad_events(spark, d):
    n = F.col("event_id")
    seconds = F.round((F.col("value") - 3) * 60).cast("bigint")
    return fx.table(spark, d, "events").select(
        n.alias("seq"),
        F.when(n % 17 == 0, None).when(n % 19 == 0, "  ")
        .otherwise(F.concat(F.lit(" u"), F.expr("cast(user_id div 10 as string)"))).alias("user_id"),
        F.col("ts").alias("timestamp"), from_us(to_us("ts") + seconds * 1_000_000).alias("event_end"),
        F.lit("app").alias("app"),
        F.when(n % 23 == 0, None).when(n % 29 == 0, "gardening").otherwise(" media ").alias("category"),
    )


@query("prepare_events", f"""
WITH {_BAD} SELECT seq, trim(user_id) AS user_id, "timestamp", event_end, trim(category) AS category, 'window' AS source_type, 'unknown' AS category_confidence,
  CASE WHEN event_end < "timestamp" THEN 'end before start' WHEN user_id IS NULL THEN 'missing user_id' WHEN trim(user_id) = '' THEN 'blank user_id'
       WHEN category IS NULL THEN 'missing category' WHEN category = 'gardening' THEN 'unknown category' END AS problem FROM bad""")
def prepare_events(spark, d):
    return contract.check_events(_bad_events(spark, d), "window").drop("app")


@query("clip_events_at", f"""
WITH {sp.FX} SELECT seq, user_id, "timestamp", make_timestamp(least(e, epoch_us(TIMESTAMP '2024-01-15 12:00:00'))) AS event_end,
  (least(e, epoch_us(TIMESTAMP '2024-01-15 12:00:00')) - s) / 1000000.0 AS duration_seconds
FROM fx WHERE source_type = 'input' AND "timestamp" < TIMESTAMP '2024-01-15 12:00:00' AND e > s""")
def clip_events_at(spark, d):
    end = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return contract.clip_events_at(fx.input_events(spark, d), end).select(
        "seq", "user_id", "timestamp", "event_end", "duration_seconds"
    )


@query("select_window", f"""
WITH {sp.FX} SELECT seq, user_id FROM fx WHERE source_type = 'window' AND "timestamp" < TIMESTAMP '2024-01-15 12:00:00' AND e > epoch_us(TIMESTAMP '2024-01-15 06:00:00')""")
def select_window(spark, d):
    at = lambda t: F.lit(f"2024-01-15 {t}").cast("timestamp_ntz")
    return contract.select_window(fx.window_events(spark, d), at("06:00:00"), at("12:00:00")).select("seq", "user_id")


@query("has_current_activity", f"""
WITH {sp.FX} SELECT user_id, "timestamp", EXISTS (SELECT 1 FROM act WHERE act.user_id = req.user_id AND act.s < req.t AND act.e > req.t - {sp.MIN60}) AS has_activity FROM req""")
def has_current_activity(spark, d):
    w, web, _, r = _tables(spark, d)
    return contract.requests_with_activity(r.distinct(), w, web)


@query("normalize_requests", f"""
WITH {sp.FX} SELECT user_id, timezone('Europe/Zurich', timezone('UTC', "timestamp")) AS "timestamp" FROM fx WHERE source_type = 'request'""")
def normalize_requests(spark, d):
    r = fx.requests(spark, d).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return contract.normalize_requests(r)


@query("require_activity_source", """
SELECT 'u' || CAST(user_id AS VARCHAR) AS user_id FROM events
GROUP BY user_id HAVING NOT bool_or(event_type = 'click' AND event_id % 5 = 0)""")
def require_activity_source(spark, d):
    e = fx.table(spark, d, "events")
    buckets = e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        F.when((F.col("event_type") == "click") & (F.col("event_id") % 5 == 0), "currentwindow")
        .otherwise("afkstatus").alias("type"),
    )
    return contract.users_without_activity_source(buckets)


@query("numeric_features", """
SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'a' WHEN o_orderkey % 7 = 0 THEN 'b' END AS strict_problem,
  CASE WHEN o_orderkey % 13 = 0 THEN 'a' END AS model_problem FROM orders""")
def numeric_features(spark, d):
    o = fx.table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 13 == 0, float("inf")).otherwise(F.col("o_totalprice")).alias("a"),
        F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_totalprice")).alias("b"),
    )
    return o.select(
        "o_orderkey", contract.feature_problem(o, ["a", "b"], allow_missing=False).alias("strict_problem"),
        contract.feature_problem(o, ["a", "b"], allow_missing=True).alias("model_problem"),
    )


@query("divide_or_zero", """
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity - 10 > 0 THEN l_extendedprice / (l_quantity - 10) ELSE 0 END, 9) AS ratio FROM lineitem""")
def divide_or_zero_query(spark, d):
    return fx.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.round(divide_or_zero(F.col("l_extendedprice"), F.col("l_quantity") - 10), 9).alias("ratio"),
    )


@query("project_contract", f"""
WITH {sp.REPORTS} SELECT user_id, "timestamp", {', '.join(TARGETS)} FROM reports""")
def project_contract(spark, d):
    return contract.project_contract(fx.self_reports(spark, d), ["user_id", "timestamp", *TARGETS])


# --- joins as pairs -----------------------------------------------------------------------

from dayloom.operators import joins as jn  # noqa: E402


@query("overlap_join", f"""
WITH {sp.FX} SELECT r.user_id, r."timestamp" AS request_time, x.seq, greatest(x.s, r.t - {sp.MIN60}) AS clip_start_us, least(x.e, r.t) AS clip_end_us
FROM req r JOIN act x ON x.user_id = r.user_id AND x.source_type = 'window' AND x.s < r.t AND x.e > r.t - {sp.MIN60}""")
def overlap_join(spark, d):
    w, _, _, r = _tables(spark, d)
    return jn.overlap_join(r, w).select("user_id", "request_time", "seq", "clip_start_us", "clip_end_us")


@query("context_join", f"""
WITH {sp.FX} SELECT r.user_id, r."timestamp" AS request_time, x.seq, greatest(x.s, r.t - {25 * HOUR_US}) AS clip_start_us, least(x.e, r.t - {HOUR_US}) AS clip_end_us
FROM req r JOIN act x ON x.user_id = r.user_id AND x.source_type = 'web' AND x.s < r.t - {HOUR_US} AND x.e > r.t - {25 * HOUR_US}""")
def context_join(spark, d):
    _, web, _, r = _tables(spark, d)
    return jn.overlap_join(r, web, from_minutes=25 * 60, to_minutes=60, bin_minutes=240).select(
        "user_id", "request_time", "seq", "clip_start_us", "clip_end_us"
    )


@query("overlap_join_streams", f"""
WITH {sp.FX} SELECT r.user_id, r."timestamp" AS request_time, x.source_type AS source, x.seq, greatest(x.s, r.t - {sp.MIN60}) AS clip_start_us, least(x.e, r.t) AS clip_end_us
FROM req r JOIN fx x ON x.user_id = r.user_id AND x.source_type IN ('window', 'web', 'input') AND x.e > x.s AND x.s < r.t AND x.e > r.t - {sp.MIN60}""")
def overlap_join_streams(spark, d):
    """C1 over all three streams."""
    w, web, i, r = _tables(spark, d)
    pairs = jn.stream_pairs(r, {"window": w, "web": web, "input": i}, 60)
    return pairs.select("user_id", "request_time", "source", "seq", "clip_start_us", "clip_end_us")


@query("context_join_week", f"""
WITH {sp.FX} SELECT r.user_id, r."timestamp" AS request_time, x.source_type AS source, x.seq, greatest(x.s, r.t - {169 * HOUR_US}) AS clip_start_us, least(x.e, r.t - {HOUR_US}) AS clip_end_us
FROM req r JOIN act x ON x.user_id = r.user_id AND x.s < r.t - {HOUR_US} AND x.e > r.t - {169 * HOUR_US}""")
def context_join_week(spark, d):
    """C2 over both activity streams and seven days."""
    w, web, _, r = _tables(spark, d)
    pairs = jn.stream_pairs(r, {"window": w, "web": web}, 169 * 60, 60, bin_minutes=24 * 60)
    return pairs.select("user_id", "request_time", "source", "seq", "clip_start_us", "clip_end_us")


@query("state_range_join", f"""
WITH {sp.FX}, {sp.FULL_HOURS}, {sp.hour_label('hours0', 'user_id, h', 'hours')}
SELECT r.user_id, r."timestamp" AS request_time, make_timestamp(h * {HOUR_US}) AS hour, CAST(state AS INTEGER) AS state
FROM req r JOIN hours f ON f.user_id = r.user_id AND f.h >= (r.t - {25 * HOUR_US}) // {HOUR_US} AND f.h * {HOUR_US} < r.t - {HOUR_US}""")
def state_range_join(spark, d):
    w, web, _, r = _tables(spark, d)
    labelled = st.assign_state(st.hourly_behavior(w, web)).select("user_id", "hour", "state")
    return jn.state_range_join(r, labelled, 25 * 60, 60).select(
        "user_id", "request_time", "hour", F.col("state").cast("int").alias("state")
    )


@query("union_all", f"""WITH {sp.FX} SELECT user_id, seq, category, CAST(priority AS INTEGER) AS priority, s AS s_us, e AS e_us FROM act
UNION ALL SELECT user_id, seq, category, CASE source_type WHEN 'web' THEN 1 ELSE 0 END, s, e FROM fx WHERE source_type IN ('window','web') AND e <= s""")
def union_all(spark, d):
    w, web, _, _ = _tables(spark, d)
    return activity_union(w, web)


@query("distinct_times", f"""WITH {sp.FX} SELECT DISTINCT user_id, "timestamp" FROM fx WHERE source_type IN ('request', 'input')""")
def distinct_times(spark, d):
    _, _, i, r = _tables(spark, d)
    return jn.distinct_times(r, i)


@query("replace_one_hour", f"""
WITH {sp.FX}, {sp.FULL_HOURS}
SELECT user_id, make_timestamp(h * {HOUR_US}) AS hour, CAST(CASE WHEN h = epoch_us(TIMESTAMP '2024-01-10 12:00:00') // {HOUR_US} THEN 0 ELSE event_count END AS BIGINT) AS event_count FROM hours0""")
def replace_one_hour(spark, d):
    w, web, _, _ = _tables(spark, d)
    hourly = st.hourly_behavior(w, web).select("user_id", "hour", F.col("event_count").cast("bigint").alias("event_count"))
    at = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    partial = hourly.filter(F.col("hour") == at).withColumn("event_count", F.lit(0).cast("bigint"))
    return jn.replace_hour(hourly, partial, ["user_id"], at)


# --- allocations, scores, recourse --------------------------------------------------------

from dayloom.functions.target_specs import COMPACT_TARGETS, TargetSpec  # noqa: E402
from dayloom.operators import allocations as al  # noqa: E402
from dayloom.operators import constraints as cs  # noqa: E402
from dayloom.operators import recourse as rc  # noqa: E402
from dayloom.operators import scoring as sc  # noqa: E402
from dayloom.plans import runtime as rt  # noqa: E402
from dayloom.functions.history_columns import HISTORY_COLUMNS, RUNTIME_COLUMNS  # noqa: E402
from dayloom.vocab import ACTION_COLUMNS, ACTION_NAMES, ACTION_SOURCES, ACTIONABLE_COLUMNS  # noqa: E402

# order-keyed allocations: 14 minute columns that stay within the hour, in whole quarters
_MINUTES = {t: f"(o_orderkey * {i + 3} + o_custkey * {7 * i + 1}) % 17 / 4.0" for i, t in enumerate(TIME_COLUMNS)}
_ALLOC = f"""
al0 AS (SELECT o_orderkey, o_custkey, {', '.join(f'{e} AS {t}' for t, e in _MINUTES.items())} FROM orders),
al AS (SELECT *, {', '.join(' + '.join(src) + f' AS {a}' for a, src in ACTION_SOURCES.items())} FROM al0)"""


def _minutes_table(spark, d):
    """One row per order with 14 minute columns (at most 56 minutes together)."""
    return fx.table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", *[F.expr(e).cast("double").alias(t) for t, e in _MINUTES.items()]
    )


_LINE = ["o_orderkey"]


@query("action_allocations", f"""WITH {_ALLOC} SELECT o_orderkey, {', '.join(f'CAST({a} AS DOUBLE) AS {a}' for a in ACTION_COLUMNS)} FROM al""")
def action_allocations(spark, d):
    return al.action_allocations(_minutes_table(spark, d)).select(*_LINE, *ACTION_COLUMNS)


@query("validate_allocation", f"""WITH {_ALLOC} SELECT o_orderkey,
  CASE WHEN action_minutes_media - 2 < -1e-9 THEN 'negative' WHEN {' + '.join(ACTION_COLUMNS)} - 2 + 20 > 60.0001 THEN 'exceeds the window' END AS problem FROM al""")
def validate_allocation(spark, d):
    table = al.action_allocations(_minutes_table(spark, d)).withColumns(
        {"action_minutes_media": F.col("action_minutes_media") - 2, "action_minutes_other": F.col("action_minutes_other") + 20}
    )
    return table.select(*_LINE, al.allocation_problem().alias("problem"))


_SWAPS = f"""
sw AS (
  SELECT al.*, p.d, p.r, p.d * 7 + p.r AS swap_no,
    list_extract([{', '.join(f"'{a}'" for a in ACTION_COLUMNS)}], p.d + 1) AS donor, list_extract([{', '.join(f"'{a}'" for a in ACTION_COLUMNS)}], p.r + 1) AS receiver
  FROM al, (SELECT a.d, b.r FROM (SELECT unnest(range(7)) AS d) a, (SELECT unnest(range(7)) AS r) b WHERE a.d <> b.r) p
  WHERE list_extract([{', '.join(ACTION_COLUMNS)}], p.d + 1) >= 5.0)"""
_MOVED = {a: f"{a} + CASE WHEN d = {i} THEN -5 WHEN r = {i} THEN 5 ELSE 0 END" for i, a in enumerate(ACTION_COLUMNS)}
_WEIGHTS = {
    "action_minutes_development": 0.011, "action_minutes_writing": 0.007, "action_minutes_research": 0.009,
    "action_minutes_communication": -0.003, "action_minutes_media": -0.006,
    "action_minutes_personal_distraction": -0.012, "action_minutes_other": -0.001,
}


def _linear_sql(weights: dict[str, float], intercept: float, columns: dict[str, str]) -> str:
    return f"({intercept!r} + " + " + ".join(f"({columns[c]}) * ({w!r})" for c, w in weights.items()) + ")"


@query("swap_scenarios", f"""WITH {_ALLOC}, {_SWAPS} SELECT o_orderkey, CAST(swap_no AS INTEGER) AS swap_no, donor, receiver, {', '.join(f'CAST({e} AS DOUBLE) AS {a}' for a, e in _MOVED.items())} FROM sw""")
def swap_scenarios(spark, d):
    return al.swap_scenarios(al.action_allocations(_minutes_table(spark, d)).select(*_LINE, *ACTION_COLUMNS))


QUERIES["swap_cross_join"], ORACLES["swap_cross_join"] = QUERIES["swap_scenarios"], ORACLES["swap_scenarios"]


@query("best_swap", f"""WITH {_ALLOC}, {_SWAPS},
scored AS (SELECT *, round({_linear_sql(_WEIGHTS, 0.3, _MOVED)}, 9) AS score FROM sw)
SELECT o_orderkey, donor, receiver, {q_rnd('score', 'score')} FROM scored
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, swap_no) = 1""")
def best_swap(spark, d):
    table = al.action_allocations(_minutes_table(spark, d)).select(*_LINE, *ACTION_COLUMNS)
    scored = sc.add_score(al.swap_scenarios(table), sc.linear_scorer(_WEIGHTS, 0.3), "score")
    best = F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("swap_no")).alias("rank"), "donor", "receiver"))
    return scored.groupBy(*_LINE).agg(best.alias("b")).select(*_LINE, "b.donor", "b.receiver", rnd("score", F.col("b.score")))


@query("allocation_changes", f"""WITH {_ALLOC}, {_SWAPS},
ch AS ({' UNION ALL '.join(f"SELECT o_orderkey, swap_no, '{n}' AS category, {a} AS b, {_MOVED[a]} AS a FROM sw WHERE d = {i} OR r = {i}" for i, (a, n) in enumerate(zip(ACTION_COLUMNS, ACTION_NAMES)))})
SELECT o_orderkey, CAST(swap_no AS INTEGER) AS swap_no, category, CAST(b AS DOUBLE) AS baseline_minutes, CAST(a AS DOUBLE) AS counterfactual_minutes, CAST(a - b AS DOUBLE) AS delta_minutes FROM ch""")
def allocation_changes(spark, d):
    table = al.action_allocations(_minutes_table(spark, d))
    before = [f"before_{i}" for i in range(7)]
    kept = table.select(*_LINE, *ACTION_COLUMNS, *[F.col(a).alias(b) for a, b in zip(ACTION_COLUMNS, before)])
    moved = al.swap_scenarios(kept)
    return moved.select(*_LINE, "swap_no", F.inline(al.allocation_changes(before, ACTION_COLUMNS)))


@query("check_time_budget", f"""WITH {_ALLOC} SELECT o_orderkey, (time_media - 2 >= -0.0001 AND {' + '.join(ACTIONABLE_COLUMNS)} <= 60 - 35 + 0.0001) AS ok FROM al""")
def check_time_budget(spark, d):
    table = _minutes_table(spark, d).withColumn("minutes_afk", F.lit(35.0))
    ok = cs.time_budget_ok(table, {"time_media": F.lit(-2.0), "time_writing": F.lit(2.0)})
    return table.select(*_LINE, ok.alias("ok"))


@query("validate_counterfactual", f"""WITH {_ALLOC} SELECT o_orderkey,
  CASE WHEN o_orderkey % 5 = 0 THEN 'immutable feature modified: sleep_hours' WHEN o_custkey % 3 = 2 THEN 'not zero-sum'
       WHEN time_media - 3 < -0.0001 THEN 'negative minutes: time_media' END AS violation FROM al""")
def validate_counterfactual(spark, d):
    original = _minutes_table(spark, d).withColumn("sleep_hours", F.lit(8.0))
    modified = original.withColumns(
        {
            "time_media": F.col("time_media") - 3,
            "time_writing": F.col("time_writing") + F.when(F.col("o_custkey") % 3 == 2, 4).otherwise(3),
            "sleep_hours": F.when(F.col("o_orderkey") % 5 == 0, 7.0).otherwise(8.0),
        }
    )
    return cs.validate_counterfactual(original, modified, _LINE)


@query("first_crossing", """
SELECT o_orderkey, CAST(CASE WHEN o_totalprice % 100 >= 50 THEN 0 WHEN o_totalprice % 1000 >= 500 THEN 1 WHEN o_totalprice % 10 >= 5 THEN 2 ELSE -1 END AS INTEGER) AS step FROM orders""")
def first_crossing(spark, d):
    path = F.array(F.expr("o_totalprice % 100 / 100"), F.expr("o_totalprice % 1000 / 1000"), F.expr("o_totalprice % 10 / 10"))
    return fx.table(spark, d, "orders").select("o_orderkey", F.coalesce(rc.first_crossing(path, 0.5), F.lit(-1)).cast("int").alias("step"))


def _recommend_sql() -> str:
    """The greedy rounds unrolled: with linear weights the best swap is found per round."""
    rounds = []
    cur = [f"c{i}" for i in range(7)]
    rounds.append(
        f"r0 AS (SELECT o_orderkey, {', '.join(f'CAST({a} AS DOUBLE) AS {c}' for a, c in zip(ACTION_COLUMNS, cur))},"
        f" {_linear_sql(_WEIGHTS, 0.2, {a: a for a in ACTION_COLUMNS})} AS p, 1 AS alive FROM al)"
    )
    for k in range(1, 13):
        moved = {a: f"{c} + CASE WHEN d = {i} THEN -5 WHEN r = {i} THEN 5 ELSE 0 END" for i, (a, c) in enumerate(zip(ACTION_COLUMNS, cur))}
        rounds.append(f"""
s{k} AS (
  SELECT x.o_orderkey, p, {', '.join(f'{e} AS n{i}' for i, e in enumerate(moved.values()))}, {_linear_sql(_WEIGHTS, 0.2, moved)} AS score
  FROM r{k - 1} x, (SELECT a.d, b.r FROM (SELECT unnest(range(7)) AS d) a, (SELECT unnest(range(7)) AS r) b WHERE a.d <> b.r) q
  WHERE x.alive = 1 AND {'x.p < 0.5 AND ' if k == 1 else ''}list_extract([{', '.join(cur)}], q.d + 1) + 1e-12 >= 5
  QUALIFY row_number() OVER (PARTITION BY x.o_orderkey ORDER BY score DESC, q.d * 7 + q.r) = 1),
r{k} AS (SELECT o_orderkey, {', '.join(f'n{i} AS {c}' for i, c in enumerate(cur))}, score AS p, 1 AS alive FROM s{k} WHERE score > p + 1e-12)""")
    union = " UNION ALL ".join(
        f"SELECT o_orderkey, {k} AS step, p, {', '.join(cur)} FROM r{k}" for k in range(13)
    )
    return f"""WITH {_ALLOC}, {', '.join(rounds)},
path AS ({union}),
base AS (SELECT o_orderkey, p AS p0, {', '.join(f'{c} AS b{i}' for i, c in enumerate(cur))} FROM r0),
cross_ AS (
  SELECT o_orderkey, min(step) FILTER (WHERE path.p - p0 >= 0.25 - 1e-12) AS great, min(step) FILTER (WHERE path.p - p0 >= 0.1 - 1e-12) AS slight
  FROM path JOIN base USING (o_orderkey) GROUP BY ALL)
SELECT o_orderkey, {q_rnd('p0', 'baseline_probability_high')}, {q_rnd('path.p', 'projected_probability_high')},
  CASE WHEN great IS NOT NULL THEN 'Greatly improve' WHEN slight IS NOT NULL THEN 'Improve slightly' ELSE 'Keep' END AS strength,
  {', '.join(q_rnd(f'path.c{i} - b{i}', f'delta_{n}') for i, n in enumerate(ACTION_NAMES))}
FROM base JOIN cross_ USING (o_orderkey) JOIN path USING (o_orderkey)
WHERE path.step = coalesce(great, slight, 0)"""


def _delta_of(name: str) -> Column:
    hit = F.filter("changes", lambda c: c["category"] == name)
    return F.coalesce(F.get(hit, F.lit(0))["delta_minutes"], F.lit(0.0))


@query("recommend_changes", _recommend_sql())
def recommend_changes(spark, d):
    scorer = sc.linear_scorer(_WEIGHTS, 0.2)
    table = al.action_allocations(_minutes_table(spark, d)).select(*_LINE, *ACTION_COLUMNS)
    table = sc.add_score(table, scorer, "p0")
    out = rc.recommend_changes(table, "p0", scorer, ACTION_COLUMNS, keep=_LINE)
    return out.select(
        *_LINE, rnd("baseline_probability_high"), rnd("projected_probability_high"), "strength",
        *[rnd(f"delta_{n}", _delta_of(n)) for n in ACTION_NAMES],
    )


_LEGACY = {"time_development": 0.1, "time_writing": 0.07, "time_media": -0.03, "time_personal_distraction": -0.05}


def _reach_sql() -> str:
    """The desired-score search unrolled; scores carry the sign of the direction."""
    from dayloom.vocab import DONOR_ORDER, RECEIVER_ORDER

    cur = [f"c{i}" for i in range(7)]
    base = {c: f"b{i}" for i, c in enumerate(DONOR_ORDER)}
    pairs = [(DONOR_ORDER.index(a), DONOR_ORDER.index(b)) for a in DONOR_ORDER for b in RECEIVER_ORDER if a != b]
    values = ", ".join(f"({no}, {a}, {b})" for no, (a, b) in enumerate(pairs))
    clip = lambda columns: f"least(greatest({_linear_sql(_LEGACY, 1.0, columns)}, 0.0), 6.0)"
    kept = "o_orderkey, s0, goal, sg, " + ", ".join(base.values())
    steps = [f"""
o0 AS (SELECT o_orderkey, {', '.join(f"CAST({'time_media * 3' if c == 'time_media' else c} AS DOUBLE) AS {b}" for c, b in base.items())}, CAST(o_custkey % 4 + 0.5 AS DOUBLE) AS goal FROM al0),
o1 AS (SELECT *, {clip(base)} AS s0 FROM o0),
o2 AS (SELECT *, CASE WHEN goal > s0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg FROM o1),
r0 AS (SELECT {kept}, {', '.join(f'{b} AS {c}' for b, c in zip(base.values(), cur))}, sg * s0 AS score,
  CASE WHEN goal <> s0 AND {' + '.join(base.values())} <= 60.0001 THEN 1 ELSE 0 END AS alive FROM o2),
pr AS (SELECT * FROM (VALUES {values}) v(no, d, r))"""]
    for k in range(1, 13):
        moved = {c: f"{a} + CASE WHEN d = {i} THEN -5 WHEN r = {i} THEN 5 ELSE 0 END" for i, (c, a) in enumerate(zip(DONOR_ORDER, cur))}
        steps.append(f"""
s{k} AS (
  SELECT {kept}, score AS before, {', '.join(f'{e} AS n{i}' for i, e in enumerate(moved.values()))}, sg * {clip(moved)} AS new_score
  FROM r{k - 1}, pr WHERE alive = 1 AND list_extract([{', '.join(base.values())}], d + 1) >= 5 AND list_extract([{', '.join(cur)}], d + 1) >= 5
  QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY new_score DESC, no) = 1),
r{k} AS (SELECT {kept}, {', '.join(f'n{i} AS {c}' for i, c in enumerate(cur))}, new_score AS score, CASE WHEN new_score < sg * goal THEN 1 ELSE 0 END AS alive
  FROM s{k} WHERE new_score > before)""")
    union = " UNION ALL ".join(f"SELECT {k} AS step, * FROM r{k}" for k in range(13))
    moved_by = [f"abs({c} - {b})" for c, b in zip(cur, base.values())]
    return f"""WITH {_ALLOC}, {', '.join(steps)}, path AS ({union}),
final AS (SELECT * FROM path QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY step DESC) = 1)
SELECT o_orderkey, round(s0, 4) AS predicted_score, round(goal, 4) AS desired_score, round(s0 + (sg * score - s0) * 1.0, 4) AS projected_score,
  goal = s0 OR sg * (s0 + (sg * score - s0) * 1.0) >= sg * goal AS success,
  CAST({' + '.join(f'CASE WHEN {m} > 0.0001 THEN 1 ELSE 0 END' for m in moved_by)} AS BIGINT) AS n_shifts,
  {' + '.join(moved_by)} AS moved_minutes FROM final"""


@query("reach_desired_score", _reach_sql())
def reach_desired_score(spark, d):
    raw = sc.linear_scorer(_LEGACY, 1.0)
    clipped = lambda c: F.least(F.greatest(raw(c), F.lit(0.0)), F.lit(6.0))
    table = _minutes_table(spark, d).withColumn("time_media", F.col("time_media") * 3)
    table = sc.add_score(table, clipped, "score", TIME_COLUMNS).withColumn("goal", F.expr("o_custkey % 4 + 0.5D"))
    return rc.reach_desired_score(table, "score", "goal", clipped, features=TIME_COLUMNS, keep=_LINE).select(
        *_LINE, "predicted_score", "desired_score", "projected_score", "success",
        F.size("shifts").cast("bigint").alias("n_shifts"),
        F.aggregate("shifts", F.lit(0.0), lambda a, s: a + F.abs(s["delta_minutes"])).alias("moved_minutes"),
    )


@query("global_standardize", """SELECT o_orderkey, round((o_totalprice - 250000.0) / 80000.0, 10) AS o_totalprice FROM orders""")
def global_standardize(spark, d):
    out = sc.global_standardize(fx.table(spark, d, "orders"), {"o_totalprice": 250000.0}, {"o_totalprice": 80000.0})
    return out.select("o_orderkey", F.round("o_totalprice", 10).alias("o_totalprice"))


_USER_STATS_SQL = f"""
WITH {sp.REPORTS}, st AS (SELECT user_id, avg(arousal) AS m, stddev_pop(arousal) AS s FROM reports GROUP BY user_id HAVING count(arousal) > 10 AND stddev_pop(arousal) > 0)
SELECT seq, r.user_id, {q_rnd('(arousal - coalesce(m, 3.0)) / coalesce(s, 1.5)', 'arousal')} FROM reports r LEFT JOIN st USING (user_id)"""


@query("per_user_standardize", _USER_STATS_SQL)
def per_user_standardize(spark, d):
    table = fx.self_reports(spark, d)
    stats = table.groupBy("user_id").agg(
        F.avg("arousal").alias("mean_arousal"), F.stddev_pop("arousal").alias("std_arousal"), F.count("arousal").alias("n")
    ).filter("n > 10 AND std_arousal > 0").drop("n")
    out = sc.per_user_standardize(table, ["arousal"], stats, {"arousal": 3.0}, {"arousal": 1.5})
    return out.select("seq", "user_id", rnd("arousal"))


QUERIES["user_stats_join"], ORACLES["user_stats_join"] = QUERIES["per_user_standardize"], ORACLES["per_user_standardize"]

def _demo_models():
    """Fixed linear weights over each target's own features (no fitted model is published)."""
    out = {}
    for spec in COMPACT_TARGETS:
        weights = {f: round(0.02 * ((7 * i) % 5 - 2), 2) for i, f in enumerate(spec.features)}
        metrics = {"validation_mse": 0.5, "test_mse": 0.6}
        spec = TargetSpec(spec.target, spec.model_name, spec.prediction_frame, spec.gamma, spec.features, 3.0, spec.score_range, metrics)
        out[spec.target] = (spec, sc.linear_scorer(weights, 0.0 if spec.prediction_frame == "personal_residual" else 3.0), weights)
    return out


def _score_sql(spec, weights, column) -> str:
    """One target's score as SQL over a row of runtime features."""
    value = "(" + ("0.0" if spec.prediction_frame == "personal_residual" else "3.0") + "".join(
        f" + coalesce({column(f)}, 0.0) * ({w!r})" for f, w in weights.items()) + ")"
    base = f"coalesce({column(history_name(spec.target, 'mean'))}, 3.0)"
    if spec.prediction_frame == "personal_residual":
        value = f"({value} + {base})"
    if spec.gamma < 1:
        value = f"({base} + {spec.gamma!r} * ({value} - {base}))"
    return f"least(greatest({value}, 0.0), 6.0)"


# history-only rows: activity features are constants there
def _history_rows(spark, d):
    table = hs.self_report_history(fx.self_reports(spark, d).drop("seq"))
    activity = {c: F.expr(f"{i % 5}.5D") for i, c in enumerate(ACTIVITY_FEATURES)}
    return table.select("user_id", "timestamp", *[v.alias(c) for c, v in activity.items()], *HISTORY_COLUMNS)


_HROWS = f"""WITH {sp.REPORTS}, {', '.join(_ctes)}, hist AS (
SELECT r.user_id, r."timestamp", {', '.join(f"CAST({i % 5}.5 AS DOUBLE) AS {c}" for i, c in enumerate(ACTIVITY_FEATURES))},
{', '.join(c.replace('round(', '(').replace(', 10)', ')') for c in _cols)}, {', '.join(f'{v} AS {n}' for n, v in _CALENDAR_SQL.items())}
FROM reports r {_joins})"""


@query("score_target", f"""{_HROWS} SELECT user_id, "timestamp", {q_rnd(_score_sql(_demo_models()['productivity'][0], _demo_models()['productivity'][2], lambda c: c), 'productivity')} FROM hist""")
def score_target(spark, d):
    spec, scorer, _ = _demo_models()["productivity"]
    return sc.score_target(_history_rows(spark, d), spec, scorer).select("user_id", "timestamp", rnd("productivity"))


@query("score_all_targets", f"""{_HROWS} SELECT user_id, "timestamp", {', '.join(q_rnd(_score_sql(m[0], m[2], lambda c: c), f'score_{t}') for t, m in _demo_models().items())} FROM hist""")
def score_all_targets(spark, d):
    models = {t: m[:2] for t, m in _demo_models().items()}
    return sc.score_all_targets(_history_rows(spark, d), models).select(
        "user_id", "timestamp", *[rnd(f"score_{t}") for t in TARGETS]
    )


@query("probability_high", f"""WITH {_ALLOC} SELECT o_orderkey, {q_rnd(_linear_sql(_WEIGHTS, 0.45, {a: a for a in ACTION_COLUMNS}), 'p')},
  CASE WHEN {_linear_sql(_WEIGHTS, 0.45, {a: a for a in ACTION_COLUMNS})} >= 0.5 THEN 'high' ELSE 'not_high' END AS state FROM al""")
def probability_high(spark, d):
    table = al.action_allocations(_minutes_table(spark, d)).select(*_LINE, *ACTION_COLUMNS)
    out = sc.probability_high(table, sc.linear_scorer(_WEIGHTS, 0.45), "p", ACTION_COLUMNS)
    return out.select(*_LINE, sc.state_of(F.col("p")).alias("state"), rnd("p"))


# --- J4-J6: whole runtime rows -----------------------------------------------------------------

def _runtime(spark, d):
    """Requests with input times as questionnaires and scored web events as reports."""
    e = fx.interval_events(spark, d)
    reports = e.filter("source_type = 'web'").groupBy("user_id", "timestamp").agg(
        *[F.max(F.expr(f"CASE WHEN (k + {i}) % 5 <> 0 THEN (k * {i + 1}) % 7 END")).cast("double").alias(t) for i, t in enumerate(TARGETS)]
    )
    i = fx.input_events(spark, d)
    tables = parse.EventTables(fx.window_events(spark, d), fx.web_events(spark, d), i)
    return rt.runtime_features(tables, fx.requests(spark, d), i.select("user_id", "timestamp"), reports)


_RUNTIME_PRIOR = """
prior_times AS (SELECT DISTINCT user_id, s AS t FROM fx WHERE source_type IN ('input', 'web')),
req AS (SELECT DISTINCT user_id, make_timestamp(t) AS "timestamp", t FROM (SELECT user_id, t FROM asked UNION SELECT user_id, t FROM prior_times))"""


def _runtime_sql() -> str:
    reports = f"""
reports AS (
  SELECT user_id, s AS t, {', '.join(f"max(CASE WHEN (k + {i}) % 5 <> 0 THEN (k * {i + 1}) % 7 END)::DOUBLE AS {x}" for i, x in enumerate(TARGETS))}
  FROM fx WHERE source_type = 'web' GROUP BY ALL)"""
    ctes, values = [], {}
    for x in TARGETS:
        ctes.append(f"""
h_{x} AS (
  SELECT user_id, t, count(*) AS n, arg_max(v, ts) AS last, avg(v) AS mean, stddev_pop(v) AS std, max(ts) AS last_ts, avg(v) FILTER (WHERE back <= 3) AS mean_3
  FROM (SELECT a.user_id, a.t, y.t AS ts, y.{x} AS v, row_number() OVER (PARTITION BY a.user_id, a.t ORDER BY y.t DESC) AS back
        FROM asked a JOIN reports y ON y.user_id = a.user_id AND y.t < a.t AND y.{x} IS NOT NULL)
  GROUP BY ALL)""")
        values |= {
            history_name(x, "last"): f"h_{x}.last", history_name(x, "mean"): f"h_{x}.mean",
            history_name(x, "mean_3"): f"h_{x}.mean_3",
            history_name(x, "std"): f"CASE WHEN h_{x}.n > 1 THEN h_{x}.std ELSE 0 END",
            history_name(x, "log_count"): f"ln(1.0 + coalesce(h_{x}.n, 0))",
            history_name(x, "log_gap_hours"): f"ln(1.0 + (r.t - h_{x}.last_ts) / 3600000000.0)",
            history_name(x, "last_minus_mean"): f"h_{x}.last - h_{x}.mean",
        }
    values |= _CALENDAR_SQL
    joins = " ".join(f"LEFT JOIN h_{x} ON h_{x}.user_id = r.user_id AND h_{x}.t = r.t" for x in TARGETS)
    return f"""{_production_sql(True, _RUNTIME_PRIOR)}, {reports}, {', '.join(ctes)},
runtime AS (
  SELECT r.user_id, r."timestamp", {', '.join(f'r.{c} AS {c}' for c in ACTIVITY_FEATURES)}, {', '.join(f'{values[c]} AS {c}' for c in HISTORY_COLUMNS)}
  FROM production r {joins} WHERE r.total_active_minutes > 0)"""


_RUNTIME_SQL = _runtime_sql()


@query("runtime_features", f"""{_RUNTIME_SQL} SELECT user_id, "timestamp", {', '.join(q_rnd(c, c) for c in RUNTIME_COLUMNS[2:])} FROM runtime""")
def runtime_features(spark, d):
    return _runtime(spark, d).features.select("user_id", "timestamp", *[rnd(c) for c in RUNTIME_COLUMNS[2:]])


_MODELS_SQL = {t: _score_sql(m[0], m[2], lambda c: c) for t, m in _demo_models().items()}


def _report_rows(reports):
    return reports.select(
        F.col("participant_id"), "prediction_timestamp", "model_version", F.inline("predictions")
    ).select("participant_id", "prediction_timestamp", "model_version", "target", "title", rnd("prediction"), "model")


_REPORT_ROWS = " UNION ALL ".join(
    f"""SELECT user_id AS participant_id, "timestamp" AS prediction_timestamp, 'compact_aw_v2' AS model_version, '{t}' AS target,
    '{sc.TARGET_TITLES[t]}' AS title, {q_rnd(_MODELS_SQL[t], 'prediction')}, '{m[0].model_name}' AS model FROM {{table}}"""
    for t, m in _demo_models().items()
)


@query("prediction_report", f"{_HROWS} {_REPORT_ROWS.format(table='hist')}")
def prediction_report(spark, d):
    models = {t: m[:2] for t, m in _demo_models().items()}
    return _report_rows(rt.score_requests(_history_rows(spark, d), models))


@query("score_requests", f"{_RUNTIME_SQL} {_REPORT_ROWS.format(table='runtime')}")
def score_requests(spark, d):
    models = {t: m[:2] for t, m in _demo_models().items()}
    return _report_rows(rt.score_requests(_runtime(spark, d).features, models))


# half weights keep the linear probability inside 0..1 for every allocation
_HIGH = {**{a: w / 2 for a, w in _WEIGHTS.items()}, "history__productivity__mean": 0.02}


_HASHED = " || ".join(
    f"""',"{t}":' || coalesce(CAST({t} AS VARCHAR), 'null')""" for t in TARGETS
)


@query("content_hash", f"""
WITH {sp.REPORTS} SELECT seq, sha256('demo' || chr(10) || '{{"user_id":"' || user_id || '","timestamp":"' ||
  strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%g') || '"' || {_HASHED} || '}}') AS content_hash FROM reports""")
def content_hash(spark, d):
    table = fx.self_reports(spark, d)
    return table.select("seq", sc.content_hash(table, "demo", ["user_id", "timestamp", *TARGETS]).alias("content_hash"))


# --- the same operators under their own names, and single columns of wider ones ---------------

from dayloom.functions.history_columns import columns_of_set  # noqa: E402

for _alias, _same in {
    "nearest_state": "assign_state", "context_ratios": "context_features",
    "slice_event_join": "resolve_overlaps", "finalize": "window_rows",
}.items():
    QUERIES[_alias], ORACLES[_alias] = QUERIES[_same], ORACLES[_same]


def _state_subset(spark, d, columns):
    w, web, _, r = _tables(spark, d)
    return st.behavior_states(w, web, r).select("user_id", "timestamp", *[rnd(c) for c in columns])


def _subset_sql(columns):
    return f"""SELECT user_id, "timestamp", {', '.join(columns)} FROM ({_STATES_ORACLE})"""


_INTERVAL = [c for c in st.state_columns() if c.startswith("prior7d")]
_TRANSITIONS = [c for c in st.state_columns() if c.endswith("transition_count")]
for _name, _cols in {"state_interval": _INTERVAL, "state_transitions": _TRANSITIONS}.items():
    query(_name, _subset_sql(_cols))(lambda spark, d, cols=_cols: _state_subset(spark, d, cols))


@query("hourly_counts_join", f"""
WITH {sp.FX}, {sp.HOUR_PIECES}
SELECT user_id, make_timestamp(h * {HOUR_US}) AS hour, CAST(count(*) AS DOUBLE) AS event_count FROM pieces GROUP BY ALL""")
def hourly_counts_join(spark, d):
    w, web, _, _ = _tables(spark, d)
    return st.hourly_behavior(w, web).select("user_id", "hour", "event_count")


_SET = columns_of_set("history_vector_aw25", "arousal")


@query("feature_sets", f"""{_HROWS} SELECT user_id, "timestamp", {', '.join(q_rnd(c, c) for c in _SET)} FROM hist""")
def feature_sets(spark, d):
    table = contract.project_contract(_history_rows(spark, d), ["user_id", "timestamp", *_SET])
    return table.select("user_id", "timestamp", *[rnd(c) for c in _SET])


# --- sources and sinks ---------------------------------------------------------------------------

from dayloom.sources import buckets as bk, configs, sinks  # noqa: E402


@query("explode_buckets", """
SELECT 'u' || CAST(user_id AS VARCHAR) AS user_id, 'b-' || event_type AS bucket, 'currentwindow' AS type, event_id,
  CAST(c.copy AS BIGINT) AS seq, CAST(event_id % 100 + c.copy AS VARCHAR) AS duration
FROM events, (SELECT unnest([0, 1, 2]) AS copy) c""")
def explode_buckets(spark, d):
    def event(k):
        return F.struct(
            F.lit("2024-01-01T00:00:00").alias("timestamp"),
            (F.col("event_id") % 100 + k).cast("string").alias("duration"),
            F.col("event_id").cast("string").alias("data"),
        )

    exports = fx.table(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        F.create_map(
            F.concat(F.lit("b-"), F.col("event_type")),
            F.struct(
                F.lit("currentwindow").alias("type"), F.lit("h").alias("hostname"), F.lit(None).cast("string").alias("data"),
                F.array(*[event(k) for k in range(3)]).alias("events"),
            ),
        ).alias("buckets"),
    )
    return bk.raw_events(exports).select(
        "user_id", "bucket", "type", F.col("data").cast("bigint").alias("event_id"), "seq", "duration"
    )


@query("rules_source", f"""
SELECT {_duck_category("(regexp_extract(html, '<title>(.*?)</title>', 1) || chr(10) || url)")} AS category, count(*) AS pages
FROM pages GROUP BY ALL""")
def rules_source(spark, d):
    """The rule file read as an installation's own, and the named categories it gives."""
    import dayloom.functions

    rules = configs.load_rules(f"{dayloom.functions.__path__[0]}/category_rules.json")
    return (
        fx.pages(spark, d).select(categorize_web(F.col("url"), F.col("title"), rules).alias("category"))
        .groupBy("category").agg(F.count("*").alias("pages"))
    )


QUERIES["category_slug"], ORACLES["category_slug"] = QUERIES["rules_source"], ORACLES["rules_source"]


@query("feature_sink", f"""
WITH {sp.FX} SELECT user_id, "timestamp", CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS date FROM fx WHERE source_type = 'request'""")
def feature_sink(spark, d):
    """Written by date to the shared folder and read back."""
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{shared.rstrip('/')}/features-{uuid.uuid4().hex}"
    sinks.write_features(fx.requests(spark, d), path, writers=2)
    return spark.read.parquet(path).select("user_id", "timestamp", F.col("date").cast("string").alias("date"))


@query("runtime_rejected", f"""{_RUNTIME_SQL},
bad AS (SELECT DISTINCT user_id FROM fx WHERE source_type = 'input' AND k % 97 = 5)
SELECT user_id, "timestamp", reason, count(*) AS n FROM (
  SELECT user_id, "timestamp", CASE WHEN user_id IN (SELECT user_id FROM bad) THEN 'input: negative: presses'
    ELSE 'no window or web activity in the current 60-minute window' END AS reason
  FROM production WHERE total_active_minutes IS NULL OR total_active_minutes <= 0 OR user_id IN (SELECT user_id FROM bad)
  UNION ALL SELECT DISTINCT user_id, CAST(NULL AS TIMESTAMP), 'invalid timestamp' FROM fx WHERE source_type = 'request' AND k % 5 = 0
) GROUP BY ALL""")
def runtime_rejected(spark, d):
    """Requests without activity, of users with an invalid event, or without a time."""
    e = fx.interval_events(spark, d)
    i = fx.input_events(spark, d)
    bad = i.withColumn("presses", F.when(F.col("presses") % 97 == 5, -1.0).otherwise(F.col("presses")))
    tables = parse.EventTables(fx.window_events(spark, d), fx.web_events(spark, d), bad)
    unread = e.filter("source_type = 'request' AND k % 5 = 0").select("user_id", F.lit(None).cast("timestamp_ntz").alias("timestamp"))
    asked = fx.requests(spark, d).unionByName(unread).withColumn("user_id", F.concat(F.lit(" "), F.col("user_id")))
    return rt.runtime_features(tables, asked).rejected.groupBy("user_id", "timestamp", "reason").agg(F.count("*").alias("n"))
