"""Shared pieces of the checking SQL (DuckDB): the same tables and semantics,
written directly per request, without bins or running totals."""

from __future__ import annotations

from dayloom.functions.state_model import DEFAULT_STATE_MODEL
from dayloom.vocab import CATEGORIES, CONTEXT_CATEGORIES, CONTEXT_DAYS, STATE_CATEGORIES, STATE_FEATURES, TARGETS

HOUR = 3_600_000_000
MINUTE = 60_000_000

CATEGORY_LIST = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"

FX = f"""
raw_fx AS (
  SELECT event_id AS seq, 'u' || CAST(user_id // 10 AS VARCHAR) AS user_id, ts AS "timestamp",
         CASE WHEN event_type = 'view' THEN 'web' WHEN event_type IN ('click','signup') THEN 'window'
              WHEN event_type = 'purchase' THEN 'input' ELSE 'request' END AS source_type,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, value,
         CASE WHEN event_id % 17 = 0 THEN 0 ELSE CAST(round(least(value, 700.0) * 60) AS BIGINT) END AS secs
  FROM events),
fx AS (
  SELECT *, epoch_us("timestamp") AS s, epoch_us("timestamp") + secs * 1000000 AS e,
         CAST(secs AS DOUBLE) AS duration_seconds, 'app' || CAST(k % 9 AS VARCHAR) AS app,
         list_extract({CATEGORY_LIST}, CAST(k % 14 + 1 AS BIGINT)) AS category
  FROM raw_fx),
act AS (
  SELECT user_id, s, e, seq, category, source_type, app,
         CASE source_type WHEN 'web' THEN 1 ELSE 0 END AS priority
  FROM fx WHERE source_type IN ('window','web') AND e > s),
req AS (SELECT DISTINCT user_id, "timestamp", epoch_us("timestamp") AS t FROM fx WHERE source_type = 'request')
"""

CELLS = """
bounds AS (SELECT DISTINCT user_id, s AS t FROM act UNION SELECT DISTINCT user_id, e FROM act),
cells AS (
  SELECT * FROM (SELECT user_id, t AS t0, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS t1 FROM bounds)
  WHERE t1 IS NOT NULL),
slices AS (
  SELECT c.user_id, c.t0, c.t1, a.category, a.priority, a.s AS ts_us, a.seq
  FROM cells c JOIN act a ON a.user_id = c.user_id AND a.s <= c.t0 AND a.e >= c.t1
  QUALIFY row_number() OVER (PARTITION BY c.user_id, c.t0 ORDER BY a.priority DESC, a.s DESC, a.seq) = 1)
"""


def clipped(name: str, lo: str, hi: str) -> str:
    """Timeline slices cut to [lo, hi) of each request."""
    return f"""
{name} AS (
  SELECT r.user_id, r.t, greatest(c.t0, {lo}) AS a, least(c.t1, {hi}) AS b, c.category
  FROM req r JOIN slices c ON c.user_id = r.user_id AND c.t0 < {hi} AND c.t1 > {lo})"""


MIN60 = 60 * MINUTE
CURRENT = clipped("cur", f"r.t - {MIN60}", "r.t") + f""",
marked AS (
  SELECT *, CASE WHEN lag(b) OVER w = a AND lag(category) OVER w = category THEN 0 ELSE 1 END AS fresh
  FROM cur WINDOW w AS (PARTITION BY user_id, t ORDER BY a)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, t ORDER BY a) AS island FROM marked),
islands AS (SELECT user_id, t, island, max(b) - min(a) AS len FROM numbered GROUP BY ALL),
focus AS (
  SELECT user_id, t, sum(len) / {MINUTE}.0 / count(*) AS mean_focus_block_minutes,
         CAST(count(*) FILTER (WHERE len < {2 * MINUTE}) AS DOUBLE) AS short_fragment_count_2m
  FROM islands GROUP BY ALL),
mins AS (
  SELECT user_id, t, least(sum(b - a) / {MINUTE}.0, 60.0) AS total_active_minutes,
  {", ".join(f"coalesce(sum(b - a) FILTER (WHERE category = '{c}'), 0) / {MINUTE}.0 AS time_{c}" for c in CATEGORIES)}
  FROM cur GROUP BY ALL),
apps AS (
  SELECT r.user_id, r.t, x.app, lag(x.app) OVER (PARTITION BY r.user_id, r.t ORDER BY x.s, x.e > x.s, x.seq) AS prev
  FROM req r JOIN fx x ON x.user_id = r.user_id AND x.source_type = 'window' AND x.e >= x.s AND x.s < r.t AND x.e > r.t - {MIN60}),
switches AS (
  SELECT user_id, t, CAST(count(*) FILTER (WHERE prev <> app) AS DOUBLE) AS app_switch_count FROM apps GROUP BY ALL)"""


def input_load(recut: bool) -> str:
    """Input sums of the events overlapping the window."""
    duration = "(least(x.e, r.t) - x.s) / 1000000.0" if recut else "x.duration_seconds"
    kept = ">" if recut else ">="
    return f"""
inp AS (
  SELECT r.user_id, r.t,
    least(coalesce(sum(CASE WHEN x.k + x.k % 5 + x.value * 11 > 0 THEN {duration} END), 0) / 60.0, 60.0) / 60.0 AS input_active_ratio,
    sum(x.k) + sum(x.k % 5) + sum(x.value) / 100.0 + sum(x.value * 10) / 1000.0 AS input_load
  FROM req r JOIN fx x ON x.user_id = r.user_id AND x.source_type = 'input' AND x.e {kept} x.s
    AND x.s < r.t AND x.e > r.t - {MIN60}
  GROUP BY ALL)"""


def context_parts() -> str:
    parts = []
    for name, days in CONTEXT_DAYS.items():
        hi = f"r.t - {MIN60}"
        parts.append(clipped(f"c{name}", f"r.t - {MIN60 + days * 24 * HOUR}", hi))
        ratios = ", ".join(
            f"coalesce(sum(b - a) FILTER (WHERE category = '{c}'), 0) / least(sum(b - a), {days * 24 * HOUR})"
            f"::DOUBLE AS context_{name}_ratio_{c}"
            for c in CONTEXT_CATEGORIES[name]
        )
        parts.append(f"\ncr{name} AS (SELECT user_id, t, {ratios} FROM c{name} GROUP BY ALL)")
    return ",".join(parts)


def hour_label(source: str, keys: str, name: str) -> str:
    """From per-hour category sums to features, state and distance."""
    m = DEFAULT_STATE_MODEL
    total = " + ".join(f"us_{c}" for c in STATE_CATEGORIES)
    shares = {c: f"(us_{c} / {MINUTE}.0 / greatest(tot, 1e-9))" for c in STATE_CATEGORIES}
    values = [
        "least(tot, 60.0)", "least(tot, 60.0) / 60.0", "CAST(event_count AS DOUBLE)",
        "CAST(" + " + ".join(f"(us_{c} > 0)::INT" for c in STATE_CATEGORIES) + " AS DOUBLE)",
        "0.0 - (" + " + ".join(f"CASE WHEN us_{c} > 0 THEN {s} * log2({s}) ELSE 0.0 END" for c, s in shares.items()) + ")",
        "sin(2 * pi() * (h % 24) / 24.0)", "cos(2 * pi() * (h % 24) / 24.0)", *shares.values(),
    ]
    feats = ", ".join(f"{v} AS {n}" for v, n in zip(values, STATE_FEATURES))
    dists = []
    for i, center in enumerate(m.centers):
        terms = " + ".join(
            f"pow(({f} - {mu!r}::DOUBLE) / {sd!r}::DOUBLE - ({c!r}::DOUBLE), 2)"
            for f, mu, sd, c in zip(STATE_FEATURES, m.mean, m.scale, center)
        )
        dists.append(f"sqrt({terms}) AS d{i}")
    low = "least(" + ", ".join(f"d{i}" for i in range(m.n_states)) + ")"
    pick = "CASE " + " ".join(f"WHEN d{i} = dist THEN {i}" for i in range(m.n_states)) + " END"
    return f"""
{name}_t AS (SELECT *, ({total}) / {MINUTE}.0 AS tot FROM {source}),
{name}_f AS (SELECT {keys}, {feats} FROM {name}_t),
{name}_d AS (SELECT *, {', '.join(dists)} FROM {name}_f),
{name}_m AS (SELECT *, {low} AS dist FROM {name}_d),
{name} AS (SELECT *, {pick} AS state FROM {name}_m)"""


def category_sums(amount: str) -> str:
    return ", ".join(
        f"coalesce(sum({amount}) FILTER (WHERE category = '{c}'), 0) AS us_{c}" for c in STATE_CATEGORIES
    )


HOUR_PIECES = f"""
pieces AS (
  SELECT user_id, seq, category, s, e, h, greatest(s, h * {HOUR}) AS a, least(e, (h + 1) * {HOUR}) AS b
  FROM (SELECT *, unnest(generate_series(s // {HOUR}, (e - 1) // {HOUR})) AS h FROM act))"""

FULL_HOURS = (
    HOUR_PIECES
    + f""",
hours0 AS (SELECT user_id, h, count(*) AS event_count, {category_sums('b - a')} FROM pieces GROUP BY ALL)"""
)


def state_rows() -> str:
    """Per request: full hours but its own, plus the re-split running hour."""
    return (
        FULL_HOURS + ","
        + hour_label("hours0", "user_id, h", "hours") + f""",
part0 AS (
  SELECT r.user_id, r.t, h, count(*) AS event_count, {category_sums('b - a')}
  FROM (
    SELECT q.user_id, q.t, q.category, q.h, greatest(q.s, q.h * {HOUR}) AS a, least(q.ee, (q.h + 1) * {HOUR}) AS b
    FROM (
      SELECT r.user_id, r.t, x.category, x.s, least(x.e, r.t) AS ee,
             unnest(generate_series(x.s // {HOUR}, (least(x.e, r.t) - 1) // {HOUR})) AS h
      FROM req r JOIN act x ON x.user_id = r.user_id AND x.s < r.t AND x.e > (r.t // {HOUR}) * {HOUR}
    ) q) r
  GROUP BY ALL),"""
        + hour_label("part0", "user_id, t, h", "part") + f""",
both_rows AS (
  SELECT r.user_id, r.t, f.h, 0 AS p, f.state, f.dist FROM req r JOIN hours f
    ON f.user_id = r.user_id AND f.h <> r.t // {HOUR} AND f.h < r.t // {HOUR} + 1
   AND f.h >= r.t // {HOUR} - 172 WHERE f.active_minutes > 0
  UNION ALL
  SELECT user_id, t, h, 1, state, dist FROM part WHERE active_minutes > 0)"""
    )


def state_interval(prefix: str, lo: str, hi: str, n: int = 6) -> str:
    """One range of state statistics; lo is floored to the hour, hi is not."""
    return f"""
{prefix}_r AS (
  SELECT *, lag(state) OVER (PARTITION BY user_id, t ORDER BY h, p) AS prev FROM both_rows
  WHERE h >= ({lo}) // {HOUR} AND h * {HOUR} < {hi}),
{prefix}_c AS (
  SELECT user_id, t, count(*) AS n, quantile_cont(dist, 0.5) AS med,
         count(*) FILTER (WHERE prev <> state) AS trans,
         {', '.join(f'count(*) FILTER (WHERE state = {k}) / count(*) AS s{k}' for k in range(n))}
  FROM {prefix}_r GROUP BY ALL)"""


def state_select(prefix: str, n: int = 6) -> str:
    ent = " + ".join(f"CASE WHEN {prefix}_c.s{k} > 0 THEN {prefix}_c.s{k} * log2({prefix}_c.s{k}) ELSE 0 END" for k in range(n))
    values = {
        "active_hours": f"CAST({prefix}_c.n AS DOUBLE)",
        "distance_median": f"{prefix}_c.med",
        "dominant_share": "greatest(" + ", ".join(f"{prefix}_c.s{k}" for k in range(n)) + ")",
        "entropy": f"0 - ({ent})",
        "transition_count": f"CAST({prefix}_c.trans AS DOUBLE)",
        **{f"share_{k}": f"{prefix}_c.s{k}" for k in range(n)},
    }
    return ", ".join(
        f"round(coalesce({v}, 0.0), 10) + 0.0 AS {prefix}_state_{s}" for s, v in values.items()
    )


STATES = (
    state_rows() + ","
    + state_interval("current60", f"t - {MIN60}", "t") + ","
    + state_interval("prior24h", f"t - {MIN60 + 24 * HOUR}", f"(t - {MIN60})") + ","
    + state_interval("prior7d", f"t - {MIN60 + 168 * HOUR}", f"(t - {MIN60})")
)

REPORTS = f"""
reports AS (
  SELECT o_orderkey AS seq, 'c' || CAST(o_custkey AS VARCHAR) AS user_id,
         o_orderdate + to_seconds(o_orderkey % 86400) AS "timestamp",
         CASE WHEN o_orderstatus = 'F' THEN 'streamdeck' ELSE 'other' END AS answer_source,
         {", ".join(f"CASE WHEN (o_orderkey + {i}) % 7 <> 0 THEN round(o_totalprice / 500000 * 6 * {1.0 - i / 20.0!r}, 3) END AS {t}" for i, t in enumerate(TARGETS))}
  FROM orders)"""
