"""Production features of every request of every user in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.functions.numbers import finite_or_zero
from dayloom.functions.state_model import DEFAULT_STATE_MODEL, StateModel
from dayloom.functions.times import MINUTE_US, from_us, to_us
from dayloom.operators.allocations import action_columns
from dayloom.session import written_once
from dayloom.operators.history import prior_requests
from dayloom.operators.states import state_readings
from dayloom.operators.timeline import activity_union
from dayloom.operators.window_features import (
    CONTEXT_COLUMNS,
    CURRENT_COLUMNS,
    KEY,
    feature_readings,
    request_keys,
)
from dayloom.vocab import ACTIVITY_FEATURES, ROLLING_COLUMNS, WINDOW_MINUTES


def wanted_instants(requests: DataFrame, prior: DataFrame) -> DataFrame:
    """(user_id, for_us, rank, req_us): the request itself (rank 0) and its last three prior times."""
    looked = prior_requests(requests, prior)
    return looked.select(
        "user_id", to_us("timestamp").alias("for_us"),
        F.posexplode(
            F.concat(F.array("timestamp"), F.reverse("prior_times"))
        ).alias("rank", "at"),
    ).select("user_id", "for_us", "rank", to_us("at").alias("req_us"))


def rows_of_readings(table: DataFrame, wanted: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Readings of single instants put together into request rows.

    ``carry`` names further columns of the request's own reading.
    """
    own = [*CURRENT_COLUMNS, *CONTEXT_COLUMNS]
    more = carry or []
    at = lambda rank, c: F.max(F.when(F.col("rank") == rank, F.col(c)))
    rows = table.join(wanted, KEY).groupBy("user_id", "for_us").agg(
        *[at(0, c).alias(c) for c in [*own, *more]],
        at(1, "req_us").alias("_previous_us"),
        *[at(k, c).alias(f"_{k}_{c}") for c in ROLLING_COLUMNS for k in (1, 2, 3)],
    ).withColumnRenamed("for_us", "req_us")
    extra = {
        "minutes_since_prev1_window": F.coalesce(
            (F.col("req_us") - F.col("_previous_us")) / float(MINUTE_US), F.lit(0.0)
        )
    }
    for c in ROLLING_COLUMNS:
        seen = [F.col(f"_{k}_{c}") for k in (3, 2, 1)]
        total = sum((F.coalesce(v, F.lit(0.0)) for v in seen[1:]), F.coalesce(seen[0], F.lit(0.0)))
        count = sum((v.isNotNull().cast("int") for v in seen[1:]), seen[0].isNotNull().cast("int"))
        mean = F.when(count > 0, total / F.nullif(count, F.lit(0))).otherwise(0.0)
        extra[f"rolling_mean_3_{c}"] = mean
        extra[f"current_minus_rolling_mean_3_{c}"] = finite_or_zero(F.col(c)) - mean
    return rows.select(*KEY, *own, *more, *[v.alias(n) for n, v in extra.items()], *action_columns())


def production_readings(
    window: DataFrame,
    web: DataFrame | None,
    inputs: DataFrame | None,
    requests: DataFrame,
    prior: DataFrame,
    model: StateModel = DEFAULT_STATE_MODEL,
    recut: bool = False,
    collapse_copies: bool = True,
) -> DataFrame:
    """All activity features plus ``total_active_minutes``, keyed by (user_id, req_us).

    Features are computed once per distinct instant of requests and prior times.
    Each request then takes its own row and those of its (at most three) prior
    times, so nothing is computed twice and nothing is windowed per user.
    """
    # every family of features probes at these instants: written once, not derived by each
    wanted = written_once(wanted_instants(requests, prior))
    # context is a request's own; its prior times are asked for means of current features
    instants = wanted.groupBy(*KEY).agg((F.min("rank") == 0).alias("looks_back"))
    # overlaps, hours and running hours each read the activity: five scans
    activity = written_once(activity_union(window, web))
    table = feature_readings(
        window, web, inputs, instants, WINDOW_MINUTES, context=True, recut=recut,
        collapse_copies=collapse_copies, activity=activity,
    )
    rows = rows_of_readings(table, wanted)
    states = state_readings(activity, request_keys(requests), model)
    return rows.join(states, KEY)


def production_features(
    window: DataFrame,
    web: DataFrame | None,
    inputs: DataFrame | None,
    requests: DataFrame,
    prior: DataFrame | None = None,
    model: StateModel = DEFAULT_STATE_MODEL,
) -> DataFrame:
    """The contract columns; ``prior`` defaults to the requests themselves."""
    table = production_readings(
        window, web, inputs, requests, requests if prior is None else prior, model
    )
    return table.select("user_id", from_us("req_us").alias("timestamp"), *ACTIVITY_FEATURES)
