"""Runtime rows, scores and suggestions for all requests."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.functions.categories import DEFAULT_RULES, Rule
from dayloom.functions.numbers import finite_or_null
from dayloom.functions.state_model import DEFAULT_STATE_MODEL, StateModel
from dayloom.functions.target_specs import COMPACT_NORMALIZATION, COMPACT_VERSION, check_specs
from dayloom.functions.times import from_us
from dayloom.functions.text import strip
from dayloom.operators.contract import check_events, feature_problem, normalize_requests, request_problem
from dayloom.operators.history import duplicate_reports, self_report_history
from dayloom.operators.parse import EventTables, malformed_events, parse_events
from dayloom.operators.recourse import recommend_changes, snapshots
from dayloom.operators.scoring import derived_once, prediction_report, salted_lookup, score_all_targets
from dayloom.plans.production import production_readings
from dayloom.functions.history_columns import HISTORY_COLUMNS, RUNTIME_COLUMNS
from dayloom.session import written_once
from dayloom.vocab import HISTORY_SOURCE, TARGETS


class RuntimeRows(NamedTuple):
    """Accepted feature rows, rejected requests with the reason, and invalid input rows."""

    features: DataFrame
    rejected: DataFrame
    problems: DataFrame


def _report_history(requests: DataFrame, reports: DataFrame | None) -> DataFrame:
    """History columns of every request from reports strictly before it."""
    asked = requests.select("user_id", "timestamp").distinct().withColumn("_asked", F.lit(True))
    if reports is None:
        rows = asked.select("*", *[F.lit(None).cast("double").alias(t) for t in TARGETS])
    else:
        given = reports.select(
            "user_id", "timestamp",
            *[
                (finite_or_null(F.col(t).cast("double")) if t in reports.columns else F.lit(None).cast("double")).alias(t)
                for t in TARGETS
            ],
        )
        # a report at the very time of a request is that row's own value: not yet history
        rows = asked.unionByName(given, allowMissingColumns=True).groupBy("user_id", "timestamp").agg(
            F.bool_or("_asked").alias("_asked"), *[F.max(t).alias(t) for t in TARGETS]
        )
    rows = rows.withColumn("answer_source", F.lit(HISTORY_SOURCE))
    return self_report_history(rows).filter("_asked").select("user_id", "timestamp", *HISTORY_COLUMNS)


def _problems(parts: Mapping[str, DataFrame]) -> DataFrame:
    """One row per invalid input row: (source, user_id, problem)."""
    rows = [
        t.filter("problem IS NOT NULL").select(F.lit(n).alias("source"), strip(F.col("user_id").cast("string")).alias("user_id"), "problem")
        for n, t in parts.items()
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def runtime_features(
    events: EventTables,
    requests: DataFrame,
    questionnaires: DataFrame | None = None,
    reports: DataFrame | None = None,
    model: StateModel = DEFAULT_STATE_MODEL,
    malformed: DataFrame | None = None,
) -> RuntimeRows:
    """The 93-column row of every request, as if it were the only one.

    ``questionnaires``: (user_id, timestamp); ``reports``: the same plus the seven
    targets. Nothing at or after a request reaches its row. Every request ends in
    ``features`` or in ``rejected``: a request that cannot be read, one of a user with
    an invalid event, questionnaire or report (also one of ``malformed``: user_id and
    problem), one without activity, one after reports of equal time.
    """
    asked = normalize_requests(requests).select("user_id", "timestamp").distinct()
    asked = written_once(asked.withColumn("reason", request_problem()))
    requests = asked.filter("reason IS NULL").drop("reason")
    prior = requests.filter("false")
    extras = {"questionnaires": questionnaires, "reports": reports}
    checked = {
        n: normalize_requests(t).withColumn("problem", request_problem())
        for n, t in extras.items() if t is not None
    }
    if "reports" in checked:  # prior times, history, copies and problems each read them
        table = checked["reports"]
        checked["reports"] = written_once(table.select(
            "user_id", "timestamp", "problem", *[F.col(t).cast("double").alias(t) for t in TARGETS if t in table.columns]
        ))
    for table in checked.values():
        prior = prior.unionByName(table.filter("problem IS NULL").select("user_id", "timestamp"))
    reports = checked["reports"].filter("problem IS NULL").drop("problem") if "reports" in checked else None
    streams = {n: check_events(t, n) for t, n in zip(events, ("window", "web", "input")) if t is not None}
    window, web, inputs = (
        streams[n].filter("problem IS NULL").drop("problem") if n in streams else None
        for n in ("window", "web", "input")
    )
    problems = _problems({**streams, **checked, **({} if malformed is None else {"raw": malformed})})
    rows = production_readings(window, web, inputs, requests, prior, model, recut=True).withColumn(
        "timestamp", from_us("req_us")
    )
    rows = rows.join(_report_history(requests, reports), ["user_id", "timestamp"], "left")
    wrong = problems.groupBy("user_id").agg(F.min(F.concat("source", F.lit(": "), "problem")).alias("_wrong"))
    rows = salted_lookup(rows, wrong, "user_id", ["timestamp"], requests)
    reason = F.coalesce(
        F.col("_wrong"),
        F.when(
            F.col("total_active_minutes") <= 0,
            F.lit("no window or web activity in the current 60-minute window"),
        ),
    )
    if reports is not None:
        twice = duplicate_reports(reports).groupBy("user_id").agg(F.min("timestamp").alias("_twice"))
        rows = salted_lookup(rows, twice, "user_id", ["timestamp"], requests)
        reason = F.coalesce(
            reason, F.when(F.col("_twice") < F.col("timestamp"), F.lit("self-reports need unique times"))
        )
    rows = rows.withColumn("reason", reason)
    unread = asked.filter("reason IS NOT NULL")
    return RuntimeRows(
        rows.filter("reason IS NULL").select(*RUNTIME_COLUMNS),
        rows.filter("reason IS NOT NULL").select("user_id", "timestamp", "reason").unionByName(unread),
        problems,
    )


def runtime_features_from_raw(
    raw: DataFrame,
    requests: DataFrame,
    questionnaires: DataFrame | None = None,
    reports: DataFrame | None = None,
    rules: tuple[Rule, ...] = DEFAULT_RULES,
    model: StateModel = DEFAULT_STATE_MODEL,
) -> RuntimeRows:
    """J4 from raw tracker events (see :mod:`dayloom.sources.buckets`)."""
    return runtime_features(
        parse_events(raw, rules), requests, questionnaires, reports, model, malformed_events(raw)
    )


def _with_bad_feature(features: DataFrame, models: Mapping[str, tuple]) -> DataFrame:
    """B8 over the features of all targets as ``_bad``: missing values pass, an infinite one has its name.

    """
    check_specs([spec for spec, _ in models.values()])
    used = sorted({f for spec, _ in models.values() for f in spec.features})
    return features.select("*", derived_once(feature_problem(features, used, allow_missing=True)).alias("_bad"))


def unscorable(features: DataFrame, models: Mapping[str, tuple]) -> DataFrame:
    """The rows that no model is given, as (user_id, timestamp, reason)."""
    bad = _with_bad_feature(features, models).filter("_bad IS NOT NULL")
    return bad.select("user_id", "timestamp", F.concat(F.lit("infinite feature: "), "_bad").alias("reason"))


def score_requests(
    features: DataFrame,
    models: Mapping[str, tuple],
    model_version: str = COMPACT_VERSION,
    normalization: str = COMPACT_NORMALIZATION,
    standardize=None,
) -> DataFrame:
    """One prediction report per runtime row; ``models``: target -> (spec, scorer).

    Rows with an infinite feature have no report: they are those of :func:`unscorable`.
    """
    usable = _with_bad_feature(features, models).filter("_bad IS NULL").drop("_bad")
    scored = score_all_targets(usable, models, standardize)
    return prediction_report(scored, [spec for spec, _ in models.values()], model_version, normalization)


def recommend(
    features: DataFrame, models: Mapping[str, tuple], target: str, model_version: str
) -> DataFrame:
    """Snapshot of all baselines, then one suggestion per request for ``target``.

    ``models``: target -> (column scorer, features).
    """
    scorer, used = models[target]
    table = snapshots(features, models, model_version)
    return recommend_changes(
        table, f"p_{target}", scorer, used, keep=["user_id", "timestamp", "snapshot_id"]
    ).withColumn("target", F.lit(target))
