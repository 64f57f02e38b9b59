"""Row checks for proposed reallocations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.vocab import (
    ACTION_WINDOW_MINUTES,
    ACTIONABLE_COLUMNS,
    BUDGET_TOLERANCE,
    IMMUTABLE_COLUMNS,
)


def _number(table: DataFrame, name: str, qualified: Column | None = None) -> Column:
    """The column as a number; an absent column counts as 0."""
    if name not in table.columns:
        return F.lit(0.0)
    return (F.col(name) if qualified is None else qualified).cast("double")


def time_budget_ok(table: DataFrame, deltas: dict[str, Column]) -> Column:
    """Zero-sum, no negative category, and within 60 minutes less AFK time."""
    moves = list(deltas.values())
    total = sum(moves[1:], moves[0])
    after = [
        _number(table, c) + (deltas[c].cast("double") if c in deltas else F.lit(0.0))
        for c in ACTIONABLE_COLUMNS
    ]
    afk = "minutes_afk" if "minutes_afk" in table.columns else "afk_minutes"
    return (
        (F.abs(total) <= BUDGET_TOLERANCE)
        & (F.least(*after) >= -BUDGET_TOLERANCE)
        & (sum(after[1:], after[0]) <= ACTION_WINDOW_MINUTES - _number(table, afk) + BUDGET_TOLERANCE)
    )


def validate_counterfactual(original: DataFrame, modified: DataFrame, key: list[str]) -> DataFrame:
    """Match on ``key`` and add ``violation`` (NULL when every rule holds).

    A row without a partner on the other side is a violation too.
    """
    joined = original.withColumn("_in", F.lit(True)).alias("o").join(
        modified.withColumn("_in", F.lit(True)).alias("m"),
        [F.col(f"o.{k}").eqNullSafe(F.col(f"m.{k}")) for k in key], "full",
    )
    get = lambda side, table, c: (
        F.col(f"{side}.{c}").cast("double") if c in table.columns else F.lit(0.0)
    )
    fixed = [
        F.when(
            ~F.col(f"o.{c}").eqNullSafe(F.col(f"m.{c}")), F.lit(f"immutable feature modified: {c}")
        )
        for c in IMMUTABLE_COLUMNS
        if c in original.columns and c in modified.columns and c not in key
    ]
    old = [get("o", original, c) for c in ACTIONABLE_COLUMNS]
    new = [get("m", modified, c) for c in ACTIONABLE_COLUMNS]
    total_old, total_new = sum(old[1:], old[0]), sum(new[1:], new[0])
    violation = F.coalesce(
        F.when(F.col("m._in").isNull(), F.lit("row missing from the modified table")),
        F.when(F.col("o._in").isNull(), F.lit("row missing from the original table")),
        *fixed,
        F.when(F.abs(total_new - total_old) > BUDGET_TOLERANCE, F.lit("not zero-sum")),
        *[
            F.when(v < -BUDGET_TOLERANCE, F.lit(f"negative minutes: {c}"))
            for c, v in zip(ACTIONABLE_COLUMNS, new)
        ],
        F.when(total_new > ACTION_WINDOW_MINUTES + BUDGET_TOLERANCE, F.lit("exceeds the window")),
    )
    return joined.select(*[F.coalesce(F.col(f"o.{k}"), F.col(f"m.{k}")).alias(k) for k in key], violation.alias("violation"))
