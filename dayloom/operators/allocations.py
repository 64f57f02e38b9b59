"""Action allocations: seven minute columns that share a 60-minute window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.functions.numbers import is_finite
from dayloom.vocab import (
    ACTION_COLUMNS,
    ACTION_NAMES,
    ACTION_SOURCES,
    ACTION_WINDOW_MINUTES,
    BUDGET_TOLERANCE,
    EPSILON,
    NEGATIVE_TOLERANCE,
    STEP_MINUTES,
)


def _total(columns: list[Column]) -> Column:
    return sum(columns[1:], columns[0])


def action_columns() -> list[Column]:
    """The 14 ``time_*`` columns folded into 7."""
    return [
        _total([F.coalesce(F.col(s).cast("double"), F.lit(0.0)) for s in sources]).alias(c)
        for c, sources in ACTION_SOURCES.items()
    ]


def allocation_problem(columns: list[str] = ACTION_COLUMNS) -> Column:
    """NULL when valid, else why the allocation is not."""
    values = [F.col(c).cast("double") for c in columns]
    finite = F.lit(True)
    for v in values:
        finite = finite & is_finite(v)
    return (
        F.when(~finite, F.lit("not finite"))
        .when(F.least(*values) < -NEGATIVE_TOLERANCE, F.lit("negative"))
        .when(_total(values) > ACTION_WINDOW_MINUTES + BUDGET_TOLERANCE, F.lit("exceeds the window"))
    )


def action_allocations(table: DataFrame) -> DataFrame:
    """D11 + B14: add the seven columns and ``allocation_problem``."""
    return table.select("*", *action_columns()).withColumn("allocation_problem", allocation_problem())


def swap_scenarios(
    table: DataFrame, step: float = STEP_MINUTES, columns: list[str] = ACTION_COLUMNS
) -> DataFrame:
    """Every legal move of ``step`` minutes, one row per (row, donor, receiver).

    At most 42 rows per input row, in the canonical order ``swap_no``; only the two
    swapped columns change. The pairs are a literal array, so nothing is joined.
    """
    if not step > 0 or step == float("inf"):
        raise ValueError("step must be finite and positive")
    size = len(columns)
    pairs = F.array(
        *[
            F.struct(F.lit(d * size + r).alias("no"), F.lit(d).alias("donor"), F.lit(r).alias("receiver"))
            for d in range(size) for r in range(size) if d != r
        ]
    )
    # a moved column equals its old value plus the signed step of this pair
    legal = F.filter(
        F.transform(
            pairs,
            lambda p: F.struct(
                p["no"].alias("no"), p["donor"].alias("donor"), p["receiver"].alias("receiver"),
                F.get(F.array(*columns), p["donor"]).alias("available"),
            ),
        ),
        lambda p: p["available"] + EPSILON >= step,
    )
    rest = [c for c in table.columns if c not in columns]
    moved = table.withColumn("_swap", F.explode(legal))
    shift = lambda i: (
        F.when(F.col("_swap.donor") == i, -step).when(F.col("_swap.receiver") == i, step).otherwise(0.0)
    )
    return moved.select(
        *rest,
        *[(F.col(c) + shift(i)).alias(c) for i, c in enumerate(columns)],
        F.col("_swap.no").alias("swap_no"),
        F.get(F.array(*[F.lit(c) for c in columns]), F.col("_swap.donor")).alias("donor"),
        F.get(F.array(*[F.lit(c) for c in columns]), F.col("_swap.receiver")).alias("receiver"),
    )


def allocation_changes(
    before: list[str], after: list[str], names: list[str] = ACTION_NAMES
) -> Column:
    """Array of (category, baseline, counterfactual, delta) where minutes differ."""
    items = F.array(
        *[
            F.struct(
                F.lit(n).alias("category"), F.col(b).alias("baseline_minutes"),
                F.col(a).alias("counterfactual_minutes"), (F.col(a) - F.col(b)).alias("delta_minutes"),
            )
            for n, b, a in zip(names, before, after)
        ]
    )
    return F.filter(items, lambda x: F.abs(x["delta_minutes"]) > EPSILON)
