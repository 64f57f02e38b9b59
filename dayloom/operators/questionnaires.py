"""Questionnaire answers: validation and the seven derived targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.functions.numbers import is_finite
from dayloom.vocab import ANSWER_RANGES, SCORE_RANGE, TARGETS


def answer_problem() -> Column:
    """NULL for a valid row, else the first column out of range (NULL answers pass)."""
    checks = []
    for name, (low, high) in ANSWER_RANGES.items():
        value = F.col(name).cast("double")
        bad = value.isNotNull() & (~is_finite(value) | ~value.between(low, high))
        checks.append(F.when(bad, F.lit(name)))
    return F.coalesce(*checks)


def validate_answers(answers: DataFrame) -> DataFrame:
    """Add ``answer_problem``."""
    return answers.withColumn("answer_problem", answer_problem())


def composite_targets(answers: DataFrame) -> DataFrame:
    """Seven positive targets; any missing answer makes its targets missing."""
    number = lambda c: F.col(c).cast("double")
    top = SCORE_RANGE[1]
    mood = number("q1_feelings") + 3.0
    engagement = (number("q4_enthusiasm") + number("q5_immersion")) / 2.0
    stress = top - number("q8_stress")
    values = {
        "mood_valence": mood,
        "arousal": number("q2_intensity"),
        "restfulness": top - number("q3_tiredness"),
        "stress_management": stress,
        "productivity": number("q9_productivity"),
        "engagement": engagement,
        "overall_wellbeing": (mood + engagement + stress) / 3.0,
    }
    return answers.select("*", *[values[t].alias(t) for t in TARGETS])
