"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a Spark expression over the whole text, so a rule set runs as a narrow
projection of the scan: no shuffle, no user function, nothing kept between rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import SPACE, SPACE_CHARS, col, free_name, let, words_of

#: Frequent function words of the four languages; case matters in a lookup, so both forms count.
STOP_WORDS = (
    "the of and to in a is that it for on was as with be by are this at from an or "
    "der die das und zu den von mit sich des auf ist im dem nicht ein eine als auch "
    "le la les de des et en un une du que est pour qui dans sur par avec pas ce il au "
    "el los las y del se con para una su lo no al es como más "
).split()


@dataclass(frozen=True)
class Rule:
    """The closed range a measure, or its ratio to another measure, must lie in."""

    name: str
    measure: str
    per: str | None = None
    low: float | None = None
    high: float | None = None


#: Base part of the verdict: too short, or too much of the text repeats itself.
BASE_RULES = (
    Rule("n_words", "n_words", low=10),
    Rule("repeated_words", "n_repeat_words", "n_words", high=0.2),
)
#: The method's rules.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=2, high=14),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("letterless_words", "n_letterless_words", "n_words", high=0.3),
    Rule("capitals", "n_capitals", "word_chars", high=0.4),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.3),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=0.3),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=0.9),
)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 5-word window found twice or more in the text, the first included.

    Windows are compared by a 64-bit hash. Only a text with an equal pair sorts its windows.
    """
    hashes = let(
        words,
        lambda w: F.when(
            F.size(w) > 5,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 5),
                lambda i: F.xxhash64(*[w[i + k] for k in range(5)]),
            ),
        ),
    )

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(starts, k + 1) - x, F.lit(5))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    def repeated(sorted_windows: Column) -> Column:
        def marked(x, k):
            same = lambda other: F.coalesce(F.get(sorted_windows, other)["h"] == x["h"], F.lit(False))
            return F.when(same(k - 1) | same(k + 1), x["i"])

        return F.sort_array(F.array_compact(F.transform(sorted_windows, marked)))

    def count(h: Column) -> Column:
        indexed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(let(indexed, repeated), covered)
        )

    return F.coalesce(let(hashes, count), F.lit(0).cast("long"))


def measures(text: Column) -> dict[str, Column]:
    """All measures of a text; a null text measures like an empty one."""
    text = F.coalesce(text, F.lit(""))
    words = words_of(text)
    both_forms = sorted({f for w in STOP_WORDS for f in (w, w.capitalize())})
    length = lambda t: F.length(t).cast("long")
    size = lambda a: F.size(a).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    return {
        "n_words": size(words),
        "word_chars": length(F.translate(text, SPACE_CHARS, "")),
        "n_symbols": length(text) - length(F.translate(text, "#*$%&|<>", "")),
        "n_capitals": length(text) - length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
        "n_letterless_words": F.regexp_count(
            text, F.lit(rf"(?<![^{SPACE}])[^{SPACE}\p{{L}}]+(?![^{SPACE}])")
        ).cast("long"),
        "n_stop_words": size(F.filter(words, lambda w: w.isin(both_forms))),
        "n_lines": size(lines),
        "n_dup_lines": let(lines, lambda x: size(x) - size(F.array_distinct(x))),
        "n_ellipsis_lines": size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))),
        "n_bullet_lines": size(F.filter(lines, lambda x: x.rlike(rf"^[{SPACE}]*[-*•]"))),
        "n_repeat_words": _repeat_words(words),
    }


def _violated(rule: Rule, struct: str) -> Column:
    value = F.col(f"`{struct}`.{rule.measure}")
    if rule.per:
        value = F.try_divide(value, F.col(f"`{struct}`.{rule.per}"))
    out = F.lit(False)
    if rule.low is not None:
        out = out | (value < rule.low)
    if rule.high is not None:
        out = out | (value > rule.high)
    return F.coalesce(out, F.lit(False))


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    rules: Sequence[Rule] = RULES,
    base_rules: Sequence[Rule] = BASE_RULES,
    result: str = "quality",
) -> DataFrame:
    """Add a struct with all measures, ``failed`` rule names, ``base_failed`` and ``kept``.

    A null or empty text has no words and fails the base rules; a ratio to zero breaks no rule.
    The table's own columns stay as they are, repeated rows too. If it has a column called
    ``result`` already, the struct's name gets underscores in front (it is the last column).
    """
    name = free_name(docs, result)
    measured = docs.withColumn(name, F.struct(*[c.alias(n) for n, c in measures(col(text)).items()]))

    def failed(group: Sequence[Rule]) -> Column:
        return F.array_compact(F.array(*[F.when(_violated(r, name), F.lit(r.name)) for r in group]))

    return measured.withColumn(
        name,
        F.struct(
            F.col(f"`{name}`.*"),
            F.concat(failed(base_rules), failed(rules)).alias("failed"),
            (F.size(failed(base_rules)) > 0).alias("base_failed"),
            (F.size(failed([*base_rules, *rules])) == 0).alias("kept"),
        ),
    )
