"""Standardisation, target scores and reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.functions.numbers import finite_or_null, is_finite
from dayloom.functions.target_specs import TargetSpec
from dayloom.functions.history_columns import history_name
from dayloom.vocab import HIGH_THRESHOLD, TARGET_TITLES, WINDOW_MINUTES

# A scorer turns named feature columns into one raw prediction column.
ColumnScorer = Callable[[Mapping[str, Column]], Column]
#: A key with more rows than this is spread over tasks; at most so many keys are.
HOT_ROWS, MOST_HOT = 100_000, 1024


@dataclass(frozen=True)
class TableScorer:
    """Adds the raw prediction as a column of a given name (pyspark.ml models)."""

    add: Callable[[DataFrame, str], DataFrame]

    def __call__(self, table: DataFrame, name: str) -> DataFrame:
        return self.add(table, name)


def linear_scorer(weights: Mapping[str, float], intercept: float = 0.0) -> ColumnScorer:
    """Weighted sum of features; a missing feature counts as 0."""

    def score(columns: Mapping[str, Column]) -> Column:
        factors = F.expr("array(" + ", ".join(f"{float(w)!r}D" for w in weights.values()) + ")")
        values = F.array(*[columns[name] for name in weights])
        products = F.zip_with(values, factors, lambda v, w: F.coalesce(v, F.lit(0.0)) * w)
        return F.aggregate(products, F.lit(float(intercept)), lambda total, v: total + v)

    return score


def ml_scorer(model, features: list[str], output: str = "prediction") -> TableScorer:
    """Any fitted ``pyspark.ml`` model; for classifiers the probability of class 1 is read."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    def score(table: DataFrame, name: str) -> DataFrame:
        # missing history stays missing: it reaches the model as NaN
        numeric = table.withColumns({f"_f_{f}": F.col(f).cast("double") for f in features})
        assembler = VectorAssembler(
            inputCols=[f"_f_{f}" for f in features], outputCol="_features", handleInvalid="keep"
        )
        used = model.copy({model.getParam("featuresCol"): "_features"})
        out = used.transform(assembler.transform(numeric))
        value = F.col(output)
        if output == "probability":
            value = vector_to_array(value)[1]
        return out.select(*table.columns, value.alias(name))

    return TableScorer(score)


def add_score(table: DataFrame, scorer, name: str, features: list[str] | None = None) -> DataFrame:
    """Add the raw output of either kind of scorer as ``name``."""
    if isinstance(scorer, TableScorer):
        return scorer(table, name)
    return table.withColumn(name, scorer({c: F.col(c) for c in (features or table.columns)}))


def global_standardize(
    table: DataFrame, mean: Mapping[str, float], std: Mapping[str, float]
) -> DataFrame:
    """``(x - mean) / std`` with fixed statistics."""
    return table.withColumns(
        {c: (F.col(c).cast("double") - F.lit(float(mean[c]))) / F.lit(float(std[c])) for c in mean}
    )


def hot_keys(counted: DataFrame, key: str, rows: int = HOT_ROWS) -> DataFrame:
    """Keys with too many rows for one task, as (key, _salts): the tasks each is spread over.

    A key is hot above ``rows`` rows and above the total divided by ``MOST_HOT``, so there are
    fewer than ``MOST_HOT`` of them, with fewer than twice as many salts, at any size. Counts are
    combined before the shuffle; nothing is collected.
    """
    counts = counted.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    share = F.greatest(F.lit(float(rows)), counts.agg(F.sum("_n")).scalar() / F.lit(float(MOST_HOT)))
    return counts.withColumn("_share", share).filter("_n > _share").select(
        key, F.ceil(F.col("_n") / F.col("_share")).cast("int").alias("_salts")
    )


def salted_lookup(
    table: DataFrame, lookup: DataFrame, key: str, spread_by: list[str],
    counted: DataFrame | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join with a one-row-per-key table; hot keys alone are spread over several tasks.

    ``counted`` is any table whose rows are dealt over the keys as those of ``table`` are (a
    cheaper one than ``table``, which is the default). The lookup's row of a hot key is copied
    once per salt, every other row stays single, and null keys, which match nothing, are spread.
    The hot keys are broadcast, being fewer than ``MOST_HOT``. Spark still broadcasts the lookup
    by itself when its measured size is below the threshold.
    """
    hot = F.broadcast(hot_keys(table if counted is None else counted, key, hot_rows))
    place = F.xxhash64(*spread_by)
    salts = F.when(F.col(key).isNull(), MOST_HOT).otherwise(F.coalesce("_salts", F.lit(1)))
    left = table.join(hot, key, "left").withColumn("_salt", F.pmod(place, salts).cast("int")).drop("_salts")
    return left.join(_copied(lookup, hot, key), [key, "_salt"], "left").drop("_salt")


def _copied(lookup: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    salts = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    return lookup.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_salts")


def per_user_standardize(
    table: DataFrame,
    features: list[str],
    user_stats: DataFrame,
    global_mean: Mapping[str, float],
    global_std: Mapping[str, float],
    counted: DataFrame | None = None,
) -> DataFrame:
    """Per-user statistics, else the global ones.

    ``user_stats``: user_id, mean_<f>, std_<f>; one row per known user. ``counted`` as in
    :func:`salted_lookup`.
    """
    stats = user_stats.select(
        "user_id", F.lit(True).alias("_known"),
        *[F.col(f"{s}_{c}").alias(f"_{s}_{c}") for s in ("mean", "std") for c in features],
    )
    joined = salted_lookup(table, stats, "user_id", ["timestamp"], counted)
    pick = lambda s, c, g: F.when(F.col("_known"), F.col(f"_{s}_{c}")).otherwise(F.lit(float(g[c])))
    scaled = {
        c: (F.col(c).cast("double") - pick("mean", c, global_mean)) / pick("std", c, global_std)
        for c in features
    }
    return joined.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in table.columns])


def finish_score(spec: TargetSpec, raw: Column, history_mean: Column | None) -> Column:
    """I5 after the estimator: residual frame, blending towards the baseline, clipping."""
    value = raw
    if spec.prediction_frame == "personal_residual" or spec.gamma < 1.0:
        base = F.coalesce(finite_or_null(history_mean.cast("double")), F.lit(float(spec.fallback_score)))
        if spec.prediction_frame == "personal_residual":
            value = value + base
        if spec.gamma < 1.0:
            value = base + F.lit(float(spec.gamma)) * (value - base)
    value = F.when(is_finite(value), value).otherwise(
        F.raise_error(F.lit(f"{spec.target}: prediction is not finite")).cast("double")
    )
    if spec.score_range is not None:
        low, high = spec.score_range
        value = F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))
    return value


def score_target(
    table: DataFrame, spec: TargetSpec, scorer, standardize: Callable | None = None,
    name: str | None = None,
) -> DataFrame:
    """Add one clipped target score.

    The estimator sees standardised features; the personal baseline is the raw
    history mean.
    """
    history = history_name(spec.target, "mean")
    needs_base = spec.prediction_frame == "personal_residual" or spec.gamma < 1.0
    work = table.withColumn("_base", F.col(history)) if needs_base else table
    if standardize is not None:
        work = work.withColumns({f"_keep_{c}": F.col(c) for c in spec.features})
        work = standardize(work)
    work = add_score(work, scorer, "_raw", list(spec.features))
    value = finish_score(spec, F.col("_raw"), F.col("_base") if needs_base else None)
    kept = [
        F.col(f"_keep_{c}").alias(c) if standardize is not None and c in spec.features else F.col(c)
        for c in table.columns
    ]
    return work.select(*kept, value.alias(name or spec.target))


def score_all_targets(table: DataFrame, models: Mapping[str, tuple], standardize=None) -> DataFrame:
    """One score column per target; ``models`` maps target -> (spec, scorer)."""
    out = table
    for target, (spec, scorer) in models.items():
        out = score_target(out, spec, scorer, standardize, name=f"score_{target}")
    return out


def probability_high(table: DataFrame, scorer, name: str, features: list[str] | None = None) -> DataFrame:
    """I8: probability of the high class; outside 0..1 or not finite fails the job."""
    out = add_score(table, scorer, "_p", features)
    p = F.col("_p").cast("double")
    safe = F.when(is_finite(p) & p.between(0.0, 1.0), p).otherwise(
        F.raise_error(F.lit(f"{name}: probability outside 0..1")).cast("double")
    )
    return out.select(*table.columns, safe.alias(name))


def state_of(probability: Column) -> Column:
    """``high`` from 0.5 on."""
    return F.when(probability >= HIGH_THRESHOLD, F.lit("high")).otherwise("not_high")


def derived_once(value: Column) -> Column:
    """The value out of a generator, through which Spark pushes no filter.

    A filter that is pushed down names, in place of the value, all that it is derived from, and Spark
    restates it for each renamed column on the way: over many features the plan outgrows the driver.
    """
    return F.explode(F.array(value))


def prediction_report(
    scored: DataFrame, specs: list[TargetSpec], model_version: str, normalization: str
) -> DataFrame:
    """One nested report per request from ``score_<target>`` columns."""
    predictions = F.array(
        *[
            F.struct(
                F.lit(s.target).alias("target"),
                F.lit(TARGET_TITLES[s.target]).alias("title"),
                F.col(f"score_{s.target}").alias("prediction"),
                F.lit(s.model_name).alias("model"),
                F.lit(s.metrics.get("validation_mse")).cast("double").alias("validation_mse"),
                F.lit(s.metrics.get("test_mse")).cast("double").alias("test_mse"),
            )
            for s in specs
        ]
    )
    return scored.select(
        F.lit(3).alias("schema_version"),
        F.col("user_id").alias("participant_id"),
        F.col("timestamp").alias("prediction_timestamp"),
        F.lit(WINDOW_MINUTES).alias("window_minutes"),
        F.lit(model_version).alias("model_version"),
        F.lit(normalization).alias("normalization"),
        # unfolding a column filters by its size
        derived_once(predictions).alias("predictions"),
    )


def content_hash(table: DataFrame, model_version: str, columns: list[str] | None = None) -> Column:
    """H8: stable row id over the model version and every (name, value)."""
    names = columns or table.columns
    body = F.to_json(F.struct(*[F.col(c) for c in names]), {"ignoreNullFields": "false"})
    return F.sha2(F.concat_ws("\n", F.lit(model_version), body), 256)
