"""Flat trees, the search with fitted models, and the snapshot store."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from dayloom.functions.trees import Forest, forest_of, forest_scorer, load_forest
from dayloom.operators import recourse, scoring
from dayloom.operators.batch_search import recommend_changes_batch
from dayloom.plans.snapshots import SnapshotStore
from dayloom.vocab import ACTION_COLUMNS

NAMES = ["one", "two", "three"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    made = [tuple(rng.choice([0.0, 5.0, rng.uniform(0, 20)]) for _ in NAMES) for _ in range(400)]
    labelled = [(*r, 1.0 if r[0] + rng.uniform(-3, 3) > r[1] else 0.0) for r in made]
    table = spark.createDataFrame(labelled, ", ".join(f"{n} double" for n in NAMES) + ", label double").coalesce(2)
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(table).cache()


@pytest.mark.parametrize("kind", [DecisionTreeRegressor, RandomForestRegressor, GBTRegressor, RandomForestClassifier, GBTClassifier])
def test_flat_trees_score_as_the_fitted_model(spark, rows, tmp_path, kind):
    limits = {"maxIter": 6} if "GBT" in kind.__name__ else {"numTrees": 7} if "Forest" in kind.__name__ else {}
    model = kind(seed=5, maxDepth=4, **limits).fit(rows)
    forest = forest_of(model, NAMES)
    spark.createDataFrame([(forest.to_json(),)], "value string").coalesce(1).write.text(str(tmp_path / "forest"))
    assert load_forest(spark, str(tmp_path / "forest")) == forest
    output = "probability" if "Classifier" in kind.__name__ else "prediction"
    scored = scoring.add_score(rows.drop("features"), scoring.ml_scorer(model, NAMES, output), "want")
    scored = scoring.add_score(scored, forest_scorer(forest), "got", NAMES).collect()
    assert len({r["got"] for r in scored}) > 3
    assert [r["got"] for r in scored] == pytest.approx([r["want"] for r in scored], abs=1e-12)
    matrix = np.array([[r[n] for n in NAMES] for r in scored])
    assert forest.predict(matrix) == pytest.approx([r["want"] for r in scored], abs=1e-12)


def test_missing_features_go_right_and_wrong_forests_are_refused(spark):
    forest = Forest(("x",), (0,), (1.0,), (0, -1, -1), (2.0, 0.0, 0.0), (1, 0, 0), (2, 0, 0), (0.0, 10.0, 20.0))
    table = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,), (float("nan"),)], "x double").coalesce(1)
    assert [r[0] for r in table.select(forest_scorer(forest)({"x": F.col("x")})).collect()] == [10.0, 10.0, 20.0, 20.0, 20.0]
    assert forest.predict(np.array([[1.0], [np.nan]])).tolist() == [10.0, 20.0]
    leaf = Forest((), (0,), (1.0,), (-1,), (0.0,), (0,), (0,), (3.0,))
    assert leaf.predict(np.zeros((2, 0))).tolist() == [3.0, 3.0]
    for change in ({"left": (0, 0, 0)}, {"roots": (3,)}, {"feature": (1, -1, -1)}, {"link": "?"}, {"value": (1.0,)}):
        with pytest.raises(ValueError):
            Forest(**{**forest.__dict__, **change})


def allocations(spark, n=120):
    rng = random.Random(9)
    made = [(k, *[rng.choice([0.0, 4.0, 5.0, 10.0, 25.0]) for _ in ACTION_COLUMNS], rng.uniform(0, 1)) for k in range(n)]
    return spark.createDataFrame(made, "id long, " + ", ".join(f"{c} double" for c in ACTION_COLUMNS) + ", other double").coalesce(3)


def answers(out):
    return {r["id"]: (r["strength"], round(r["projected_probability_high"], 9) if r["projected_probability_high"] is not None else None, [tuple(c) for c in r["changes"]]) for r in out.collect()}


def test_batch_search_gives_the_answers_of_the_column_search(spark):
    table = allocations(spark)
    names = [*ACTION_COLUMNS, "other"]
    weights = {c: (k - 2) / 400 for k, c in enumerate(ACTION_COLUMNS)} | {"other": 0.2}
    linear = scoring.linear_scorer(weights, 0.1)
    based = scoring.add_score(table, linear, "p", names)
    based = based.unionByName(based.filter("id = 1").withColumn("id", F.lit(-1).cast("long")).withColumn("p", F.lit(None).cast("double")))
    vector = np.array([weights[c] for c in names])
    want = answers(recourse.recommend_changes(based, "p", linear, names, keep=["id"]))
    got = answers(recommend_changes_batch(based, "p", lambda: (lambda x: 0.1 + x @ vector), names, keep=["id"]))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len({v[0] for v in got.values()}) == 3
    for k, (_, p, _) in want.items():
        assert got[k][1] == pytest.approx(p, abs=1e-9) if p is not None else got[k][1] is None


def test_fitted_forests_are_searched_alike_by_batch_and_by_columns(spark):
    table = allocations(spark)
    labelled = table.withColumn("label", (F.col(ACTION_COLUMNS[0]) + 20 * F.col("other") > F.col(ACTION_COLUMNS[3]) + 8).cast("double"))
    names = [*ACTION_COLUMNS[:5], "other"]
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(labelled)
    forest = forest_of(RandomForestClassifier(numTrees=5, maxDepth=3, seed=1).fit(ready), names)
    scorer = forest_scorer(forest)
    based = scoring.add_score(table, scorer, "p", names)
    want = answers(recourse.recommend_changes(based, "p", scorer, names, keep=["id"]))
    got = answers(recommend_changes_batch(based, "p", lambda: forest.predict, names, keep=["id"]))
    assert got == want and any(v[2] for v in got.values())
    model = LogisticRegression(maxIter=5).fit(ready)
    predict = lambda x, w=model.coefficients.toArray(), b=model.intercept: 1 / (1 + np.exp(-(x @ w + b)))
    by_model = scoring.add_score(table, scoring.ml_scorer(model, names, "probability"), "p")
    rounds = answers(recourse.recommend_changes_model(by_model, "p", scoring.ml_scorer(model, names, "probability"), "id", keep=["id"]))
    assert {k: v[0] for k, v in answers(recommend_changes_batch(by_model, "p", lambda: predict, names, keep=["id"])).items()} == {k: v[0] for k, v in rounds.items()}


def test_snapshots_are_computed_once(spark, tmp_path):
    table = allocations(spark, 60).withColumns({
        "user_id": F.concat(F.lit("u"), (F.col("id") % 7).cast("string")),
        "timestamp": F.expr("timestamp_ntz'2026-03-01 08:00:00' + make_dt_interval(cast(id % 4 as int), cast(id as int) % 9)"),
    })
    scorer = scoring.linear_scorer({ACTION_COLUMNS[0]: 0.004, "other": 0.1}, 0.2)
    models = {t: (scorer, [ACTION_COLUMNS[0], *ACTION_COLUMNS[1:], "other"]) for t in ("mood", "arousal")}
    store = SnapshotStore(spark, str(tmp_path / "s"), models, "v1")
    assert store.read() is None and store.recommend("mood") is None
    first = table.filter("id < 40")
    assert store.add(first.unionByName(first)) == 40
    assert store.add(first) == 0
    assert store.add(table) == 20
    again = SnapshotStore(spark, str(tmp_path / "s"), models, "v1")
    stored = again.read()
    assert stored.count() == 60 == stored.select("snapshot_id").distinct().count()
    plan = again.recommend("arousal")
    want = recourse.recommend_changes(recourse.snapshots(table, models, "v1"), "p_arousal", *models["arousal"], keep=["snapshot_id"])
    assert {r["snapshot_id"]: r["strength"] for r in plan.collect()} == {r["snapshot_id"]: r["strength"] for r in want.collect()}
    day = dt.date(2026, 3, 2)
    assert all("date=2026-03-01" in f for f in again.read(day, day).inputFiles())
    assert again.read(day, day).count() == 15 and again.read(dt.date(2026, 4, 1)) is None
    assert SnapshotStore(spark, str(tmp_path / "s"), models, "v2").read() is None
