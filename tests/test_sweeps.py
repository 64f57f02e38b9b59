"""Sweeps that read running totals of (user, bin) groups."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from dayloom.functions.state_model import DEFAULT_STATE_MODEL
from dayloom.operators import states as st
from dayloom.operators import window_features as wf
from dayloom.operators.bins import Groups
from tests.helpers import golden


def test_groups_match_a_loop():
    rng = np.random.default_rng(3)
    users = np.sort(rng.choice(["a", "b", "c"], 80)).astype(object)
    users[:9] = None
    p = pd.DataFrame({"user_id": users, "bin": 0})
    p["bin"] = np.where(np.arange(80) % 23 > 11, 1, 0)
    value, marked = rng.integers(-5, 9, 80), rng.random(80) < 0.3
    number = [0]
    for i in range(1, 80):
        number.append(number[-1] + ((users[i], p["bin"][i]) != (users[i - 1], p["bin"][i - 1])))
    of = lambda i: [j for j in range(80) if number[j] == number[i]]
    g = Groups(p)
    upto, whole = g.totals(value, np.arange(80))
    for at in range(80):
        assert upto[at] == sum(value[j] for j in of(at) if j <= at) and whole[at] == sum(value[j] for j in of(at))
        assert g.latest(marked)[at] == max((j for j in of(at) if j <= at and marked[j]), default=-1)
        assert g.next(marked)[at] == min((j for j in of(at) if j >= at and marked[j]), default=-1)


def test_context_is_read_for_marked_keys_alone(spark):
    window, web, inputs, requests = golden(spark)
    keys = wf.request_keys(requests).withColumn("looks_back", F.hour(F.timestamp_micros("req_us")) == 10)
    whole, part = (
        {r["req_us"]: r.asDict() for r in wf.feature_readings(window, web, inputs, k, context=True).collect()}
        for k in (keys.drop("looks_back"), keys)
    )
    first, last = sorted(whole)
    assert part[last] == whole[last] and any(whole[last][c] > 0 for c in wf.CONTEXT_COLUMNS)
    assert {c: part[first][c] for c in wf.CURRENT_COLUMNS} == {c: whole[first][c] for c in wf.CURRENT_COLUMNS}
    assert all(part[first][c] == 0 for c in wf.CONTEXT_COLUMNS)


def test_a_request_without_a_time_keeps_its_row(spark):
    window, web, inputs, requests = golden(spark)
    asked = requests.unionByName(requests.limit(1).withColumn("timestamp", F.lit(None).cast("timestamp_ntz")))
    rows = wf.window_features(window, web, inputs, asked).collect()
    assert len(rows) == 3
    empty = [r for r in rows if r["timestamp"] is None]
    # it is joined with nothing, so what comes by a join is null or zero
    assert len(empty) == 1 and not any(empty[0][c] for c in wf.CURRENT_COLUMNS)


def test_labels_in_batches_match_the_expressions(spark):
    totals = spark.range(400).select(
        F.lit("u").alias("user_id"), F.col("id").alias("hour_no"), (F.col("id") % 7).alias("event_count"),
        *[
            F.when(F.col("id") % 9 == 0, 0).otherwise(F.pmod(F.xxhash64("id", F.lit(u)), F.lit(900_000_000))).cast("bigint").alias(u)
            for u in st._US
        ],
    )
    model = DEFAULT_STATE_MODEL
    table = st.hour_vector(totals, ["user_id", "hour_no"]).filter("_x0 > 0")
    table = st._with_nearest(table, [f"_x{i}" for i in range(len(model.features))], model)
    slow = {r["hour_no"]: (r["i"], r["d"]) for r in table.select("hour_no", "best.*").collect()}
    fast = {r["hour_no"]: (r["state"], r["state_distance_min"]) for r in st._labelled(totals, ["user_id", "hour_no"], model).collect()}
    assert fast.keys() == slow.keys() and len(fast) < 400
    assert all(fast[h][0] == slow[h][0] and abs(fast[h][1] - slow[h][1]) < 1e-12 for h in slow)
