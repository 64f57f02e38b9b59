"""The greedy recourse search with a fitted model, a batch of rows at a time.

The model is any function of a numeric matrix: made once a Python worker, it is given the
candidates of all rows of an Arrow batch as one matrix, and all rounds run inside the task. No row
is exploded, nothing is shuffled and there is no job a round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.operators.recourse import found_changes
from dayloom.vocab import (
    ACTION_COLUMNS, EPSILON, GREAT_DELTA, HIGH_THRESHOLD, MAX_STEPS, SLIGHT_DELTA, STEP_MINUTES,
)

Predict = Callable[[np.ndarray], np.ndarray]
#: Candidate rows given to the model at a time.
CANDIDATES = 1 << 18
_SIZE = len(ACTION_COLUMNS)
_PAIRS = np.array([(d, r) for d in range(_SIZE) for r in range(_SIZE) if d != r])
_FOUND = "slight_p double, slight_a array<double>, great_p double, great_a array<double>"


def best_swaps(rows: np.ndarray, now: np.ndarray, at: np.ndarray, predict: Predict, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Score and pair number of the best legal swap of every row; -inf where none is legal.

    ``rows`` are model inputs, ``now`` the seven allocations, ``at`` their places in the inputs (-1
    for one the model does not read). The first pair wins ties.
    """
    legal = now[:, _PAIRS[:, 0]] + EPSILON >= step
    score = np.full(legal.shape, -np.inf)
    who, pair = np.nonzero(legal)
    moved = np.zeros((len(_PAIRS), rows.shape[1]))
    for k, (d, r) in enumerate(_PAIRS.tolist()):
        if at[d] >= 0:
            moved[k, at[d]] -= step
        if at[r] >= 0:
            moved[k, at[r]] += step
    for a in range(0, len(who), CANDIDATES):
        w, p = who[a : a + CANDIDATES], pair[a : a + CANDIDATES]
        score[w, p] = predict(rows[w] + moved[p])
    best = score.argmax(axis=1)
    return score[np.arange(len(rows)), best], best


def search(rows: np.ndarray, now: np.ndarray, at: np.ndarray, baseline: np.ndarray, predict: Predict, step: float, max_steps: int) -> pd.DataFrame:
    """I11 for rows of one batch: the first slight and the first great point of each greedy path."""
    n = len(rows)
    rows, now = rows.copy(), now.copy()
    last, active = baseline.copy(), baseline < HIGH_THRESHOLD
    found = {k: np.full(n, np.nan) for k in ("slight_p", "great_p")}
    kept = {k: [None] * n for k in ("slight_a", "great_a")}
    for _ in range(max_steps):
        who = np.flatnonzero(active)
        if not len(who):
            break
        score, pair = best_swaps(rows[who], now[who], at, predict, step)
        goes = score > last[who] + EPSILON
        active[who[~goes]] = False
        who, score, pair = who[goes], score[goes], pair[goes]
        for column, sign in ((0, -step), (1, step)):
            place = _PAIRS[pair, column]
            now[who, place] += sign
            read = at[place] >= 0
            rows[who[read], at[place[read]]] += sign
        last[who] = score
        gain = score - baseline[who]
        for name, least in (("slight", SLIGHT_DELTA), ("great", GREAT_DELTA)):
            reached = (gain >= least - EPSILON) & np.isnan(found[f"{name}_p"][who])
            for i, s in zip(who[reached].tolist(), score[reached].tolist(), strict=True):
                found[f"{name}_p"][i], kept[f"{name}_a"][i] = s, now[i].tolist()
        active[who[gain >= GREAT_DELTA - EPSILON]] = False
    out = pd.DataFrame({"slight_p": found["slight_p"], "slight_a": kept["slight_a"], "great_p": found["great_p"], "great_a": kept["great_a"]})
    return out.astype({"slight_p": "Float64", "great_p": "Float64"}).mask(out.isna(), None)


def recommend_changes_batch(
    table: DataFrame, baseline: str, make_predict: Callable[[], Predict], features: list[str],
    step: float = STEP_MINUTES, max_steps: int = MAX_STEPS, keep: list[str] | None = None,
) -> DataFrame:
    """I11 with a fitted model: one suggestion per row, as ``recommend_changes`` gives for a column scorer.

    ``make_predict`` runs once a task and returns a function from a matrix (a column for each of
    ``features``, missing values NaN) to probabilities of the high state. ``baseline`` holds the row's
    own probability; rows at 0.5 or more, or without one, are kept as they are and never reach Python's
    search. Other columns than ``keep`` are not returned.
    """
    keep = keep or [c for c in ("user_id", "timestamp") if c in table.columns]
    at = np.array([features.index(c) if c in features else -1 for c in ACTION_COLUMNS])
    inputs = {f"x{k}": F.col(f).cast("double") for k, f in enumerate(features)}
    inputs |= {f"a{k}": F.col(c).cast("double") for k, c in enumerate(ACTION_COLUMNS)}

    @F.pandas_udf(_FOUND)
    def path(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make_predict()
        for batch in batches:
            values = batch.to_numpy(dtype=np.float64, na_value=np.nan)
            x, now, p = values[:, : len(features)], values[:, len(features) : -1], values[:, -1]
            yield search(x, now, at, p, predict, step, max_steps)

    asked = F.col(baseline) < HIGH_THRESHOLD
    given = F.struct(*[v.alias(n) for n, v in inputs.items()], F.col(baseline).cast("double").alias("p"))
    low = table.filter(asked).withColumn("_path", path(given))
    high = table.filter(~F.coalesce(asked, F.lit(False))).withColumn("_path", F.lit(None).cast(f"struct<{_FOUND.replace(' ', ':').replace(',:', ',')}>"))
    return found_changes(low.unionByName(high), keep, baseline)
