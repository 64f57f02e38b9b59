"""Small configuration files: category rules, state model, target parameters."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import SparkSession

from dayloom.functions.categories import Rule, rules_from_json
from dayloom.functions.state_model import StateModel
from dayloom.vocab import STATE_FEATURES


def load_rules(path: str | Path) -> tuple[Rule, ...]:
    """The category rules of an installation's own file."""
    return rules_from_json(path)


def load_state_model(path: str | Path) -> StateModel:
    """Features, scaler and centres from JSON; order and shapes are checked."""
    return state_model_of(Path(path).read_text(encoding="utf-8"))


def read_state_model(spark: SparkSession, path: str) -> StateModel:
    """A13 from any file system that Spark reads."""
    return state_model_of(spark.read.text(path, wholetext=True).first()[0])


def state_model_of(text: str) -> StateModel:
    """A state model from its JSON text."""
    payload = json.loads(text)
    model = StateModel(
        features=tuple(payload["feature_columns"]),
        mean=tuple(map(float, payload["scaler"]["mean"])),
        scale=tuple(map(float, payload["scaler"]["scale"])),
        centers=tuple(tuple(map(float, c)) for c in payload["cluster_centers"]),
        names=tuple(payload["state_names"]),
    )
    if list(model.features) != STATE_FEATURES:
        raise ValueError("state model features are not in the supported order")
    if model.n_states != payload["n_states"]:
        raise ValueError("state model n_states does not match its centres")
    return model
