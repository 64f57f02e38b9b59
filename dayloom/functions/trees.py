"""Tree ensembles as flat arrays: read from JSON or a fitted model, walked by expressions or by numpy.

A node is a place in five arrays: ``feature`` (-1 for a leaf), ``threshold``, ``left``, ``right``
(places), ``value``. A row goes left where its feature is at most the threshold; a missing feature
goes right, as NaN does in ``pyspark.ml``. The raw output is ``intercept`` plus the weighted leaf
values of all trees; ``link`` turns it into the prediction.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LINKS = ("identity", "logistic2")  # logistic2: 1 / (1 + exp(-2 raw)), of boosted classifiers


@dataclass(frozen=True)
class Forest:
    """Trees over named features; ``roots`` are places of the nodes."""

    features: tuple[str, ...]
    roots: tuple[int, ...]
    weights: tuple[float, ...]
    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    value: tuple[float, ...]
    intercept: float = 0.0
    link: str = "identity"

    def __post_init__(self) -> None:
        n = len(self.feature)
        if any(len(x) != n for x in (self.threshold, self.left, self.right, self.value)):
            raise ValueError("the arrays of a forest need one length")
        if len(self.roots) != len(self.weights) or any(not 0 <= r < n for r in self.roots):
            raise ValueError("every root needs a weight and a node")
        if self.link not in LINKS:
            raise ValueError(f"unknown link {self.link!r}")
        for at, (f, a, b) in enumerate(zip(self.feature, self.left, self.right, strict=True)):
            if f >= len(self.features):
                raise ValueError(f"node {at} asks for feature {f}")
            if f >= 0 and not (at < a < n and at < b < n):
                raise ValueError(f"node {at} needs children after itself")  # so every walk ends

    @property
    def depth(self) -> int:
        """Steps of the longest walk."""
        steps = [0] * len(self.feature)
        for at in range(len(steps) - 1, -1, -1):
            if self.feature[at] >= 0:
                steps[at] = 1 + max(steps[self.left[at]], steps[self.right[at]])
        return max((steps[r] for r in self.roots), default=0)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Forest:
        given = json.loads(text)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """Predictions of a matrix with a column for each feature, all trees a level at a time."""
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right, value = np.array(self.left), np.array(self.right), np.array(self.value)
        raw = np.full(len(rows), self.intercept)
        every = np.arange(len(rows))
        for root, weight in zip(self.roots, self.weights, strict=True):
            at = np.full(len(rows), root)
            for _ in range(self.depth):
                asked = feature[at]
                inner = asked >= 0
                if not inner.any():
                    break
                goes_left = rows[every, np.maximum(asked, 0)] <= threshold[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            raw += weight * value[at]
        return raw if self.link == "identity" else 1.0 / (1.0 + np.exp(-2.0 * raw))


def load_forest(spark: SparkSession, path: str) -> Forest:
    """A forest from a JSON file that Spark can read."""
    return Forest.from_json(spark.read.text(path, wholetext=True).first()[0])


def forest_scorer(forest: Forest) -> Callable[[Mapping[str, Column]], Column]:
    """The forest as a column scorer: array look-ups, no Python; its size is that of the arrays."""

    def literal(values, kind: str) -> Column:
        return F.expr("array(" + ", ".join(f"{float(v)!r}D" if kind == "D" else str(int(v)) for v in values) + ")")

    def score(columns: Mapping[str, Column]) -> Column:
        nan = F.lit(float("nan"))
        row = F.array(*[F.coalesce(columns[f].cast("double"), nan) for f in forest.features])
        feature, left, right = (literal(x, "I") for x in (forest.feature, forest.left, forest.right))
        threshold, value = literal(forest.threshold, "D"), literal(forest.value, "D")
        steps = F.sequence(F.lit(1), F.lit(max(1, forest.depth)))

        def step(at: Column, _) -> Column:
            asked = F.get(feature, at)
            goes_left = F.get(row, F.greatest(asked, F.lit(0))) <= F.get(threshold, at)
            return F.when(asked < 0, at).when(goes_left, F.get(left, at)).otherwise(F.get(right, at))

        trees = F.arrays_zip(literal(forest.roots, "I").alias("r"), literal(forest.weights, "D").alias("w"))
        raw = F.aggregate(
            trees, F.lit(float(forest.intercept)),
            lambda total, t: total + t["w"] * F.get(value, F.aggregate(steps, t["r"], step)),
        )
        return raw if forest.link == "identity" else 1.0 / (1.0 + F.exp(-2.0 * raw))

    return score


def forest_of(model, features: list[str]) -> Forest:
    """A fitted ``pyspark.ml`` tree, random forest or boosted ensemble as flat arrays.

    Classifiers give the probability of class 1; splits have to be continuous ones.
    """
    name = type(model).__name__
    trees = model.trees if hasattr(model, "trees") else [model]
    classifies, boosted = "Classif" in name, name.startswith("GBT")
    weights = list(model.treeWeights) if boosted else [1.0 / len(trees)] * len(trees)
    arrays = {k: [] for k in ("feature", "threshold", "left", "right", "value")}

    def leaf_value(node) -> float:
        if classifies and not boosted:
            stats = list(node.impurityStats().stats())
            return stats[1] / sum(stats) if len(stats) > 1 and sum(stats) else 0.0
        return node.prediction()

    def add(node) -> int:
        at = len(arrays["feature"])
        if node.subtreeDepth() == 0:
            cells = (-1, 0.0, 0, 0, leaf_value(node))
        else:
            split = node.split()
            if not hasattr(split, "threshold") or "Continuous" not in split.getClass().getSimpleName():
                raise ValueError("only continuous splits can be laid flat")
            cells = (split.featureIndex(), split.threshold(), 0, 0, 0.0)
        for k, v in zip(arrays, cells, strict=True):
            arrays[k].append(v)
        if node.subtreeDepth():
            arrays["left"][at] = add(node.leftChild())
            arrays["right"][at] = add(node.rightChild())
        return at

    roots = [add(tree._call_java("rootNode")) for tree in trees]
    link = "logistic2" if boosted and classifies else "identity"
    return Forest(tuple(features), tuple(roots), tuple(weights), *(tuple(v) for v in arrays.values()), link=link)
