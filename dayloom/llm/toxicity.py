"""Toxicity by compression distance: two zstandard dictionaries, one window at a time.

A dictionary is trained on ordinary text and another on the toxic side: the words that a bound
on their log odds (lower by two standard errors) puts there. A window is compressed twice, with
the ordinary dictionary and with the toxic one in front of it; what the toxic dictionary saves
is the window's gain. Thresholded gains of all windows of a text give a score by logistic
calibration on labelled documents that trained no dictionary.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import bounded_batches, col, free_name


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit and parameters of the method."""

    sample_docs: int = 6000  # labelled documents of each class that are fitted, about, at most
    sample_chars: int = 20_000  # longer documents are left out of the sample (not of the scoring)
    window: int = 64
    step: int = 48
    toxic_bytes: int = 8 << 10
    ordinary_bytes: int = 32 << 10
    log_odds: tuple[float, ...] = (1.5, 2.0, 2.5, 3.0)  # the best on the calibration part is kept
    training_windows: int = 60_000
    seed: int = 3


def windows(text: bytes, s: Settings) -> list[bytes]:
    """Overlapping windows that cover the whole text; one empty window for an empty text."""
    last = max(0, len(text) - s.window + s.step - 1) // s.step
    return [text[k * s.step : k * s.step + s.window] for k in range(last + 1)]


def compressor(content: bytes):
    """Length of a compressed window given a dictionary's content."""
    import zstandard

    settings = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=16, hash_log=15, search_log=4, min_match=4,
        strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary's bytes; too few samples to train on are used as they are."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def features(text: bytes, ordinary, toxic, s: Settings) -> list[float]:
    """What a text's windows gain: the largest, the mean, and how many pass the thresholds."""
    gain = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text, s)], dtype=float)
    top = np.sort(gain)[::-1]
    n = len(gain)
    counts = [float((gain >= limit).sum()) for limit in (3, 5, 8)]
    return [
        min(top[0], 12.0), top[:3].sum() / 3, top[: max(1, n // 4)].mean(), gain.mean(), math.log(n),
        *[math.log1p(c) for c in counts], counts[0] / n, counts[1] / n,
    ]


@dataclass
class Model:
    """Two dictionaries' contents and the calibration; about 45 kB, whatever the corpus."""

    settings: Settings
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scorer(self):
        ordinary, toxic = compressor(self.ordinary), compressor(self.toxic + self.ordinary)

        def score(text: str | None) -> float:
            x = (np.array(features((text or "").lower().encode(), ordinary, toxic, self.settings)) - self.mean) / self.scale
            return float(1 / (1 + math.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30))))

        return score


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 30) -> np.ndarray:
    """Newton's method on the penalised likelihood; the last weight is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
    return w


def fit(texts: list[str], labels: list[int], s: Settings = Settings(), odds: float | None = None) -> Model:
    """Fit on a bounded sample; every third document calibrates, the others train dictionaries.

    ``odds`` are those of label 1 among all labelled rows: the sample has other ones.
    """
    random_ = random.Random(s.seed)
    lowered = [(t or "").lower().encode() for t in texts]
    y = np.array(labels, dtype=float)
    part = np.arange(len(y)) % 3 == 0
    with_word, docs = {0: Counter(), 1: Counter()}, {0: 0, 1: 0}
    for text, label, calibrates in zip(lowered, labels, part, strict=True):
        if not calibrates:
            with_word[label].update(set(text.split()))
            docs[label] += 1

    def bound(word: bytes) -> float:
        a, b = with_word[1][word] + 0.5, with_word[0][word] + 0.5
        return math.log(a / (docs[1] + 1) * (docs[0] + 1) / b) - 2 * math.sqrt(1 / a + 1 / b)

    plain = [w for t, label, c in zip(lowered, labels, part, strict=True) if not c and not label for w in windows(t, s)]
    random_.shuffle(plain)
    ordinary = trained(plain[: s.training_windows], s.ordinary_bytes)
    bounds = {w: bound(w) for w in with_word[1]}
    best = None
    for limit in s.log_odds:
        marked = [
            w for t, label, c in zip(lowered, labels, part, strict=True) if not c and label
            for w in t.split() if bounds[w] > limit
        ]
        random_.shuffle(marked)
        samples = [b" " + b" ".join(marked[k : k + 6]) + b" " for k in range(0, len(marked), 6)][: s.training_windows]
        toxic = trained(samples, s.toxic_bytes)
        a, b = compressor(ordinary), compressor(toxic + ordinary)
        x = np.array([features(t, a, b, s) for t, c in zip(lowered, part, strict=True) if c]).reshape(-1, 10)
        mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(10), np.ones(10))
        z = (x - mean) / scale
        # each half is judged by the other's weights
        loss, half = 0.0, np.arange(len(z)) % 2
        for k in (0, 1):
            w = _logistic(z[half == k], y[part][half == k])
            p = 1 / (1 + np.exp(-np.clip(np.c_[z[half != k], np.ones((half != k).sum())] @ w, -30, 30)))
            target = y[part][half != k]
            loss -= (target * np.log(p + 1e-12) + (1 - target) * np.log(1 - p + 1e-12)).sum()
        if best is None or loss < best[0]:
            best = (loss, Model(s, ordinary, toxic, mean, scale, _logistic(z, y[part])))
    if odds is not None:
        best[1].weights[-1] += math.log(odds * (len(y) - y.sum()) / y.sum())
    return best[1]


def labelled_sample(
    docs: DataFrame, labels: DataFrame, use: Column, s: Settings, doc_id: str, text: str, label: str
) -> tuple[list[str], list[int], dict[int, int]]:
    """About ``sample_docs`` documents of each class at most, those with the smallest hashed ids.

    Also the number of labelled documents of each class, all counted.
    """
    marked = (
        labels.filter(col(label).isNotNull() & col(doc_id).isNotNull())
        .groupBy(col(doc_id).alias("id")).agg(F.max((col(label) > 0).cast("int")).alias("label"))
        .filter(use)
    )
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    # bounded: about 2 x sample_docs ids, and their texts of at most sample_chars
    order = F.xxhash64("id")
    share = {k: min(1.0, s.sample_docs / max(1, counts.get(k, 0))) for k in (0, 1)}
    limit = F.when(F.col("label") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30)))
    ids = F.broadcast(marked.filter(F.pmod(order, F.lit(1 << 30)) < limit))
    rows = (
        docs.select(col(doc_id).alias("id"), col(text).alias("text"))
        .filter(F.length("text") <= s.sample_chars).join(ids, "id")
        .groupBy("id").agg(F.max("text").alias("text"), F.max("label").alias("label"))
        .orderBy(order, "id").collect()
    )
    return [r["text"] for r in rows], [r["label"] for r in rows], counts


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    use: Column,
    threshold: float = 0.3,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    settings: Settings = Settings(),
) -> DataFrame:
    """Add ``score`` and ``predicted`` to every document.

    ``use`` says, over the column ``id``, which labelled rows may be learnt from. Null text is
    scored like an empty one. Without labelled rows of both classes every document gets the
    share of toxic labels seen (0 with none). Repeated rows keep their own scores; the new names
    get underscores in front where the table has them.
    """
    bounded_batches(docs.sparkSession)
    texts, marks, counts = labelled_sample(docs, labels, use, settings, doc_id, text, label)
    score_name, predicted_name = free_name(docs, "score"), free_name(docs, "predicted")
    if len(set(marks)) < 2 or min(sum(marks), len(marks) - sum(marks)) < 3:
        scored = docs.withColumn(score_name, F.lit(sum(marks) / max(1, len(marks))).cast("double"))
    else:
        model = fit(texts, marks, settings, odds=counts[1] / counts[0])

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            one = model.scorer()
            for batch in batches:
                yield pd.Series([one(t) for t in batch], dtype=float)

        scored = docs.withColumn(score_name, score(col(text)))
    return scored.withColumn(predicted_name, (col(score_name) >= threshold).cast("int"))
