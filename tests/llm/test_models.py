import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from dayloom.llm import language_model as lm
from dayloom.llm import toxicity
from tests.llm.helpers import SCHEMA, awkward, words


def test_base_scores_agree_with_brute_force(spark):
    rows = [(i, words(i, 40, 30).upper() if i % 4 else words(i, 5), "en", "a", 1) for i in range(60)]
    rows += [(60, None, "en", "a", 1), (61, "", "en", "a", 1), (None, "w1x rare" + "y" * 90, "en", "a", 1), (3, rows[3][1], "en", "a", 1)]
    table = spark.createDataFrame(rows, SCHEMA)
    held = F.coalesce(F.col("doc_id"), F.lit(0)) % 5 == 2
    settings = lm.Settings(model_words=20, dictionary_words=25, dimensions=4)
    out = lm.score_documents(table, held, settings=settings).collect()
    split = [((r[0] or 0) % 5 == 2, [*(r[1] or "").lower().split(), ""]) for r in rows]
    counts = Counter(w for h, ws in split if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (h, len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for h, ws in split
    )
    assert sorted((r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out) == expected
    assert {r["train_tokens"] for r in out} == {n} and all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)


def test_probabilities_are_normalised_and_learnt():
    rng = np.random.default_rng(0)
    s = lm.Settings(dimensions=8)
    share = np.full(12, 1 / 12)
    stream = np.arange(60_000) % 11  # each token tells the next
    trainer = lm.Trainer(lm.Parameters.initial(share, s).flat, share, s, 1)
    for a in range(2, 60_000 - s.batch, s.batch):
        trainer.learn(stream[a - 2 : a - 2 + s.batch], stream[a - 1 : a - 1 + s.batch], stream[a : a + s.batch])
    scorer = lm.Scorer(trainer.p.flat, 12, s.dimensions)
    w1, w2 = rng.integers(0, 12, 50), rng.integers(0, 12, 50)
    total = sum(10 ** scorer.log10(w1, w2, np.full(50, k)) for k in range(12))
    assert np.allclose(total, 1, atol=1e-4)
    assert scorer.log10(stream[:-2], stream[1:-1], stream[2:]).mean() > math.log10(1 / 12) + 0.3


def test_model_beats_the_base_on_held_out_text(spark):
    rng = random.Random(7)

    def text(seed):
        out, w = [], rng.randrange(40)
        for _ in range(300):
            w = (w * 3 + rng.randrange(3)) % 40
            out.append(f"t{w}")
        return " ".join(out)

    table = spark.createDataFrame([(i, text(i)) for i in range(250)], "doc_id long, text string").repartition(2)
    settings = lm.Settings(batch=128, rate=0.2, rounds=2)
    rows = lm.score_documents(table, F.col("doc_id") % 5 == 0, settings=settings).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows) + 10 * len(rows)


def test_awkward_rows_and_no_training(spark):
    table = awkward(spark)
    assert lm.score_documents(table, F.lit(False)).count() == table.count()
    none = lm.score_documents(table, F.lit(True)).collect()
    assert {r["train_tokens"] for r in none} == {0} and all(abs(r["base_score"]) < 1e-9 and r["n_known"] == 0 for r in none)
    assert lm.score_documents(table.filter("false"), F.lit(False)).count() == 0


def test_toxic_words_raise_the_score(spark):
    rng = random.Random(3)
    bad = ["idiot", "moron", "scum", "trash", "loser"]

    def text(i):
        w = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(120)]
        if i % 4 == 0:
            for _ in range(6):
                w[rng.randrange(120)] = rng.choice(bad)
        return " ".join(w)

    docs = spark.createDataFrame([(i, text(i), "own") for i in range(1200)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1200)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, labels, F.col("id") % 3 != 2).filter("doc_id % 3 = 2").collect()
    right = sum((r["predicted"] == 1) == (r["doc_id"] % 4 == 0) for r in out)
    assert right > 0.9 * len(out) and all(0 <= r["_score"] <= 1 for r in out)


def test_labels_that_may_not_be_used_change_no_score(spark):
    rng = random.Random(5)
    texts = [(i, words(i, 60) + (" vile scum rotten" if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame([*texts, (None, None)], "doc_id long, text string")
    used = [(i, int(i % 4 == 0)) for i in range(400) if i % 3 != 2]
    scores = []
    for held in (0, 1, None):
        rest = [(i, rng.randrange(2) if held is None else held) for i in range(400) if i % 3 == 2]
        labels = spark.createDataFrame(used + rest, "doc_id long, toxic int")
        out = toxicity.score_toxicity(docs, labels, F.col("id") % 3 != 2).collect()
        scores.append(sorted((r["doc_id"] or -1, r["score"]) for r in out))
    assert scores[0] == scores[1] == scores[2] and len(set(s for _, s in scores[0])) > 10


def test_toxicity_of_awkward_rows(spark):
    table = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score_toxicity(table, none, F.lit(True))
    assert out.columns == [*table.columns, "_score", "_predicted"]
    assert [r["_score"] for r in out.collect()] == [0.0] * table.count()
    labels = spark.createDataFrame([(i, i % 2) for i in range(17)], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(table, labels, F.lit(True)).collect()
    assert len(scored) == table.count() and all(0 <= r["_score"] <= 1 for r in scored)
    assert toxicity.score_toxicity(table.filter("false"), labels, F.lit(True)).count() == 0


def test_windows_cover_the_text():
    s = toxicity.Settings()
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        text = bytes(i % 251 for i in range(n))
        w = toxicity.windows(text, s)
        covered = w[0] + b"".join(x[s.window - s.step :] for x in w[1:])
        assert covered == text
