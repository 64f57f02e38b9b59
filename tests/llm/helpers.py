"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Documents with every awkward case; ids 0 to 9 are ordinary."""
    texts = {i: f"The story of the {words(i, 60)} and it was." for i in range(10)}
    rows = [(i, t, "en", "a" if i % 3 else "b", len(t)) for i, t in texts.items()]
    rows += [
        (10, None, "en", "a", None), (11, "", None, "a", 0), (12, "   \n\t ", "en", None, 6),
        (None, texts[1], "en", "a", 1), (13, texts[2], None, None, None), (13, texts[2], None, None, None),
        (14, words(5, 12_000), "en", "b", 1), (15, "x" * 50_000, "en", "b", 1),
        (16, "é ñ ß 漢字 \u0000 🙂 " * 20, "de", "c", 1),
    ]
    return rows


def awkward(spark):
    """The rows with a clashing column for every name the operators would add."""
    table = spark.createDataFrame(awkward_rows(), SCHEMA)
    for name in ("quality", "overlaps", "score", "predicted", "host", "verdict", "mix_epoch", "row", "fp", "s", "b", "rest"):
        table = table.selectExpr("*", f"'own' AS `{name}`")
    return table


def on_disk(table, path):
    table.write.parquet(str(path))
    return table.sparkSession.read.parquet(str(path))
