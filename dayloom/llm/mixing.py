"""Mixing sources to target weights: one temperature, bisected, realised by block permutations.

All of it is DataFrame work. The sources' token shares raised to an exponent give the weights;
the exponent is the flattest one that reaches the target entropy without repeating a source more
often than allowed. A weight times the token budget is a source's quota: whole epochs over its
documents, and for the rest blocks in a permuted order until the quota is spent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.llm.common import col, free_name, materialise, words_of

#: Inner points tried in each pass of the bisection: a pass cuts the interval to a sixteenth.
POINTS = 16


@dataclass(frozen=True)
class Mixture:
    """Targets of a mixture. ``entropy`` is a share of the entropy of equal weights (0 to 1)."""

    entropy: float | None = 0.95
    max_repeats: float | None = 3.0
    budget_tokens: int | None = None  # default: as many tokens as the input has
    block_tokens: int = 1 << 20
    passes: int = 5
    seed: int = 7


def token_count(text: Column) -> Column:
    """Words of a text and one end, so that no document is free."""
    return (F.size(words_of(text)) + 1).cast("long")


def row_key(seed: int, doc_id: str, text: str) -> Column:
    """32 hex digits that order documents at random, the same in every run."""
    part = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), part(doc_id), F.lit(":"), part(text)).cast("binary"))


def find_exponent(shares: DataFrame, mixture: Mixture) -> float:
    """The exponent for the given ``share`` column, between 0 (equal weights) and 1 (as they are).

    Entropy falls and the largest repetition rises monotonically on the way: each pass tries
    points of the interval in one aggregate over the sources and keeps the part with the
    crossing. Only the points' totals reach the driver.
    """
    totals = shares.agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).first()
    sources, tokens = totals["n"], totals["t"] or 0
    if sources < 2:
        return 1.0
    budget = mixture.budget_tokens if mixture.budget_tokens is not None else tokens

    def crossing(good) -> float:
        """Largest exponent that is still good, where 0 is good and 1 is not."""
        low, high = 0.0, 1.0
        for _ in range(mixture.passes):
            step = (high - low) / POINTS
            tried = [low + step * k for k in range(1, POINTS)]
            at = F.explode(F.array(*[F.lit(x) for x in tried])).alias("x")
            power = F.exp(F.col("x") * F.log("share"))
            rows = (
                shares.select("share", at)
                .groupBy("x")
                .agg(
                    F.sum(power).alias("z"),
                    F.sum(power * F.log("share")).alias("a"),
                    F.max(power / F.col("share")).alias("r"),
                )
                .selectExpr("x", "log(z) - x * a / z AS entropy", f"r / z * {budget / max(tokens, 1)!r}D AS repeats")
                .collect()
            )
            fine = [r["x"] for r in rows if good(r)]
            low = max([low, *fine])
            high = min([high, *[x for x in tried if x > low]])
        return low

    # each limit is met on one side of its crossing
    exponent = 1.0
    if mixture.entropy is not None:
        import math

        target = mixture.entropy * math.log(sources)
        natural = shares.agg((-F.sum(F.col("share") * F.log("share"))).alias("h")).first()["h"]
        if natural < target:
            exponent = crossing(lambda r: r["entropy"] >= target)
    if mixture.max_repeats is not None and exponent < 1.0:
        limit = max(mixture.max_repeats, budget / max(tokens, 1))
        worst = crossing(lambda r: r["repeats"] > limit)  # repetitions fall as the exponent grows
        exponent = max(exponent, min(1.0, worst + 1.0 / POINTS**mixture.passes) if worst > 0 else exponent)
    return exponent


def mix_sources(
    docs: DataFrame,
    mixture: Mixture = Mixture(),
    source: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The mixture's documents: each row once per epoch it is used in, with ``mix_epoch`` added.

    Also adds ``mix_tokens``, ``mix_weight`` (the source's) and ``mix_exponent``. Rows without a
    source form a source of their own. An epoch that is not whole takes the documents whose
    running count of tokens stays within the rest of the quota, blocks in permuted order, then
    documents in permuted order within the block at the edge. Ties of the permutation (equal
    rows) go by token count. An empty table gives an empty mixture. Clashing names get
    underscores in front.
    """
    seed = mixture.seed
    names = {w: free_name(docs, w) for w in ("mix_epoch", "mix_tokens", "mix_weight", "mix_exponent")}
    given = lambda c: F.col("doc")[c]

    # the row travels as one struct, so its columns meet no other; a missing source is one of its own
    named = F.when(col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), col(source).cast("string")))
    base = docs.select(
        F.struct(*[col(c) for c in docs.columns]).alias("doc"), token_count(col(text)).alias("n"),
        named.alias("s"), row_key(seed, doc_id, text).alias("key"),
    )
    sizes = materialise(
        base.groupBy("s").agg(F.sum("n").alias("tokens")).withColumn(
            "blocks", F.ceil(F.col("tokens") / F.lit(mixture.block_tokens)).cast("long")
        ),
        "mix-sizes",
    )
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    shares = sizes.withColumn("share", F.col("tokens") / F.lit(max(total, 1)))
    exponent = find_exponent(shares, mixture)
    power = F.exp(F.lit(exponent) * F.log("share"))
    z = shares.agg(F.sum(power)).first()[0] or 1.0
    budget = mixture.budget_tokens if mixture.budget_tokens is not None else total
    weight = power / F.lit(z)
    quota = F.floor(weight * F.lit(budget) + F.lit(0.5)).cast("long")
    plan = materialise(
        shares.select("s", "tokens", "blocks", weight.alias("weight"), quota.alias("quota")).selectExpr(
            "s", "blocks", "weight", "quota div tokens AS epochs", "quota % tokens AS rest"
        ),
        "mix-plan",
    )

    # a document's block follows from its key; blocks have about block_tokens tokens each
    of_block = F.pmod(F.conv(F.substring("key", 1, 12), 16, 10).cast("long"), F.col("blocks"))
    placed = base.join(plan, "s").withColumn("b", of_block)
    blocks = placed.groupBy("s", "b").agg(F.sum("n").alias("size"), F.first("rest").alias("rest"))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("s"), F.lit(":"), F.col("b").cast("string")).cast("binary"))
    run = Window.partitionBy("s").orderBy(order, "b").rowsBetween(Window.unboundedPreceding, 0)
    # 'left': what the rest of the quota still has when the block begins
    permuted = materialise(
        blocks.withColumn("left", F.col("rest") - F.sum("size").over(run) + F.col("size")).filter("left > 0").selectExpr(
            "s", "b", "left", "size > left AS edge"
        ),
        "mix-blocks",
    )
    at_edge = permuted.filter("edge").select("s", "b", "left")
    whole = permuted.filter("NOT edge").select("s", "b", F.lit(1).alias("more"))

    def taken(frame: DataFrame, epochs: Column) -> DataFrame:
        return frame.select(
            *[given(c).alias(c) for c in docs.columns],
            F.explode(epochs).alias(names["mix_epoch"]),
            F.col("n").alias(names["mix_tokens"]),
            F.col("weight").alias(names["mix_weight"]),
            F.lit(exponent).alias(names["mix_exponent"]),
        )

    upto = (F.col("epochs") + F.coalesce("more", F.lit(0))).cast("int")
    main = placed.join(whole, ["s", "b"], "left").filter(upto > 0)
    inside = Window.partitionBy("s", "b").orderBy("key", "n").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.join(at_edge, ["s", "b"]).withColumn("upto", F.sum("n").over(inside)).filter("upto <= left")
    return taken(main, F.sequence(F.lit(0), upto - 1)).unionByName(taken(edge, F.array(F.col("epochs").cast("int"))))
