"""The text pipeline: five stages over ``documents``, each written and read by the next.

All stages but the last return the columns of their input and work on every row it kept: the
quality rules drop what they reject, near-duplicate removal keeps one document of each group,
decontamination drops documents that hold a benchmark passage, mixing repeats or leaves out
documents until the sources have their weights. The last writes token ids and returns, per
document, what reading the files back gives. Null and empty texts fail the quality rules; an
empty table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm import decontamination, mixing, quality, simhash, tokens
from dayloom.llm.common import col, materialise, table

#: Near duplicates: sets of 5-word shingles with a similarity of 0.8; of such pairs about one in
#: 100,000 or fewer lies beyond 26 of 64 bits, and three in a million share none of eight min-hashes.
NEAR = {"words": 5, "share": 0.8, "radius": 26, "keys": 8}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    columns = docs.columns
    judged = quality.quality_rules(docs)
    return judged.filter(col(judged.columns[-1])["kept"]).select(*[col(c) for c in columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return simhash.keep_one(docs, **NEAR)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    columns = docs.columns
    found = decontamination.find_overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size(col(found.columns[-1])) == 0).select(*[col(c) for c in columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for."""
    return mixing.mix_sources(docs).select(*[col(c) for c in docs.columns])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document in the token files."""
    index = tokens.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokens.read_tokens(index).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("token_output", token_stage),
]

#: The near-duplicate and token stages use XXH64, min-hashes and a tokenizer, which SQL lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
