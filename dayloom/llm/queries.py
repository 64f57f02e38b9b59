"""The registered queries of the text operators and their checking SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm import (
    alignment, conversations, decontamination, language_model, mixing, prefix_join, quality, repeats, simhash, tokens, toxicity, urls, warc,
)
from dayloom.llm.common import table

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return add


_STOP = "', '".join(sorted({f for w in quality.STOP_WORDS for f in (w, w.capitalize())}))
_SPLIT = r"[\x20\x09-\x0D]+"


@query("op1_quality_rules", rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPLIT}'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
wins AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: struct_pack(i := i, k := list_slice(w, i, i + 4)))) AS x FROM t),
twice AS (SELECT doc_id, x.i AS i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, x.k) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
    len(list_filter(w, lambda x: NOT regexp_matches(x, '\pL'))) AS n_letterless,
    len(list_filter(w, lambda x: x IN ('{_STOP}'))) AS n_stop,
    len(list_filter(l, lambda x: x LIKE '%...' OR x LIKE '%…')) AS n_ellipsis,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet
  FROM t LEFT JOIN rep USING (doc_id)),
v AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.1
  AND n_letterless / n_words <= 0.3 AND n_capitals / word_chars <= 0.4 AND n_stop / n_words >= 0.02
  AND n_dup_lines / n_lines <= 0.3 AND n_ellipsis / n_lines <= 0.3 AND n_bullet / n_lines <= 0.9 AS kept
FROM v""")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    out = quality.quality_rules(table(spark, sf_dir, "documents"), result="quality")
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select("doc_id", *[F.col(f"quality.{f}").alias(f) for f in fields])


_BLOCKED = "|".join(
    f"({p})" for p in (
        r"[/.]casino(-[a-z]+)?[./]", r"[/.](free|best)-bets[./]", r"[/.]cheap-pills[./]",
        r"[/.]pills-(online|shop)[./]", r"[/.]adult-[a-z]+[./]", r"[/.]ads-track[./]", r"[/.]spam-farm[./]",
        r"[/.]poker(-[a-z]+)?[./]", r"[/.]xxx(-[a-z]+)?[./]", r"[/.]porn(-[a-z]+)?[./]", r"[/.]warez[./]",
        r"/affiliate/.*[?&]click=",
    )
)


@query("op5_url_filters", rf"""
WITH p AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/'
  END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(lower(url), '{_BLOCKED}') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r""")
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, winning host rule and verdict of every page."""
    return urls.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {1 + 5 * (k // 4)}, 5) AS BIGINT) >> {15 - 5 * (k % 4)}) & 31)::INT, 1)"
    for k in range(32)
)


@query("op6_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM f""")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back through the index."""
    index = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_token_output")
def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum as read back from the token files."""
    index = tokens.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokens.read_tokens(index).select("doc_id", "start", "n_tokens", "ids_crc32")


def _bisect_sql(name: str, passes: int, good: str) -> str:
    """CTEs ``name0`` to ``name<passes>``: the interval (lo, hi) around the crossing of ``good``."""
    out = [f"{name}0 AS (SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi)"]
    for k in range(passes):
        out.append(f"""{name}{k + 1} AS (
          SELECT max(CASE WHEN {good} THEN x ELSE lo END) AS lo,
            coalesce(min(CASE WHEN NOT ({good}) THEN x END), min(hi)) AS hi
          FROM (SELECT x, lo, hi, ln(sum(exp(x * ln(share)))) - x * sum(exp(x * ln(share)) * ln(share)) / sum(exp(x * ln(share))) AS entropy,
              max(exp(x * ln(share)) / share) / sum(exp(x * ln(share))) AS repeats
            FROM (SELECT lo + (hi - lo) / 16 * unnest(range(1, 16)) AS x, lo, hi FROM {name}{k}), shares GROUP BY x, lo, hi))""")
    return ",\n".join(out)


@query("op8_source_mixing", rf"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS s,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPLIT}'), lambda x: x <> '')) + 1 AS BIGINT) AS tokens,
    md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key
  FROM documents),
sizes AS (SELECT s, CAST(sum(tokens) AS BIGINT) AS t, CAST(ceil(sum(tokens) / 1048576) AS BIGINT) AS blocks FROM d GROUP BY s),
shares AS (SELECT *, t / (SELECT sum(t) FROM sizes) AS share FROM sizes),
goal AS (SELECT 0.95 * ln(count(*)) AS h, -sum(share * ln(share)) AS h_natural FROM shares),
{_bisect_sql("e", 5, "entropy >= (SELECT h FROM goal)")},
{_bisect_sql("r", 5, "repeats > 3.0")},
tau AS (
  SELECT CASE WHEN h_natural >= h THEN 1.0 ELSE greatest(e5.lo, CASE WHEN r5.lo > 0 THEN least(1.0, r5.lo + 1.0 / 16 ** 5) ELSE 0.0 END) END AS x
  FROM goal, e5, r5),
plan AS (
  SELECT s, t, blocks, exp(x * ln(share)) / (SELECT sum(exp(x * ln(share))) FROM shares, tau) AS weight, x FROM shares, tau),
quotas AS (
  SELECT *, CAST(floor(weight * (SELECT sum(t) FROM sizes) + 0.5) AS BIGINT) AS quota FROM plan),
placed AS (
  SELECT d.*, weight, x, quota // t AS epochs, quota % t AS rest, CAST('0x' || substr(key, 1, 12) AS BIGINT) % blocks AS b
  FROM d JOIN quotas USING (s)),
blocks AS (SELECT s, b, sum(tokens) AS size, any_value(rest) AS rest FROM placed GROUP BY s, b),
ordered AS (
  SELECT *, rest - sum(size) OVER (PARTITION BY s ORDER BY md5('7:' || s || ':' || CAST(b AS VARCHAR)), b) + size AS left_over FROM blocks),
running AS (
  SELECT p.*, o.left_over, o.size, sum(p.tokens) OVER (PARTITION BY p.s, p.b ORDER BY key, p.tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM placed p JOIN ordered o USING (s, b)),
used AS (
  SELECT doc_id, source, tokens, weight, x, unnest(range(0, epochs + CASE WHEN left_over > 0 AND upto <= left_over THEN 1 ELSE 0 END)) AS epoch
  FROM running)
SELECT doc_id, source, CAST(epoch AS INT) AS epoch, tokens AS n_tokens, round(weight, 9) AS weight, x AS exponent FROM used""")
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents: one row per document and epoch."""
    out = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("n_tokens"),
        F.round("mix_weight", 9).alias("weight"), F.col("mix_exponent").alias("exponent"),
    )


def _fold(doc_id, folds: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of three of the four folds are learnt."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), _fold(F.col("id"), 4) != 2)
    return scored.select("doc_id", F.coalesce(_fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash.simhash_groups(table(spark, sf_dir, "documents"), words=3, radius=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_language_model")
def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and model score of every document; one of seven folds is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return language_model.score_documents(docs, _fold(F.col("doc_id"), 7) == 2)


@query("op2_decontamination")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of the benchmark, with the item and the place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("overlaps"))


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 50-byte passages of documents before it."""
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_prefix_join")
def op11_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document by links of 80 % Jaccard similarity."""
    return prefix_join.jaccard_groups(table(spark, sf_dir, "documents"), words=5, percent=80)


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers lie over each other in every document."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    out = alignment.align_tokens(table(spark, sf_dir, "documents"), *paths, spell="sha256")
    return out.withColumnRenamed("groups", "groups_sha256")


@query("op13_conversations")
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired turns of every damaged conversation."""
    damaged = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.conversation_report(conversations.repair_conversations(damaged))
