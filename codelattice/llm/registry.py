"""The subpackage's queries opN_<name> and, where SQL can express them, their SQL."""

from __future__ import annotations

import secrets
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm import bpe, exact, hnsw, langid, lines, mixing, pii, simhash, toxicity, urls

#: The rules of op7: hosts with their subdomains, and the start of the path.
URL_RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
#: The setting that holds the key of op6's pseudonyms; without it each session draws one, so nobody who reads this undoes them.
PII_KEY = "spark.codelattice.pii.key"
_drawn_key = secrets.token_hex(16)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to 150 % of their words by source weights 3, 1, 2."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies"
    )


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.95 or more between all embeddings, and their components."""
    return hnsw.embedding_groups(_table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: 4-word shingles, 4 bits."""
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents by the 50k ranks, and decode the ids again."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents as they are; the largest doc_id stays."""
    return exact.exact_groups(_table(spark, sf_dir, "documents"), keep="largest")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal data under format-preserving pseudonyms."""
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), spark.conf.get(PII_KEY, _drawn_key))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the five host rules on all pages."""
    rules = [urls.host_rule(text, verdict) for text, verdict in URL_RULES]
    return urls.judge_urls(_table(spark, sf_dir, "pages"), rules)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those whose crc32(doc_id) mod 4 is not 2."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.train(docs.where(~F.coalesce(held_out, F.lit(False))))
    return langid.predict(docs, model, keep=[F.coalesce(held_out, F.lit(False)).alias("held_out")])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, learnt from a sample of the labelled ones."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, toxicity.grades_from_labels(_table(spark, sf_dir, "labels")))
    return toxicity.predict(docs, model)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the runs of lines of 50 words or more that occur earlier in the corpus."""
    return lines.dedup_lines(_table(spark, sf_dir, "documents")).select(
        "doc_id", "text", "removed_lines", "removed_chars"
    )


OP5_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

OP7_SQL = """
WITH parts AS (
    SELECT page_id,
           CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), split AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM parts
), rules(rule, rule_host, rule_path, rule_verdict) AS (
    VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
           ('net/de/', 'net', '/de/', 'block'), ('example.net/de/8', 'example.net', '/de/8', 'block'),
           ('org/es/', 'org', '/es/', 'block')
), fits AS (
    SELECT page_id, rule, rule_verdict
    FROM split JOIN rules
      ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.rule_verdict, 'allow') AS verdict
FROM split LEFT JOIN (
    SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict
    FROM fits GROUP BY page_id
) AS best USING (page_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_mixing, op2_hnsw, op3_simhash, op4_bpe, op5_exact,
        op6_pii, op7_urls, op8_langid, op9_toxicity, op10_lines,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact": OP5_SQL, "op7_urls": OP7_SQL}
