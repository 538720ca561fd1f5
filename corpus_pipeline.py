"""A training corpus from raw documents: quality rules, near-duplicates, secrets, mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but the
last return the columns of ``documents``.

Edge cases, for all stages: an empty table gives an empty table; texts of any length are handled
whole; extra columns are carried, whatever their names, by all stages but the last, whose columns
are fixed. What a stage does with nulls, ties and repeated rows is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, minhash, mixing, quality, secret_links
from tidemark.runtime import drop_stash, sheltered, stash, temporary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the standard policy fails. Null and blank texts have too few words
    and go; rows are judged one by one, so repeated rows stay or go together."""
    docs, back = sheltered(docs, *quality.MEASURES, "failed", "ruleset")
    return back(quality.apply_policy(quality.ledger(docs), quality.STANDARD).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8. The
    smallest id stays, null last, of repeated ids one row; rows without words are no group."""
    return minhash.deduplicate(docs, size=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span in a text is masked, overlapping spans as one; null stays null, and
    repeated rows get the same text."""
    return secret_links.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, repeated or left out as the sources' weights say. Null is a
    source of its own; rows of no words are taken by no pass; repeated rows count one by one."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of what they decode to. Null is the empty text, of no
    ids; repeated rows repeat."""
    coded = bpe.encode_decode(docs.select("doc_id", "source", "text"), bpe.default_path())
    return coded.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: The last stage encodes with merges that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        # A stage's own tables go once its result is written, and so does its input.
        with temporary(spark):
            docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}", lasting=True)
        drop_stash(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
