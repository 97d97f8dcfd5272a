"""The corpus pipeline: five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one
before it kept:

1. quality rules: documents that the default policy rejects go;
2. Jaccard join: of each group of linked documents one row with the smallest id
   stays (null ids come last; the group of a row is that of its text);
3. decontamination: documents that hold a benchmark item go;
4. secret scan: secrets are masked in the text, no document goes;
5. BPE: ids and the decoded text of what is left, as counts and digests.

All but the last return the columns of documents. Rows without text are rejected
by the first stage. An empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm import bpe_chunks, jaccard_join, qgram_leaks, quality_rules, secret_scan
from skysift.llm.common import stored, table
from skysift.session import prepared

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The verdict is a function of the text alone and comes with it: no join."""
    prepared(spark)
    rows = docs.select(F.struct(*COLUMNS).alias("doc_id"), F.col("text"))
    kept = quality_rules.apply_policy(quality_rules.ledger(rows)).where("kept")
    return kept.select("doc_id.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return jaccard_join.distinct_documents(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return qgram_leaks.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    rows = docs.select(F.struct(*COLUMNS).alias("doc_id"), F.col("text"))
    model = secret_scan.fit(secret_scan.labelled_tokens(docs))
    masked = secret_scan.redact(rows, model=model)
    return masked.select(
        "doc_id.doc_id", "text", "doc_id.lang", "doc_id.source", F.length("text").cast("long").alias("n_chars")
    )


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return bpe_chunks.digests(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: The stages have no SQL twin (alignment, exact joins of sets, tokenizer); the
#: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
