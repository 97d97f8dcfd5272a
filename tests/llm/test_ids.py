"""Ids that floats cannot hold, beside null ids: every operator gives them back."""

import random

import pytest
from pyspark.sql import functions as F

from skysift.llm import bpe_chunks, html_tree, jaccard_join, line_crf, phrase_dedup, qgram_leaks, quality_rules, secret_scan, toxicity, unigram_count
from tests.llm.test_documents import prose

BASE = 2**60 + 1
IDS = [BASE, None, BASE + 1, BASE + 2, None, -BASE]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    shared = prose(r, 40)
    texts = [shared + " a b", prose(r, 60), "", shared + " c d", None, prose(r, 70) + "\n" + prose(r, 20)]
    return spark.createDataFrame(list(zip(IDS, texts, strict=True)), "doc_id long, text string").coalesce(1)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(BASE + 2, 1, 1), (-BASE, 0, 0), (None, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, toxic int, quality int")


def _ids(df, column="doc_id"):
    return sorted((r[column] for r in df.select(column).collect()), key=repr)


OPERATORS = {
    "op2": lambda d, y: toxicity.op2(d, y), "op3": lambda d, y: unigram_count.op3(d), "op4": lambda d, y: line_crf.op4(d, y),
    "op5": lambda d, y: bpe_chunks.op5(d), "op5 texts": lambda d, y: bpe_chunks.encode(d), "op7": lambda d, y: quality_rules.op7(d),
    "op9": lambda d, y: phrase_dedup.op9(d), "op9 texts": lambda d, y: phrase_dedup.dedup(d), "op10": lambda d, y: jaccard_join.op10(d),
    "op8": lambda d, y: secret_scan.op8(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_ids_of_documents(docs, labels, name):
    assert _ids(OPERATORS[name](docs, labels)) == sorted(IDS, key=repr)


def test_ids_of_pages(docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))
    assert _ids(html_tree.op1(pages), "page_id") == sorted(IDS, key=repr)


def test_ids_of_leaks(docs, spark):
    item = docs.where("doc_id = -1152921504606846977").first()["text"].split("\n")[0]
    bench = spark.createDataFrame([(BASE + 7, item), (None, item)], "item_id long, text string")
    got = qgram_leaks.op6(docs.unionByName(docs.where("doc_id < 0").withColumn("doc_id", F.lit(None).cast("long"))).coalesce(1), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got if r["doc_id"] is not None) == [(-BASE, BASE + 7)] and len(got) == 2
    assert _ids(qgram_leaks.clean(docs, bench)) == sorted([i for i in IDS if i != -BASE], key=repr)
