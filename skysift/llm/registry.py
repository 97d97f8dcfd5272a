"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import bpe_chunks, fill_middle, html_tree, jaccard_join, line_crf, oracles, phrase_dedup, pii, qgram_leaks, quality_rules, secret_scan, spelling, toxicity, unigram_count
from .common import table


def queries() -> dict:
    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_html_tree": lambda s, d: html_tree.op1(table(s, d, "pages")),
        "op2_toxicity": lambda s, d: toxicity.op2(docs(s, d), table(s, d, "labels")),
        "op3_unigram_count": lambda s, d: unigram_count.op3(docs(s, d)),
        "op4_line_crf": lambda s, d: line_crf.op4(docs(s, d), table(s, d, "labels")),
        "op5_bpe_chunks": lambda s, d: bpe_chunks.op5(docs(s, d)),
        "op6_qgram_leaks": lambda s, d: qgram_leaks.op6(docs(s, d), table(s, d, "benchmark")),
        "op7_quality_rules": lambda s, d: quality_rules.op7(docs(s, d)),
        "op8_secret_scan": lambda s, d: secret_scan.op8(docs(s, d)),
        "op9_phrase_dedup": lambda s, d: phrase_dedup.op9(docs(s, d)),
        "op10_jaccard_join": lambda s, d: jaccard_join.op10(docs(s, d)),
        "op11_spelling_variants": lambda s, d: spelling.op11(docs(s, d)),
        "op12_pii_boosting": lambda s, d: pii.op12(docs(s, d)),
        "op13_fill_middle": lambda s, d: fill_middle.op13(docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_quality_rules": quality_rules.SQL,
        "op9_phrase_dedup": oracles.PHRASE_DEDUP,
        "op10_jaccard_join": oracles.JACCARD_JOIN,
        "op11_spelling_variants": spelling.SQL,
        "op13_fill_middle": fill_middle.SQL,
    }
