"""The registered queries of the package and their SQL."""

from __future__ import annotations

import corpus_pipeline
from plumbline.llm import alignment, decontam, html, jaccard, merkle, mixing, packing, pii, quality, rules, substring, token_files, warc
from plumbline.llm.common import table


def _docs(fn):
    return lambda spark, sf_dir: fn(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": lambda spark, sf_dir: quality.op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op2_pii": _docs(pii.op2),
    "op3_ngram_jaccard": _docs(jaccard.op3),
    "op4_quality_rules": _docs(rules.op4),
    "op5_substring_dedup": _docs(substring.op5),
    "op6_decontamination": lambda spark, sf_dir: decontam.op6(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op7_main_text": lambda spark, sf_dir: html.op7(table(spark, sf_dir, "pages")),
    "op8_token_files": _docs(token_files.op8),
    "op9_warc": lambda spark, sf_dir: warc.op9(table(spark, sf_dir, "pages")),
    "op10_mixing": _docs(mixing.op10),
    "op11_alignment": _docs(alignment.op11),
    "op12_merkle": _docs(merkle.op12),
    "op13_packing": _docs(packing.op13),
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op4_quality_rules": rules.SQL,
    "op6_decontamination": decontam.SQL,
    "op9_warc": warc.SQL,
    "op10_mixing": mixing.SQL,
    "op12_merkle": merkle.SQL,
}
