"""From raw documents to packed training sequences: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import catalog, compact_windows, language_id, minhash_dedup, quality_rules, token_packing, word_encoder
from strandlake.llm.common import table, written

STAGES = [
    ("language ID", lambda spark, docs, sf_dir: language_id.keep_known(docs)),
    ("quality rules", lambda spark, docs, sf_dir: quality_rules.keep_good(docs)),
    ("near-duplicate documents", lambda spark, docs, sf_dir: minhash_dedup.keep_first(docs)),
    ("near-duplicate passages", lambda spark, docs, sf_dir: compact_windows.without_passages(docs)),
    ("packing", lambda spark, docs, sf_dir: token_packing.op10_packing(docs, catalog.WORD_VOCABULARY, word_encoder.FEW_ENTRIES)),
]

#: SQL can express neither the fitted model nor the tokens: the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
