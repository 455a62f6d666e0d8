"""A corpus pipeline of operators of terravane.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; the result is written and
read again as the next one's docs. All but the last return the columns of documents. The first three drop
rows: documents without a language, all but one of equal texts, all but one of near-duplicates. Mixing
repeats documents or leaves them out by its sources' targets; the last stage encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terravane.llm import bpe, exact_dedup, language_id, minhash_dedup, mixing
from terravane.llm.common import documents, written

STAGES = [
    ("language_id", language_id.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", minhash_dedup.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

#: A learned language ID, min-max hashing and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
