"""A corpus pipeline: toxicity, exact dedup, near-duplicate classes, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's documents.

All stages take null and empty texts, null and repeated ids, very long texts, an empty table and further columns of any name, and
all but the last return the columns they were given.  A null text counts as empty: it is scored by the machine's bias, is equal to
every empty text (one stays), links to nothing, is mixed like any other and has the begin and end ids alone.  Rows that share
an id are rows of their own: each is scored; of equal texts, and of a near-duplicate class, one row stays; they share the numbers
that the mixture draws; each is encoded.  Columns that the last stage adds take underscores where the names are taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vecloom.llm import op2_toxicity, op5_exact_dedup, op6_mixing, op8_ngram_jaccard, op9_sentencepiece
from vecloom.llm.common import staged

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", op2_toxicity.stage),
    ("exact_dedup", op5_exact_dedup.stage),
    ("ngram_jaccard", op8_ngram_jaccard.stage),
    ("mix_sources", op6_mixing.stage),
    ("sentencepiece", op9_sentencepiece.stage),
]

#: Training, near-duplicate classes and token ids have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{name}")
    return docs
