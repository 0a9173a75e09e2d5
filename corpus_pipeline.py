"""A corpus pipeline of five stages, each one of the operators in `lexspan.llm`.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet and hands the reread
table to the next stage. All but the last return the columns of `documents`, whatever other columns there are, also where
their names are those that a stage uses itself; nulls in other columns than the text are carried along, and an empty table stays one.
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from lexspan.functions.scale import written  # noqa: E402
from lexspan.llm import chosenpath, decontaminate, langid, packing, pii  # noqa: E402
from lexspan.llm.common import small_batches  # noqa: E402
from lexspan.llm.queries import table, vocabulary  # noqa: E402


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification; documents without a language go: those whose text is null, empty or without a letter.

    Every row is judged by its own text, whole, so repeated rows share their fate; with no language to learn from, letters decide.
    """
    small_batches(spark)
    return langid.filtered(docs, langid.fit(docs.select("doc_id", "text", "lang")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingle Jaccard join; one document of each group of near copies stays, the one with the smallest id.

    Of rows equal in id and text one stays. Texts without words, null ones included, are near no other text and stay.
    """
    small_batches(spark)
    return chosenpath.deduplicate(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination; documents that hold a benchmark passage go, every row of them.

    Null texts and texts of under five words hold none and stay.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; null and empty texts stay as they are, and no row goes."""
    small_batches(spark)
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences: one row per piece. A null text is an empty one, whose only token is the end id;
    repeated rows are packed as often as they come; the documents' other columns are not returned."""
    small_batches(spark)
    return packing.digests(docs, *vocabulary())


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("packed", packed),
]

# Learned machines and a tokenizer take part: tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for `documents`; every stage reads what the one before it stored."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
