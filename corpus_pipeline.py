"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
has kept, and returns a DataFrame, which is written as Parquet and read again as
the next one's docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.decontaminate import without_contaminated
from lumenframe.llm.jaccard_join import one_of_each
from lumenframe.llm.langid import fit_language_id, known_language
from lumenframe.llm.line_dedup import apply_bitmaps, drop_bitmaps
from lumenframe.llm.packing import pack
from lumenframe.llm.queries import table, tokenizer_path
from lumenframe.session import shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), or whose language is doubtful or unlike all that were learned, go.

    Repeated rows are judged alike.
    """
    return known_language(docs, fit_language_id(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; documents stay, if need be with an empty text.  n_chars follows the text.

    A null text stays null; rows without doc_id are one document that comes last.
    """
    out = apply_bitmaps(docs, drop_bitmaps(docs))
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the least doc_id.

    Rows that share a doc_id are one document; null and empty texts are no copies and stay.
    """
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; null and empty texts stay."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences; a null or empty text is its end alone."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: SQL can express neither the first stage's training nor the last one's tokens; tests compare with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, each written to the shared folder first, where the last one's rows are read from."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
