"""A pipeline over ``documents``: quality, line dedup, near duplicates, decontamination, packing.

Every stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns what it keeps.
Each result is written as Parquet into the session's checkpoint folder and read again by the next stage.
All stages but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphtrails.llm import decontam, jaccard, lines, packing, quality
from graphtrails.scratch import Scratch

#: SQL can express neither the classifier nor the packing; tests hold every stage against a plain version.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It is fitted on their labels."""
    return quality.good_documents(docs, _table(spark, sf_dir, "labels"))


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand in many of them."""
    kept = lines.drop_lines(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"), carry=("row",))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return kept.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every class of near duplicates by op9's rule: 4-word shingles, 85 percent."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark items aren't a twentieth or more."""
    return decontam.clean_documents(docs, _table(spark, sf_dir, "benchmark"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, one row per piece."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_frequent_lines),
    ("jaccard_join", keep_one_of_near),
    ("decontamination", drop_contaminated),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = _table(spark, sf_dir, "documents"), Scratch.of(spark)
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
