"""A corpus pipeline of five stages: quality, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of ``documents``; the last returns one row per packed piece. SQL can't express the classifier's training, the
fingerprints or the tokenizer; the tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import decontaminate, lines, neardup, packing, quality
from chronoloom.llm.base import materialize, table
from chronoloom.llm.tokens import vocabulary_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (fitted on the labels of these documents) scores 0.7 or more."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier (short ones: exactly); n_chars follows; a document left with blank lines goes."""
    cut = lines.dedup(docs, exact_chars=1).where((F.col("__kept") == F.col("__lines")) | (F.btrim("text", F.lit(" \t\r\n")) != ""))
    chars = F.when(F.col("__kept") < F.col("__lines"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", chars).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: five-word shingles with a Jaccard similarity of 0.8 or more."""
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 token ids."""
    return packing.pack(docs, vocabulary_path())


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("near-dedup", near_duplicate_stage), ("benchmark decontamination", decontamination_stage), ("packing", packing_stage)]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what each kept is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
