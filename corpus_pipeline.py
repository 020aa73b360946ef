"""The corpus pipeline: quality, near-duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every result as Parquet in the shared folder of the session
and reads it again for the next stage, so a lost executor costs the tasks of one stage.
All stages but the last return the columns of `documents`; the last adds `copy`, a document's copies in the mix counted from 1.

Rows with a null id, null or empty text go through all stages like others: scored as empty texts, linked with nothing, without hits, and
of size 0 in the mix.  Rows that repeat an id and text are one document after near_duplicates; rows that repeat an id with other text are
two.  A very long text is one value in every stage.  Ties: near_duplicates keeps the smallest id, then the smaller digest.  Empty tables
give no rows.  Further columns are kept, whatever their names; only one named `copy` is replaced by the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quipu.llm import decontam, mixing, neardup, pii, quality
from quipu.llm.common import fresh, read, stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below the threshold of the rule ensemble go."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return quality.scored(docs, model, score).filter(F.col(score) >= quality.THRESHOLD).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return neardup.deduplicated(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontam.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in `text` become their kind in brackets; `n_chars`, where there is one, follows the text."""
    out = pii.redacted(docs, pii.train(docs))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
]
#: The classifiers and the rounding are not SQL; tests/llm compare each stage with brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
