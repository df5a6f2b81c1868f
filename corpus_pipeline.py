"""A training corpus from documents: five stages, each on all that the one before kept.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet
in the shared folder and read again as the next one's documents. The first four
return the columns of documents, the last one the packing. Null identifiers are one
document; repeated rows of one text fall together in the third stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoscope.llm.common import written
from mnemoscope.llm.decontaminate import without_contaminated
from mnemoscope.llm.line_dedup import drop_common_lines
from mnemoscope.llm.near_dedup import near_duplicates
from mnemoscope.llm.packing import packed
from mnemoscope.llm.toxicity import without_toxic

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic."""
    return without_toxic(docs.select(*COLUMNS), _table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many of them share."""
    out = drop_common_lines(docs.select(*COLUMNS))
    changed = F.when(F.col("_n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least identifier of each class of near duplicates."""
    kept = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id").distinct()
    # The same join at every size, so that its cost grows with the input.
    both = docs.select(*COLUMNS).join(kept.withColumnRenamed("doc_id", "_kept").hint("merge"), F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    return both.select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't cover a benchmark item."""
    return without_contaminated(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and place of every document."""
    return packed(docs)


STAGES = (
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
)

#: The first, third and last stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
