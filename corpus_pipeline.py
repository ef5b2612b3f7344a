"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, and the mix of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline import ship
from timberline.llm import decontaminate, exact_dedup, mixing, near_dedup, quality_lm
from timberline.llm.common import drop_path, give_back_heaps, materialize, new_path, text_of, without

# Each stage takes rows with any further columns, of any name, and gives back whole rows of its input; an empty table gives an empty one. Rows that are the
# same in doc_id and text share a verdict, except that of exact copies one row stays. A stage begins with what stages before it left on the executors given back.


def begin(spark: SparkSession) -> None:
    ship(spark)
    give_back_heaps(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on those labelled good among `docs`, does not reject. Null and empty texts go."""
    begin(spark)
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    rejected = quality_lm.classify(docs, trusted).where("NOT kept").select("key").distinct()
    return without(docs, [F.xxhash64("doc_id", "text")], rejected)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, null being empty, the one with the smallest doc_id."""
    begin(spark)
    return exact_dedup.kept(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest doc_id; all texts without a word are one class."""
    begin(spark)
    gone = near_dedup.classes(docs).where("NOT kept").select("doc_id", "text_key").distinct()
    return without(docs, [F.col("doc_id").cast("bigint"), F.xxhash64(text_of())], gone)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null and empty texts hold none."""
    begin(spark)
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "text_key").distinct()
    return without(docs, [F.col("doc_id").cast("bigint"), F.xxhash64("text")], found)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; null and empty texts have none."""
    begin(spark)
    return mixing.mix(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", decontaminated), ("mixing", mixed)]

#: The quality model and the near-duplicate classes are beyond SQL. `tests/llm` holds the exact and near stages against brute force, as it does the operators
#: of the quality, decontamination and mixing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from `documents` on; each is written to the shared folder and read again by the next."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        before, path = path, new_path(spark, f"stage-{name}")
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", path)
        if before:
            drop_path(spark, before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    drop_path(spark, path)  # the mix is a table of its own
    return out
