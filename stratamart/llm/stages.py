"""The stages of the corpus pipeline; all but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamart.llm.minhash import near_duplicates
from stratamart.llm.mixing import mix, sized
from stratamart.llm.quality_rules import quality_rules
from stratamart.session import ship_package, stable

STAGE_PERCENT = 80  # op3 links from 85 on
ROW = "_row"


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of each row, stored so that it stays; ids may be null or repeat."""
    return stable(docs.withColumn(ROW, F.monotonically_increasing_id()))


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; every row is judged by itself."""
    ship_package(spark)
    rows = _numbered(docs)
    judged = quality_rules(rows, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"), key=ROW)
    return rows.join(judged.where("NOT kept").select(ROW), ROW, "left_anti").select(docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id (rows without an id come
    last). A row is told by a hash of its id and text, so ids may be null or repeat with other texts;
    rows equal in both count once. Texts without a word are in no group and stay. An empty table stays
    empty."""
    ship_package(spark)
    rows = docs.withColumns({ROW: F.xxhash64("doc_id", "text"), "_check": F.xxhash64("text", F.lit(1))})
    found = near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"), STAGE_PERCENT)
    groups = found.groupBy(F.col("doc_id").alias(ROW)).agg(F.min("component_id").alias("component_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", ROW))
    stays = rows.select(ROW, "doc_id").distinct().join(groups, ROW).groupBy("component_id").agg(first.getField(ROW).alias(ROW))
    return rows.join(stays.select(ROW), ROW, "left_semi").dropDuplicates([ROW, "doc_id", "_check"]).select(docs.columns)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat elsewhere; texts left without a word go."""
    from stratamart.llm.suffix_dedup import without_repeats

    ship_package(spark)
    return without_repeats(docs).where(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document once for each time it is taken; the last copy of a source that the
    budget cuts keeps its first words, as many as were taken."""
    ship_package(spark)
    rows = _numbered(docs)
    mixed = mix(sized(rows, ROW), key=ROW).select(ROW, "size", "taken")
    whole = rows.alias("d").join(mixed.alias("m"), ROW)
    words = F.regexp_extract_all("d.text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("m.taken") >= F.col("m.size"), F.col("d.text")).otherwise(
        F.array_join(F.slice(words, 1, F.col("m.taken").cast("int")), " "))
    return whole.withColumn("_text", text).select(
        *[F.col("_text").alias(c) if c == "text" else F.length("_text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"d.{c}") for c in docs.columns])
