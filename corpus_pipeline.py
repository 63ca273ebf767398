"""A training-text pipeline: quality rules, language identification, near-duplicates, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import idfilter, jaccard, langid, packing, quality, secret_scan
from tarnlake.llm.common import Stash, relieved, temporary
from tarnlake.llm.queries import TOKENIZER
from tarnlake.session import ship

#: Least share of a text's letters that must be in words of its language.
LEAST_LANGUAGE_SHARE = 0.5


# Every stage takes an empty table (and returns one), nulls in any column, texts of any length, repeated rows and further columns of
# any name, and gives all columns back in their order; what becomes of such rows is said at each.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counted rules and the outlier rule keep. Null and empty texts fail the counted rules and go; null languages
    and sources are values like others; repeated rows stay or go together."""
    ship(spark)
    with relieved(spark):
        return quality.keep_quality(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: not und, and not a mixture in which none has half of the letters. Null texts and texts without a
    letter go; rows with a null language or id are judged like others (but not learned from without a language); repeated rows
    stay or go together; if no row has a language, all go."""
    ship(spark)
    with relieved(spark):
        return langid.keep_languages(docs, LEAST_LANGUAGE_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that with the smallest id. Rows that repeat an id with an equal text leave
    one; rows that give one id different texts all stay, as do rows without an id or without words."""
    ship(spark)
    with relieved(spark):
        stash = Stash(spark, "pipeline")
        groups = stash.save(jaccard.jaccard_components(docs), "groups")
        kept = idfilter.drop_ids(docs, groups.where("doc_id != component_id"), "doc_id")
        twice = stash.save(groups.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
        if twice.isEmpty():
            return kept
        repeated = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)
        return idfilter.drop_ids(kept, twice, "doc_id").unionByName(repeated)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts; n_chars follows where it is given. Null and empty texts, and null counts, stay
    as they are; repeated rows are masked alike."""
    ship(spark)
    with relieved(spark):
        masked = secret_scan.redact_secrets(docs)
        if "n_chars" in docs.columns:
            n = F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
            masked = masked.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
        return masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens. Null and empty texts are one token, the end; repeated rows are documents of their own."""
    ship(spark)
    with relieved(spark):
        return packing.pack_documents(docs, TOKENIZER, window=1024, end_id=0)


STAGES = [("quality_rules", quality_rules), ("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", pack)]
#: SQL can't express the robust estimates, the language model or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read by the next. What a stage made besides its result is removed as
    soon as that is written, and a stage's result as soon as the next one is. An empty table gives no row."""
    stash, before = Stash(spark, "corpus"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with temporary():
            docs = stash.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            stash.drop(before)
        before = name
    return docs
