"""The registered queries of the text operators, over whole tables."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from . import bpe, embed_dedup, jaccard, kneser_ney, langid, packing, quality, secret_scan, sql, token_files, warc

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark, sf_dir):
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), TOKENIZER)


def op2_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op3_token_files(spark, sf_dir):
    return token_files.token_file_round_trip(_table(spark, sf_dir, "documents"), TOKENIZER, end_id=2)


def op4_embeddings(spark, sf_dir):
    return embed_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op5_langid(spark, sf_dir):
    return langid.identify_languages(_table(spark, sf_dir, "documents"))


def op6_secrets(spark, sf_dir):
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    return quality.quality_verdicts(_table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"), TOKENIZER, window=1024, end_id=0)


def op9_kneser_ney(spark, sf_dir):
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 7 == 2
    return kneser_ney.score_documents(_table(spark, sf_dir, "documents"), held_out)


def op10_warc(spark, sf_dir):
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_jaccard, op3_token_files, op4_embeddings, op5_langid, op6_secrets, op7_quality, op8_packing, op9_kneser_ney, op10_warc)}
#: The others encode, learn or pack, which SQL can't express: tests hold them against brute force, round trips and held-out rows.
ORACLE_SQL = {"op2_jaccard": sql.JACCARD, "op4_embeddings": sql.EMBEDDINGS, "op10_warc": sql.WARC}
