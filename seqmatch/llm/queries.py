"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import iblt, langid, linededup, media, mixing, ngramjoin, packing, quality, secrets, warc
from .common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"))
    found = warc.summary(warc.read(archives))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs)
    return langid.identify(docs.withColumn("held_out", langid.held_out()), model, keep=["doc_id", "held_out"])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.withColumn("held_out", langid.held_out()), model, keep=["doc_id", "held_out"])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.round_trip(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", "source", "n_chars", "copy", "n_copies", "shuffle_key")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = "f.rule in (" + ", ".join(f"'{r.name}'" for r in secrets.RULES if r.base) + ")"
    counts = [F.expr(f"cast(size(filter(found, f -> f.rule = '{r.name}')) as bigint)").alias(f"n_{r.name}") for r in secrets.RULES if r.base]
    return found.select("doc_id", *counts, F.sha2(F.expr(secrets.printed("found", base)), 256).alias("base_sha256"), F.expr(secrets.printed("found")).alias("spans"), "blob")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_text_links", "keeper")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_language_id": op2_language_id,
    "op3_quality": op3_quality,
    "op4_line_dedup": op4_line_dedup,
    "op5_media": op5_media,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op8_secrets": op8_secrets,
    "op9_fingerprint": op9_fingerprint,
    "op10_ngram_join": op10_ngram_join,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.ORACLE,
    "op4_line_dedup": linededup.ORACLE,
    "op7_mixing": mixing.oracle(),
}
