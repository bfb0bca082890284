"""The queries opN_<name> of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, binary_packing, bpe_count, golay_dedup, host_quality, language_id, matroska, prefix_shards, source_mix, spelling, sql, token_files, toxic_passages, warc
from .common import cut, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules are kept once in the shared folder, without texts, for both the sums by host and the join."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rules = host_quality.rule_columns(docs).select(F.struct(F.col("__row.doc_id").alias("doc_id")).alias("__row"), "__host", *host_quality.RULES)
    rules = cut(rules)
    df = host_quality.join_verdicts(rules, host_quality.host_verdicts(rules))
    return df.select(F.col("__row.doc_id").alias("doc_id"), *host_quality.RULES, "host_rate", "host_rejected", "kept")


def op5_golay_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints once, kept in the shared folder; then the classes of the distinct ones, joined back by fingerprint."""
    docs = table(spark, sf_dir, "documents")
    ids = cut(docs.select(F.col("doc_id").alias("id"), golay_dedup.fingerprint(F.col("text")).alias("fp")))
    df = ids.join(golay_dedup.classes(ids), "fp", "left")
    return df.select(F.col("id").alias("doc_id"), golay_dedup.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op4_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_packing.packed_sequences(table(spark, sf_dir, "documents"), with_ids=False)


def op6_bpe_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bpe_count.token_counts(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards, folder = token_files.token_files(table(spark, sf_dir, "documents"))
    return token_files.read(shards, folder, with_ids=False)


def op2_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxic_passages.fit(docs, labels.where(~toxic_passages.held_out(F.col("doc_id"))))
    df = toxic_passages.toxicity(docs.select("doc_id", "text"), model)
    return df.select("doc_id", toxic_passages.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence", F.size("passages").alias("n_passages"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys are kept once in the shared folder, without texts, for all steps."""
    rows = source_mix.keyed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    rows = cut(rows.select(F.col("__row.doc_id").alias("doc_id"), "__source", "__size", "__key"))
    df = source_mix.apply_plan(rows, source_mix.plan(rows))
    return df.select("doc_id", F.col("__size").alias("size"), "source_size", "target", "taken")


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = matroska.with_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_bytes", matroska.digests(F.col("media")).alias("d")).select("doc_id", "n_bytes", "d.*")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = warc.round_trip(table(spark, sf_dir, "pages"))
    return df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", prefix_shards.text_bytes(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"))
    df = prefix_shards.assign(docs, F.col("size"), [F.col("doc_id").asc_nulls_last(), F.col("text_crc32")])
    return df.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    df = spelling.spelling_variants(spelling.word_counts(docs, drop_every=199))
    return df.select("word", "form", "root", "n", "n_near", "form_n")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = alignment.alignment(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", *alignment.COMPUTED)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    df = language_id.identified(docs.select("doc_id", "text"), model)
    return df.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_host_quality, op2_toxic_passages, op3_source_mix, op4_binary_packing, op5_golay_dedup, op6_bpe_count, op7_matroska, op8_warc, op9_prefix_shards, op10_token_files, op11_spelling_variants, op12_alignment, op13_language_id)
}

ORACLE_SQL: dict[str, str] = dict(sql.ORACLE_SQL)
