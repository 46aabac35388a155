"""The registered queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliosite.llm import chat, counterparts, decontamination, jaccard_join, kneser_ney, language_id, line_runs, merkle, packing, pii, repeats, resampling, transport, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out())
    model = language_id.fit(docs.where("not held_out"))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.fit_and_score(table(spark, sf_dir, "documents"), language_id.held_out(parts=7), order=3)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_turns(chat.as_parts(turns.unionByName(extra))), in_order=True)


def op8_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.features(transport.store(table(spark, sf_dir, "documents")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"), pii.fit(pii.examples(spark)))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    lowered = F.translate("text", counterparts.ALPHABET, counterparts.ALPHABET.lower())
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.preimage([lowered if c == "text" else F.col(c) for c in fields]))
    rows = merkle.manifest(table(spark, sf_dir, "documents"), "doc_id", "lang", fields, altered=changed)
    rows = rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), merkle.folded(F.coalesce("altered", "leaf"), F.col("steps")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.drop_lines(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_url_filter, op3_best_fit_packing, op4_suffix_dedup, op5_kneser_ney, op6_jaccard_join, op7_chat_format, op8_transport_stream, op9_pii, op10_decontamination, op11_merkle_manifest, op12_importance_resampling, op13_line_dedup)}


def oracle_sql() -> dict[str, str]:
    """Of the operators that SQL can express; tests/llm holds the others against brute-force versions."""
    return {"op11_merkle_manifest": counterparts.merkle(), "op12_importance_resampling": counterparts.resampling(), "op13_line_dedup": counterparts.line_dedup()}
