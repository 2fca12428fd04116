"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import audio, bwtmerge, chat, covertree, langcrf, linedup, minhash, mix, packing, rlz, timeparts, turns, urltree
from lakeloom.llm.common import Scratch, shared_dir
from lakeloom.llm.oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix.mix_sources(spark, _table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "part")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = audio.index_media(audio.store_texts(_table(spark, sf_dir, "documents")))
    return indexed.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "seek_offsets")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.remove_repeats(spark, _table(spark, sf_dir, "documents"), with_text=False)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.exact_top_k(spark, _table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


RULES = [urltree.Rule("org", "/", False), urltree.Rule("example.org", "/es/", True), urltree.Rule("example.org", "/en/1", True), urltree.Rule("com", "/fr/", False), urltree.Rule("com", "/de/", True)]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.filter_urls(spark, _table(spark, sf_dir, "pages"), RULES)


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, _table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langcrf.train_on(docs)
    return langcrf.identify_languages(spark, docs, model).withColumn("held_out", langcrf.held_out()).select("doc_id", "held_out", "lang_pred", "score")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, _table(spark, sf_dir, "documents"), shingle=4)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return chat.digest_conversations(chat.format_conversations(spark, rows.unionByName(extra)))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linedup.dedup_lines(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    damaged, dropped = turns.damage(rows)
    found = turns.digest(turns.repair_conversations(spark, damaged, Scratch(spark)))
    empty = rows.groupBy("conv_id").agg(F.bool_and(dropped).alias("all")).filter("all")
    zeros = [F.lit(0).cast("long").alias(c) for c in found.columns[1:-2]]
    return found.unionByName(empty.select("conv_id", *zeros, F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256")))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwtmerge.remove_repeats(spark, _table(spark, sf_dir, "documents"), keep_bytes=False)


def op13_adaptive_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = _table(spark, sf_dir, "clicks")
    early = F.col("arrived_at") < F.lit("2024-04-01 00:00:00").cast("timestamp_ntz")
    folder = f"{shared_dir(spark)}/clicks-{uuid.uuid4().hex}"
    layout = timeparts.TimeLayout(spark, folder, clicks.schema, timeparts.shifted_moment("ts", "click_id"), ("arrived_at", "click_id"), 1 + clicks.count() // 800)
    layout.lay_out(clicks.filter(early))
    start = Scratch(spark).save(layout.stored_digests().select("path", F.lit(False).alias("rewritten")), "start")
    layout.lay_out(clicks)
    files = layout.files("click_id", ~F.coalesce(early, F.lit(False))).join(start, "path", "left")
    return files.select("leaf", F.lit(",".join(clicks.columns)).alias("columns"), "ids_sha256", "path", F.col("part").cast("long").alias("part"), "n_rows", "n_new", F.coalesce("rewritten", F.lit(True)).alias("rewritten"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_mix_sources, op2_media_columns, op3_substring_dedup, op4_exact_top_k, op5_url_filters, op6_best_fit_packing, op7_language_id, op8_minhash_dedup, op9_chat_formatting, op10_line_dedup, op11_conversation_repair, op12_suffix_array_dedup, op13_adaptive_time_partitions, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
