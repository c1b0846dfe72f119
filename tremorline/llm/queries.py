"""The corpus operators as queries over the given tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.llm import (
    bpe, conversation_trie, decontamination, html_text, jaccard_join, lm, mixing, quality, secrets, sharding, source_audit,
    substring_dedup, toxicity,
)

SHARDS = 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"), sharding.even_tree(SHARDS),
                                      grown=sharding.even_tree(SHARDS, added=1).log)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard",
                         "region", "rack")


def op2_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op3_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, carry=["doc_id"])


def op4_doubling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_zstd_novelty_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan_secrets(docs, carry=["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")


def op6_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score_corpus(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_dom_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    found = html_text.extract_pages(pages, html_text.fit_pages(pages), carry=["page_id", "url"])
    return found.select("page_id", "url", "text", "n_chars", "n_blocks", "n_content_blocks")


def op8_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.clean_lines(docs, texts=False, carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         "n_lost_words")


def op9_qgram_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_leaks(docs, _table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("doc_id", (F.size("leaks") > 0).alias("leaked"),
                        F.array_sort(F.array_distinct("leaks.item_id")).alias("item_ids"), "leaks")


def op10_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_join(docs).select("doc_id", "class_id", "n_links", "n_text_links", "n_copies")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = conversation_trie.prefix_trie(conversation_trie.rebuild_conversations(_table(spark, sf_dir, "conversations")))
    return trie.drop("node_id")


def op12_prefix_refined_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit_sources(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = bpe.Tokenizer.read(public_tokenizers.path("byte_bpe_50k.json"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.decode_documents(bpe.encode_documents(docs, tokenizer, carry=["doc_id"]), tokenizer)
    return decoded.select(
        "doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hash_tree_shards": op1_hash_tree_shards,
    "op2_poisson_mixture": op2_poisson_mixture,
    "op3_ordinal_toxicity": op3_ordinal_toxicity,
    "op4_doubling_windows": op4_doubling_windows,
    "op5_zstd_novelty_secrets": op5_zstd_novelty_secrets,
    "op6_gru_scores": op6_gru_scores,
    "op7_dom_marginals": op7_dom_marginals,
    "op8_line_first_cleaning": op8_line_first_cleaning,
    "op9_qgram_leaks": op9_qgram_leaks,
    "op10_chosen_path_join": op10_chosen_path_join,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_prefix_refined_audit": op12_prefix_refined_audit,
    "op13_streaming_bpe": op13_streaming_bpe,
}
