"""The thin opN queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, read_table

SHARD_BYTES = 16 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls, outcomes_of

    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge_urls(pages, outcomes_of(read_table(spark, sf_dir, "labels")))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_benchmark_hits

    found = find_benchmark_hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "_sl.n_words",
        "_sl.n_hit",
        F.size("_sl.item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("_sl.item_ids", ","), 256).alias("items_sha256"),
        (F.col("_sl.n_hit") > 0).alias("contaminated"),
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score_texts

    return score_texts(read_table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import link_vectors

    return link_vectors(read_table(spark, sf_dir, "embeddings"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import cluster_documents

    return cluster_documents(read_table(spark, sf_dir, "documents"), k=4, percent=85)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeated_strings

    return remove_repeated_strings(read_table(spark, sf_dir, "documents")).drop("kept")


def op7_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(read_table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES, keep=["doc_id"])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import learn_quality, score_quality

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn_quality(docs, read_table(spark, sf_dir, "labels"), usable=~held_out("doc_id", 5))
    scored = score_quality(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 5).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).alias("_before"))
    out = dedup_lines(docs)
    return out.select(
        "doc_id",
        F.coalesce("_before", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import encode_pieces

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_pieces(docs, str(public_tokenizers.path("piece_bpe_32k.model")), keep=["doc_id"])
    digests = [F.sha2(F.col(f"pieces.{c}").cast("binary"), 256).alias(f"{n}_sha256") for c, n in (("ids", "ids"), ("decoded", "decoded"))]
    return out.select("doc_id", "pieces.n_tokens", *digests)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import vector_codes

    return vector_codes(read_table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine_hard_negatives

    return mine_hard_negatives(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
