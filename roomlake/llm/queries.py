"""The queries opN_<name>: operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lexical import SEARCH_SQL
from .store import table
from .subtrees import CUT_SQL


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed, sized

    return packed(sized(table(spark, sf_dir, "documents")))


def op6_minimum_cut_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mincut import extract

    return extract(table(spark, sf_dir, "pages"))


def op2_cover_tree_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .covertree import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op7_impact_ordered_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .impact import top_k

    return top_k(table(spark, sf_dir, "embeddings"), 5, every=50)


def op3_language_bitmask_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, predict

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    filters = fit(docs.filter(~held_out & F.col("lang").isNotNull()))
    return predict(docs, filters).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, severity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return severity(docs, model).select("doc_id", "severity", "p_toxic", "grade", (F.col("p_toxic") >= 0.5).alias("rejected"))


def op5_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kdshard import shards

    out = shards(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_bwt_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import digest, repeated_spans

    out = digest(repeated_spans(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_blocked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op12_prefix_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .subtrees import without_repeated_words

    out = without_repeated_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_relational_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import aligned

    paths = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return aligned(table(spark, sf_dir, "documents"), *paths, digest=True).withColumnRenamed("groups", "groups_sha256")


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_cover_tree_near_dedup, op3_language_bitmask_filters, op4_ordinal_toxicity, op5_kd_tree_sharding, op6_minimum_cut_extraction, op7_impact_ordered_top_k, op8_minhash_near_dedup, op9_bwt_repeated_passages, op10_byte_bpe, op11_blocked_lexical_search, op12_prefix_suffix_trees, op13_relational_alignment)}
ORACLE_SQL: dict[str, str] = {"op11_blocked_lexical_search": SEARCH_SQL, "op12_prefix_suffix_trees": CUT_SQL}
