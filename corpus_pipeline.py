"""The training-data pipeline: toxicity, language, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; run() writes each
stage's rows to the shared folder and reads them back as the next one's documents.  All stages but
the last return the columns of documents.  Null and empty texts pass the filters' scorers but have no
letters, so language ID rejects them; an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomlake.llm import langid, minhash, packing, suffix, toxicity
from roomlake.llm.store import Store, table

TOXIC = 0.5  # documents with P(severity >= 1) of this or more go
LEAST_SHARE = 0.15  # of a text's n-grams must be of its language


def _like(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.select(*docs.columns)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity model says non-toxic; trained on the labels of ``docs``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _like(docs, toxicity.severity(docs, model).filter(F.col("p_toxic") < TOXIC))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; lang is set to the one found."""
    filters = langid.fit(docs)
    found = langid.predict(docs, filters)
    found = found.filter((F.col("lang_pred") != langid.UND) & (F.col("hit_share") >= LEAST_SHARE))
    return _like(docs, found.withColumn("lang", F.col("lang_pred")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one of the smallest id, of each group linked by five-word shingles at 0.8.

    Rows are told apart by a key of this stage, written once: rows without an id and rows that repeat
    one count like any other.  Rows without an id come last in their group; ties go by a hash of the text.
    """
    store = Store(spark, "near_dedup")
    rows = store.put(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = minhash.near_duplicates(rows, "_row", shingle=5, percent=80).select("_row", "component_id")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("h"), "_row")
    kept = rows.select("_row", rank.alias("rank")).join(groups, "_row").groupBy("component_id").agg(F.min("rank").alias("rank"))
    return _like(docs, rows.join(kept.select(F.col("rank._row").alias("_row")), "_row", "left_semi"))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of passages that an earlier document has; whole characters only.

    A character goes when all of its bytes do.  Documents of which nothing is left go.
    """
    cut = suffix.without_repeats(docs)
    return _like(docs, cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).filter("text <> ''"))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of bounded size without two documents of one source or of one text."""
    return packing.packed(packing.sized(docs))


STAGES = [
    ("toxicity", remove_toxic),
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_dedup", remove_repeats),
    ("packing", pack_bins),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents."""
    store = Store(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store.put(stage(spark, docs, sf_dir), name)
    return docs
