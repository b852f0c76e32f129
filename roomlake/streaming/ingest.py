"""Scenes that arrive as files: every new one is read once, its question tables are appended."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import operators  # noqa: F401
from ..plans.catalog import evaluate
from ..sources.files import SCENE


def ingest_objects(spark: SparkSession, source: str, out: str, checkpoint: str, relations: Sequence[str] = ("solid_filter",)) -> StreamingQuery:
    """Evaluate ``relations`` over the objects of new scene files and append each to ``out``/name."""
    scenes = spark.readStream.schema(SCENE).option("multiLine", True).json(source)

    def batch(df: DataFrame, number: int) -> None:
        o = df.select("scene_id", F.posexplode("objects").alias("ord", "o")).select("scene_id", "ord", "o.*")
        for name in relations:
            evaluate(df.sparkSession, name, objects=o).withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{out}/{name}")

    return scenes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
