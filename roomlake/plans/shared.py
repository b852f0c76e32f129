"""Tables that several queries read: written once a session and source to the cluster's shared folder.

Visibility is the costly part of most scene queries; with its table written, Catalyst reads it with
pushed filters wherever a relation names it, also where one query names it several times.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one machine alone may do without and uses its warehouse folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_roomlake"
    return folder.rstrip("/")


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table at ``path``, without its lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state(spark: SparkSession, paths: list[str]) -> tuple:
    """Path, length and time of change of files: another state is another source."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        status = path.getFileSystem(conf).getFileStatus(path)
        found.append((p, status.getLen(), status.getModificationTime()))
    return tuple(found)


def length(spark: SparkSession, paths: list[str]) -> int:
    """Bytes of files and folders."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    return sum(path.getFileSystem(conf).getContentSummary(path).getLength() for path in map(jvm.org.apache.hadoop.fs.Path, paths))


def once(spark: SparkSession, name: str, paths: list[str], make) -> DataFrame:
    """The table ``name`` over the files ``paths``: ``make()``, written the first time it is asked for."""
    key = (spark.sparkContext.applicationId, name, state(spark, paths))
    if key in _written:
        return spark.read.parquet(_written[key])
    path = f"{shared_dir(spark)}/roomlake-{name}-{uuid.uuid4().hex}"
    out = written(make(), path)
    _written[key] = path
    return out
