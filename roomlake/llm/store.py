"""Tables that cut lineage: written once to the cluster's shared folder, read back from there.

The folder is the session's ``spark.checkpoint.dir`` (see plans.shared).  Reading a written table
survives a lost executor, unlike blocks kept on executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.shared import shared_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Store:
    """A folder of one run's intermediate tables under the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/roomlake-{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as the table ``name`` and return the table, without ``df``'s lineage.

        Shuffle files of the write are released when it ends: nothing reads them again.
        """
        before = self.spark.conf.get(_CLEANUP, None)
        path = f"{self.base}/{name}"
        schema = df.schema
        try:
            self.spark.conf.set(_CLEANUP, "true")
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
