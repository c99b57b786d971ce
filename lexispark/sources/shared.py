"""Tables that a job writes between its steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's own setting: shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; there is no other folder that every executor is sure to reach.

    Only in local mode, where there is one machine, may it be unset: a temporary folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="lexispark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Steps:
    """Tables below one new folder; all but those named in ``keep`` go when the block ends.

    A written table cuts the lineage: a lost executor costs the step that runs, not those before it. So the shuffle files of
    a step go as soon as its table is written, not when the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}", set()

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *exc) -> None:
        for name in list(self.made):
            self.drop(name)

    def table(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        were = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(CLEANUP, were)
        self.made.add(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        out = self.table(df, name)
        self.made.discard(name)
        return out

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.made.discard(name)
