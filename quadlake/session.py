"""The session, and cutting lineage through tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution, ANSI and UTC; on a cluster master and sizes come from spark-submit."""
    b = SparkSession.builder.master(master).appName("quadlake").config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one set on the context. Only a local master may do without."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quadlake-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """df with its lineage cut by a table in the shared folder, which survives lost executors and, unlike a checkpoint, keeps statistics,
    column pruning and pushed filters. by: a column that each part is sorted by, so a filter on it skips row groups."""
    return Tables(df.sparkSession, by).add(df)


class Tables:
    """A table that grows by parts, each written once to the shared folder: what was found before isn't written again."""

    def __init__(self, spark: SparkSession, by: str | None = None):
        self.spark, self.by, self.paths, self.schema = spark, by, [], None

    def add(self, df: DataFrame) -> DataFrame:
        """Adds and gives back a part."""
        self.schema = self.schema or df.schema
        (df.sortWithinPartitions(self.by) if self.by else df).write.parquet(path := f"{shared_dir(self.spark)}/cut-{uuid.uuid4().hex}")
        self.paths.append(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)
