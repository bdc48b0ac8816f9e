"""Tables that cut lineage in loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir. Only a local session may go without one; it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-corpuslens-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/corpuslens-{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """df written as Parquet to the shared folder and read again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], buckets: int, name: str = "step", dealt: bool = False, ordered: bool | None = None) -> DataFrame:
    """As durable, in buckets by keys: joins and groupings on these keys need no shuffle of it. Rows are sorted by keys in a bucket, so that what is made from them in
    this order packs well. With dealt, df is already partitioned that way, and unless ordered its order stays."""
    path = shared_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    writer = (df if dealt else df.repartition(buckets, *keys)).write.bucketBy(buckets, *keys)
    (writer.sortBy(*keys) if (not dealt if ordered is None else ordered) else writer).format("parquet").option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)
