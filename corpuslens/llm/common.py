"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without one; it gets a fresh temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-corpuslens-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """df written as Parquet in the shared folder and read again: it cuts lineage, is computed once and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpuslens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the table of a DataFrame that durable gave, once nothing reads it any more."""
    jvm, path = df.sparkSession.sparkContext._jvm, df.durable_path
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def map_columns(df: DataFrame, columns: list[str], schema: str, fn: Callable[..., dict[str, list]]) -> DataFrame:
    """Arrow job over whole partitions: fn gets a list per column of an Arrow batch and returns a list per column of schema.

    Batches are handed on in slices of about 8 MB of text, so a batch of very long texts needs little memory.
    """
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(2048, int(batch.num_rows * (8 << 20) / max(1, batch.nbytes))))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                got = fn(*(part.column(i).to_pylist() for i in range(part.num_columns)))
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(job, out)


class WordHashes(dict):
    """Hashes of words, remembered up to 500,000 of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got
