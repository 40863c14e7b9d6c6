"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.session import ensure_checkpoint_dir

#: ASCII upper case to lower case, on UTF-8 bytes (other bytes stay).
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read again: computed
    once, readable by every executor, with known size and column pruning."""
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "docflow-llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``saved`` wrote and nothing reads any more."""
    files = df.inputFiles()
    if not files:
        return
    jvm = df.sparkSession._jvm
    folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def text_of(col: str = "text") -> Column:
    """The text, a null as the empty string."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def remainder(col: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod`` (a null id: 0)."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % mod, F.lit(0))


def map_batches(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def registry():
    """A dict of queries and a decorator that fills it."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

    def query(fn):
        queries[fn.__name__] = fn
        return fn

    return queries, query
