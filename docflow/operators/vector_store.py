"""E5: embeddings addressed by content, so that no text is embedded twice.

A text's vector is stored under the SHA-256 of the text. A run anti-joins its distinct texts with
the stored hashes, embeds what is left, stores it as one more committed part, and joins all vectors
back by hash. Only hashes meet the store; texts go to the embedding at most once. The store's folder
belongs to one embedding and dimension.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.operators import embedding
from docflow.session import saved
from docflow.sources.files import exists

SCHEMA = "hash string, idx array<bigint>, cnt array<double>, norm double"


class VectorStore:
    def __init__(self, spark: SparkSession, base: str, dim: int = embedding.DEFAULT_DIM):
        self.spark, self.base, self.dim = spark, f"{base}/md5-{dim}", dim

    def _parts(self) -> list[str]:
        """The committed parts: one a run that had something new."""
        if not exists(self.spark, self.base):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        names = [f"{self.base}/{f.getPath().getName()}" for f in found]
        return sorted(n for n in names if exists(self.spark, f"{n}/_SUCCESS"))

    def read(self) -> DataFrame:
        parts = self._parts()
        return self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)

    def embed(self, texts: DataFrame, text_col: str = "text") -> tuple[DataFrame, int]:
        """``texts`` plus idx, cnt, norm (a null text as the empty one), and how many texts were
        embedded for it."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = texts.drop("idx", "cnt", "norm").withColumn("_hash", F.sha2(text.cast("binary"), 256))
        new = rows.select(F.col("_hash").alias("hash"), text.alias("text")).join(self.read().select("hash"), "hash", "left_anti")
        new = saved(new.dropDuplicates(["hash"]), "new-texts")
        n = new.count()
        if n:
            made = embedding.embed_md5_vectors(new, ["hash"], "text", self.dim)
            made.write.mode("errorifexists").parquet(f"{self.base}/{uuid.uuid4().hex}")
        # Two runs at once may both store a text: any of its equal vectors.
        held = self.read().dropDuplicates(["hash"]) if len(self._parts()) > 1 else self.read()
        return rows.join(held.withColumnRenamed("hash", "_hash"), "_hash").drop("_hash"), n
