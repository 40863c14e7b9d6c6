"""A18, ST5: mergeable sketches of telemetry, kept per day and key and merged into roll-ups.

A day's rows become one row per key: counts and sums, a quantile sketch of a value and a
distinct-count sketch of an id (Spark's KLL and HyperLogLog aggregates, combined map-side). Any
roll-up merges stored rows, never raw ones: over days, keys or stream batches. The quantile sketch's
rank error is about 2.3 / k^0.9 (0.9 % at the default ``K`` = 400); distinct counts are within about
3 x 1.04 / sqrt(2^LG_K) (2.4 % at 14).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 400
LG_K = 14


def daily(traces: DataFrame, ts: str, keys: list[str], value: str, who: str, k: int = K, lg_k: int = LG_K) -> DataFrame:
    """day, <keys>, n, n_values, total, least, most, values (sketch), people (sketch)."""
    v = F.col(value).cast("double")
    return traces.groupBy(F.to_date(ts).alias("day"), *keys).agg(
        F.count("*").alias("n"), F.count(v).alias("n_values"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"),
        F.kll_sketch_agg_double(v, F.lit(k)).alias("values"), F.hll_sketch_agg(F.col(who), F.lit(lg_k)).alias("people"))


def _merged() -> list[Column]:
    return [F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.sum("total").alias("total"), F.min("least").alias("least"),
            F.max("most").alias("most"), F.kll_merge_agg_double("values").alias("values"), F.hll_union_agg("people").alias("people")]


def merge(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows merged per ``keys`` (any of their columns; none: one row over all)."""
    return stored.groupBy(*keys).agg(*_merged())


def roll_up(stored: DataFrame, keys: list[str]) -> DataFrame:
    """``merge`` per all prefixes of ``keys``, with ``level`` as in a ROLLUP (0: all keys given)."""
    return stored.rollup(*keys).agg(*_merged(), F.grouping_id().cast("bigint").alias("level"))


def estimates(merged: DataFrame, ranks: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """The sketches read: p<rank> per rank (null without values), people (estimated distinct ids)."""
    some = F.col("n_values") > 0
    quantile = lambda r: F.when(some, F.kll_sketch_get_quantile_double("values", F.lit(float(r))))
    return merged.select(*(c for c in merged.columns if c not in ("values", "people")),
                         *(quantile(r).alias(f"p{round(100 * r)}") for r in ranks), F.hll_sketch_estimate("people").alias("people"))


def stream_batch(base: str, ts: str, keys: list[str], value: str, who: str) -> Callable[[DataFrame, int], None]:
    """ST5 foreachBatch body: the micro-batch's daily sketches, written under its id (a replayed
    batch overwrites its own); ``read_stream`` merges them."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        daily(batch, ts, keys, value, who).write.mode("overwrite").parquet(f"{base}/{batch_id}")
    return fn


def read_stream(spark, base: str) -> DataFrame:
    """All batches' daily sketches (several rows of a day and key, to be merged)."""
    return spark.read.parquet(f"{base}/*")
