"""Conversion log: an append-only table of status updates.

The tracker of the original service is an in-process dict; here each update
is a row ``(conversion_id, ts, status, progress_percent, output, error, ...)``
and the current state is an aggregate over the log, so any number of writers
can append and the state is recomputable after a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Status names and retention.
PROCESSING, COMPLETE, FAILED = "processing", "complete", "failed"
RETENTION_SECONDS = 86400

_KEY_FIELDS = ("conversion_id", "ts", "event_id")


def latest_status(log: DataFrame, order_cols: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Merge updates per id in time order.

    Every field takes its newest non-null value (a later update that leaves a
    field out keeps the earlier one); ``status`` and ``ts`` come from the
    newest update; ``progress_percent`` defaults to 0. ``max_by`` with a
    FILTER is a partial aggregate, so a hot id is combined map-side.
    """
    order = F.struct(*[F.col(c) for c in order_cols])
    fields = [c for c in log.columns if c not in _KEY_FIELDS and c != "status"]
    aggs = [F.max_by(F.col("status"), order).alias("status"), F.max("ts").alias("updated_at")]
    for f in fields:
        aggs.append(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), order)).alias(f))
    out = log.groupBy("conversion_id").agg(*aggs)
    if "progress_percent" in fields:
        out = out.withColumn("progress_percent", F.coalesce(F.col("progress_percent"), F.lit(0)))
    return out


def skip_known(requests: DataFrame, state: DataFrame, id_col: str = "conversion_id") -> DataFrame:
    """Drop requests whose id is already processing or complete (failed may rerun)."""
    busy = state.filter(F.col("status").isin(PROCESSING, COMPLETE)).select(F.col("conversion_id").alias(id_col))
    return requests.join(busy, id_col, "left_anti")


def expired(state: DataFrame, now: Column, ts_col: str = "updated_at") -> DataFrame:
    """Ids whose last update is more than 24 h before ``now``."""
    age = F.timestamp_diff("MICROSECOND", F.col(ts_col), now).cast("long") / 1_000_000
    age = F.floor(age).cast("long")
    return state.withColumn("age_seconds", age).filter(F.col("age_seconds") > RETENTION_SECONDS)


def conversion_key(filename: Column, lang: Column, geometry_type: Column, crs: Column) -> Column:
    """O04: '{filename}_{lang}_{geometryType}_{crs}'."""
    return F.concat_ws("_", filename, lang, geometry_type, crs)


def progress_percent(done: Column, total: Column) -> Column:
    """Percent after ``done`` of ``total`` parts, capped at 99 until complete."""
    return F.least(F.floor(done / total * 100).cast("int"), F.lit(99))


def active_count(state: DataFrame) -> DataFrame:
    """Number of conversions currently processing."""
    return state.agg(F.count_if(F.col("status") == PROCESSING).alias("processing"))
