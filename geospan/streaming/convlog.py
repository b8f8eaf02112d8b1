"""Structured Streaming versions of the conversion log.

* :func:`latest_status_stream` keeps the merged state per conversion id and
  drops it by event time when the retention (O03) has passed, so the state
  holds the ids of the last days only.
* :func:`convert_landing` converts every export that lands in a directory:
  text lines -> typed rows -> geometry layer, written per micro-batch with
  ``foreachBatch`` into a batch-numbered folder, so a re-run batch overwrites
  its own output (exactly-once with the checkpoint).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from geospan.operators.convlog import RETENTION_SECONDS
from geospan.operators.layer import to_layer
from geospan.sinks.layers import layer_columns
from geospan.sources.dictionary import column_types
from geospan.sources.tsv import split_lines, type_columns

LOG_SCHEMA = ("conversion_id string, event_id long, ts timestamp_ntz, status string, "
              "progress_percent int, output string, error string")


def latest_status_stream(log: DataFrame, watermark: str = "24 hours",
                         retention_seconds: int = RETENTION_SECONDS) -> DataFrame:
    """O01 on a stream of status updates: the merged state of every id that a batch touches.

    Same fields and rules as the batch version. An id's state is dropped (O03)
    once the watermark is ``retention_seconds`` past its last update; updates
    older than the watermark are late and left out.
    """
    fields = ("status", "progress_percent", "output", "error")
    kinds = {f: "int" if f == "progress_percent" else "string" for f in fields}

    def merge(key, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get) if state.exists else [None] * (3 * len(fields))
        for frame in frames:
            orders = list(zip(frame["us"].tolist(), frame["event_id"].tolist()))
            for i, f in enumerate(fields):
                values = [None if pd.isna(v) else v for v in frame[f].tolist()]
                for order, v in zip(orders, values):
                    older = held[3 * i + 1] is None or order > tuple(held[3 * i + 1:3 * i + 3])
                    if older and (v is not None or f == "status"):
                        held[3 * i:3 * i + 3] = int(v) if f == "progress_percent" else v, *order
        state.update(tuple(held))
        state.setTimeoutTimestamp(max(held[1] // 1000 + retention_seconds * 1000,
                                      state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"conversion_id": [key[0]], "status": [held[0]], "us": [held[1]],
                            "progress_percent": [held[3] or 0], "output": [held[6]], "error": [held[9]]})

    # Watermarks need an instant type; the log's wall-clock NTZ time is read in the session zone.
    merged = (log.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", watermark)
              .filter("at is not null")
              .select("conversion_id", "at", F.unix_micros("at").alias("us"),
                      F.coalesce("event_id", F.lit(-(1 << 63))).alias("event_id"), *fields)
              .groupBy("conversion_id")
              .applyInPandasWithState(
                  merge, "conversion_id string, status string, us long, progress_percent int, output string, error string",
                  ", ".join(f"{f} {kinds[f]}, {f}_us long, {f}_id long" for f in fields),
                  "update", GroupStateTimeout.EventTimeTimeout))
    return merged.select("conversion_id", "status",
                         F.timestamp_micros("us").cast("timestamp_ntz").alias("updated_at"),
                         "progress_percent", "output", "error")


def start_status_stream(spark: SparkSession, log_dir: str, out_dir: str, checkpoint: str,
                        watermark: str = "24 hours", available_now: bool = True) -> StreamingQuery:
    """Run :func:`latest_status_stream` over parquet status files.

    Every micro-batch writes the states it changed to a folder of its own
    under ``out_dir``, so a replayed batch overwrites itself;
    :func:`current_status` reads the newest state of each id.
    """
    log = spark.readStream.schema(LOG_SCHEMA).parquet(log_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    w = (latest_status_stream(log, watermark).writeStream.outputMode("update").foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def current_status(spark: SparkSession, out_dir: str) -> DataFrame:
    """The newest state of each id that :func:`start_status_stream` has written."""
    states = spark.read.parquet(out_dir)
    fields = [c for c in states.columns if c not in ("conversion_id", "batch")]
    newest = F.max_by(F.struct(*fields), F.col("batch")).alias("s")
    return states.groupBy("conversion_id").agg(newest).select("conversion_id", "s.*")


def convert_landing(spark: SparkSession, landing_dir: str, out_dir: str, checkpoint: str,
                    names: list[str], wkt_col: str, lang: str = "tech", geometry_type: str = "footprint",
                    crs: str = "wgs84", available_now: bool = True) -> StreamingQuery:
    """Convert each newly landed export (one header line, then rows).

    ``names`` is the expected header; header lines are recognised and dropped
    wherever they appear, so any number of files can arrive per batch.
    """
    types = column_types(lang)
    header = "\t".join(names)
    lines = spark.readStream.format("text").load(landing_dir)
    body = lines.filter(F.col("value") != header)
    layer = to_layer(type_columns(split_lines(body, names), types), wkt_col, geometry_type, crs)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        out = layer_columns(batch).withColumn(
            "status", F.when(F.col("reject_reason").isNull(), "ok").otherwise("rejected"))
        out.write.mode("overwrite").partitionBy("status").parquet(f"{out_dir}/batch={batch_id}")

    w = layer.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
