"""Sinks: the occurrence layer (K01, K04, K05) and the CSV table.

Both write with Spark's own committers, so a failed job leaves no partial
output (the original appended partition by partition and only logged
failures). The row count is observed during the write itself
(``DataFrame.observe``), so the empty-output guard costs no extra pass.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from geospan.functions import geometry as G
from geospan.functions.wkt import to_wkt

LAYER_NAME = "occurrences"
NO_GEOMETRY_MESSAGE = "The export has no usable geometry, so no layer was written."


class NoGeometry(ValueError):
    """No row of a layer is usable."""


def layer_columns(layer: DataFrame) -> DataFrame:
    """Promote to Multi*, add WKT, SRID and bounds columns (bounds give
    parquet min/max statistics usable as a coarse spatial filter)."""
    attrs = [F.col(f"`{c}`") for c in layer.columns if c not in ("geometry", "reject_reason")]
    # Both are columns of their own first, so that they are computed once for all that is made of them.
    staged = layer.select(*attrs, F.col("reject_reason"), G.promote_to_multi(F.col("geometry")).alias("geometry"),
                          G.bounds(F.col("geometry")).alias("_bounds"))
    g, b = F.col("geometry"), F.col("_bounds")
    return staged.select(
        *attrs, F.col("reject_reason"), g, to_wkt(g).alias("geometry_wkt"), g["srid"].alias("srid"),
        b["minx"].alias("minx"), b["miny"].alias("miny"), b["maxx"].alias("maxx"), b["maxy"].alias("maxy"),
    )


def write_layer(layer: DataFrame, path: str, mode: str = "overwrite") -> dict:
    """K01 + K05: one job writes the good rows and the quarantine.

    Rows land in ``path/status=ok`` (the ``occurrences`` layer) and
    ``path/status=rejected`` (with ``reject_reason``). Raises when no row was
    good. The rows are written beside ``path`` and published only if some row is
    good, so a failed conversion leaves an earlier output as it was.
    """
    obs = Observation("layer_write")
    out = layer_columns(layer).withColumn(
        "status", F.when(F.col("reject_reason").isNull(), F.lit("ok")).otherwise(F.lit("rejected")))
    out = out.observe(obs, F.count(F.lit(1)).alias("rows"),
                      F.count_if(F.col("reject_reason").isNull()).alias("good"))
    staging = f"{path.rstrip('/')}-staging-{uuid.uuid4().hex}" if mode == "overwrite" else path
    out.write.mode(mode).partitionBy("status").parquet(staging)
    stats = obs.get
    if staging != path:
        publish(layer.sparkSession, staging, path if stats.get("good") else None)
    if not stats.get("good"):
        raise NoGeometry(NO_GEOMETRY_MESSAGE)
    return {"rows": stats["rows"], "good": stats["good"], "layer": LAYER_NAME, "path": path}


def publish(spark, staging: str, path: str | None) -> None:
    """Moves a written folder to its place, replacing what is there; without a place it is deleted."""
    jvm = spark._jvm
    source = jvm.org.apache.hadoop.fs.Path(staging)
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if path is None:
        fs.delete(source, True)
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"cannot move {staging} to {path}")


def write_table_csv(table: DataFrame, path: str, wkt_col: str = "footprintWKT", mode: str = "overwrite") -> None:
    """Comma separated, header, WKT column last, quotes doubled, and a
    literal backslash doubled as the reference writer's escape character does."""
    cols = [c for c in table.columns if c != wkt_col] + [wkt_col]
    text_cols = {f.name for f in table.schema.fields if f.dataType.simpleString() == "string"}
    out = table.select(*[
        (F.regexp_replace(F.col(f"`{c}`"), r"\\", r"\\\\") if c in text_cols else F.col(f"`{c}`")).alias(c)
        for c in cols])
    (out.write.mode(mode).option("header", True).option("sep", ",")
     .option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path))
