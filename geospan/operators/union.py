"""Vector layers -> one table with a WKT column.

The layers of a file are unioned by column name (columns in first-seen
order, missing ones null), every geometry is re-projected to WGS84 by its own
row's CRS, one-part multi-geometries are simplified to their member, and the
geometry is written out as ``footprintWKT`` — the last column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geospan.functions import crs as C
from geospan.functions import geometry as G
from geospan.functions.collections import normalize
from geospan.functions.cache import cached_expr
from geospan.functions.plain import plain_geometry
from geospan.functions.wkt import parse_wkt, to_wkt

WKT_OUT = "footprintWKT"


def union_layers(layers: list[DataFrame]) -> DataFrame:
    """U01 + S15: outer-column union by name; empty layers add no rows."""
    if not layers:
        raise RuntimeError("None of the layers could be read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)


@cached_expr
def _geometry_left(wkt_col: str, srid_col: str | None) -> Column:
    """The expressions' geometry of a text that ``_plain`` left open, else null; see ``operators/layer.py: _decode_left``."""
    left = F.when(F.col("_plain").isNull(), F.array(F.col(f"`{wkt_col}`")))
    return F.get(F.transform(left, lambda w: geometry_from_wkt(w, _srid(srid_col))), F.lit(0))


def _srid(srid_col: str | None) -> Column:
    return F.col(f"`{srid_col}`") if srid_col else F.lit(None).cast("int")


def _decoded(df: DataFrame, wkt_col: str, srid_col: str | None, attrs: list[Column]) -> DataFrame:
    """``attrs``, the text and ``_geometry`` (no validity filter): plain texts by the batch, others by expressions."""
    tried = df.withColumn("_plain", plain_geometry(F.col(f"`{wkt_col}`"), rules=False))
    staged = tried.select(*attrs, F.col(f"`{wkt_col}`").alias("_wkt"), F.col("_plain"), _srid(srid_col).alias("_srid"),
                          _geometry_left(wkt_col, srid_col).alias("_slow"))
    p = F.col("_plain")
    made = F.when(p["reason"].isNull(), G.make_geom(p["gtype"], p["parts"], F.col("_srid")))
    return staged.select(*attrs, F.col("_wkt"), F.when(p.isNotNull(), made).otherwise(F.col("_slow")).alias("_geometry"))


@cached_expr
def _out(geometry_col: str, wkt_col: str | None) -> Column:
    g = F.col(f"`{geometry_col}`")
    return F.struct(to_wkt(G.simplify_single_part(C.to_srid(g, C.WGS84))).alias("wkt"),
                    crs_issue(g, F.col(wkt_col) if wkt_col else F.lit(None)).alias("issue"))


def crs_issue(geom: Column, wkt: Column) -> Column:
    """Why a row has no WKT: missing or unsupported CRS, or text that is no geometry."""
    return (F.when(geom.isNull() & wkt.isNotNull(), F.lit("unparsable"))
            .when(geom.isNotNull() & geom["srid"].isNull(), F.lit("missing_crs"))
            .when(geom.isNotNull() & ~C.supported_srid(geom["srid"]), F.lit("unsupported_crs")))


def geometry_from_wkt(wkt: Column, srid: Column) -> Column:
    """Parse + normalise, no validity filter (the table export keeps every feature)."""
    n = normalize(parse_wkt(wkt))
    return F.when(n["reason"].isNull(), G.make_geom(n["gtype"], n["parts"], srid))


def to_table(layers: list[DataFrame], wkt_col: str = "wkt", srid_col: str | None = "srid",
             geometry_col: str | None = None) -> DataFrame:
    """The GIS-to-table job: union -> WGS84 -> one-part simplification -> WKT last.

    Layers carry geometry either as WKT text (``wkt_col`` + ``srid_col``) or as
    a geometry struct column (``geometry_col``). A row whose CRS is missing or
    not supported gets a null ``footprintWKT`` and a ``geometry_issue``
    (``missing_crs`` / ``unsupported_crs``) instead of failing the job.
    """
    df = union_layers(layers)
    drop = [geometry_col] if geometry_col else [c for c in (wkt_col, srid_col) if c]
    attrs = [F.col(f"`{c}`") for c in df.columns if c not in drop]
    if geometry_col is None:
        df, conv = _decoded(df, wkt_col, srid_col, attrs), _out("_geometry", "_wkt")
    else:
        conv = _out(geometry_col, None)
    return df.select(*attrs, conv["issue"].alias("geometry_issue"), conv["wkt"].alias(WKT_OUT))


def table_issues(layers: list[DataFrame], srid_col: str = "srid") -> DataFrame:
    """G15 roll-up: rows per CRS problem (missing or unsupported)."""
    df = union_layers(layers)
    srid = F.col(srid_col)
    issue = F.when(srid.isNull(), "missing_crs").when(~C.supported_srid(srid), "unsupported_crs").otherwise("ok")
    return df.groupBy(issue.alias("crs_status")).agg(F.count(F.lit(1)).alias("n_rows"))


def read_layers_safely(readers: dict) -> list[DataFrame]:
    """Call each ``name -> reader()``; a layer that fails to read is
    logged and skipped, empty layers add nothing; none left is an error."""
    import logging

    layers = []
    for name, reader in readers.items():
        try:
            df = reader()
            if not df.isEmpty():
                layers.append(df)
        except Exception as exc:  # a broken layer must not stop the others
            logging.warning("Failed to read layer %r: %s", name, exc)
    if not layers:
        raise RuntimeError("None of the layers could be read")
    return layers


def table_problem(counts: dict) -> str | None:
    """G15 + K05: why a table with these counts (``rows`` and one for each CRS problem) cannot be given; None if it can."""
    if counts.get("missing_crs"):
        return "The input states no coordinate reference system for some of its features"
    if counts.get("unsupported_crs"):
        return "The input has features in a coordinate reference system that cannot be converted"
    return None if counts.get("rows", 1) else "The input holds no features"


def require_crs(layers: list[DataFrame], srid_col: str = "srid") -> None:
    """G15 strict mode: fail when any feature has no coordinate reference system."""
    message = table_problem(dict(table_issues(layers, srid_col).collect()))
    if message:
        raise RuntimeError(message)


def require_rows(df: DataFrame, message: str = "The input holds no features") -> DataFrame:
    """K05 for the table export: fail when nothing is there."""
    if df.isEmpty():
        raise RuntimeError(message)
    return df
