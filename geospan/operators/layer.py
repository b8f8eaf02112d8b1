"""Occurrence table -> geometry layer (the conversion job's core).

``to_layer`` chains, as one narrow projection per row:

1. F01/F02  null / blank WKT rows are rejected (reasons ``null_wkt`` /
   ``blank_wkt``);
2. G01      the WKT is parsed (``unparsable``, ``unsupported_dimension``);
3. G06-G09  geometry collections are normalised (``nested_collection``,
   ``needs_overlay``);
4. G02/G03/G04 empty, non-finite and invalid geometries are rejected
   (``empty``, ``non_finite``, ``invalid``);
5. G13/G14  the geometry is re-projected to the target CRS
   (``unsupported_crs``);
6. G10-G12  the requested transform: centroid (``point``), envelope
   (``bbox``) or the footprint itself.

Nothing is filtered out: every row keeps a ``reject_reason`` (null for good
rows), so the good layer and the quarantine come from one scan (A02).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geospan.functions import crs as C
from geospan.functions import geometry as G
from geospan.functions import validity as V
from geospan.functions.cache import cached_expr
from geospan.functions.collections import normalize
from geospan.functions.plain import plain_geometry
from geospan.functions.wkt import let, parse_wkt
from geospan.session import checkpoint_dir

# Request parameters and what they mean.
GEOMETRY_TYPES = {"point": "points", "bbox": "bbox", "footprint": "original"}
CRS_CODES = {"euref": C.TM35FIN, "wgs84": C.WGS84}
LANGUAGES = ("tech", "fi", "en")


def check_params(geometry_type: str, crs: str) -> tuple[str, int]:
    """Validate the request parameters and map them to their meaning."""
    if geometry_type not in GEOMETRY_TYPES:
        raise ValueError(f"geometryType must be one of {sorted(GEOMETRY_TYPES)}, got {geometry_type!r}")
    if crs not in CRS_CODES:
        raise ValueError(f"crs must be one of {sorted(CRS_CODES)}, got {crs!r}")
    return GEOMETRY_TYPES[geometry_type], CRS_CODES[crs]


def decode_geometry(wkt: Column, srid: Column | int = C.WGS84, topology: bool = True) -> Column:
    """WKT -> ``struct<geometry, reason>``: parse, normalise, check usability.

    Each intermediate is bound once (``let``) so the parse runs once per row.
    """
    def with_norm(n):
        def with_geom(geom):
            reason = (
                F.when(n["reason"].isNotNull(), n["reason"])
                .when(G.is_empty(geom), F.lit("empty"))
                .when(~G.all_finite(geom), F.lit("non_finite"))
                .when(~V.well_shaped(geom) | (~V.topology_valid_inrow(geom) if topology else F.lit(False)),
                      F.lit("invalid"))
            )
            return let(reason, lambda r: F.struct(F.when(r.isNull(), geom).alias("geometry"), r.alias("reason")))
        return let(G.make_geom(n["gtype"], n["parts"], srid), with_geom)
    return let(normalize(parse_wkt(wkt)), with_norm)


def _srid_col(srid: Column | int | str) -> Column | int:
    return F.col(f"`{srid}`") if isinstance(srid, str) else srid


@cached_expr
def _decode_left(wkt_col: str, srid: int | str, topology: bool = True) -> Column:
    """The expressions' answer for a text that ``_plain`` left open, else null.

    The text is the one item of an array or there is none, so that nothing is
    evaluated for the others; a condition around expressions of this size would
    cost Spark's analysis minutes.
    """
    left = F.when(F.col("_plain").isNull(), F.array(F.col(f"`{wkt_col}`")))
    return F.get(F.transform(left, lambda w: decode_geometry(w, _srid_col(srid), topology)), F.lit(0))


def _decoded_rows(df: DataFrame, wkt_col: str, srid: int | str, keep: list[str], topology: bool = True,
                  geometry: bool = True) -> DataFrame:
    """``keep`` and ``_decoded`` (``struct<geometry, reason>``, or the reason alone): plain texts by the batch, others by expressions.

    For the others, polygons whose touching rings cut their interior are found on the decoded column.
    """
    tried = df.withColumn("_plain", plain_geometry(F.col(f"`{wkt_col}`"), topology, geometry=geometry))
    staged = tried.select(*(F.col(f"`{c}`") for c in keep), F.col("_plain"), _decode_left(wkt_col, srid, topology).alias("_slow"),
                          (_srid_col(srid) if isinstance(srid, str) else F.lit(srid)).alias("_srid"))
    p, d = F.col("_plain"), F.col("_slow")
    cut = F.coalesce(V.interior_cut(d["geometry"]), F.lit(False)) if topology else F.lit(False)
    reason = F.when(p.isNotNull(), p["reason"]).when(cut, F.lit("invalid")).otherwise(d["reason"]).alias("reason")
    fields = [reason]
    if geometry:
        geom = F.when(p["reason"].isNull(), G.make_geom(p["gtype"], p["parts"], F.col("_srid")))
        fields.insert(0, F.when(p.isNotNull(), geom).when(~cut, d["geometry"]).alias("geometry"))
    return staged.select(*(F.col(f"`{c}`") for c in keep), F.struct(*fields).alias("_decoded"))


def with_geometry(df: DataFrame, wkt_col: str, srid: int | str = C.WGS84,
                  drop_wkt: bool = True, topology: bool = True, geometry: bool = True) -> DataFrame:
    """Add ``geometry`` and ``reject_reason``; P04 drops the WKT column.

    ``srid`` is an EPSG code or the name of a column holding one per row.
    ``topology=False`` leaves the edge/nesting rules to the shuffle-based
    check of :mod:`geospan.operators.validity` (for very large geometries).
    ``geometry=False`` adds the reason alone, by the same decode and checks: for
    a caller that reads no geometry, none is carried from the batch to the rows.
    """
    drop = wkt_col if drop_wkt else None
    keep = [c for c in df.columns if c != drop and c not in ("geometry", "reject_reason")]
    decoded = _decoded_rows(df, wkt_col, srid, keep, topology, geometry)
    if not geometry:
        return decoded.select(*(F.col(f"`{c}`") for c in keep), F.col("_decoded.reason").alias("reject_reason"))
    return _expand(decoded, F.col("_decoded"), "_decoded")


def _expand(df: DataFrame, decoded: Column, drop: str | None) -> DataFrame:
    """One projection computes the struct; the next only reads its fields."""
    keep = [F.col(f"`{c}`") for c in df.columns if c != drop and c not in ("geometry", "reject_reason")]
    staged = df.select(*keep, decoded.alias("_decoded"))
    cols = [F.col(f"`{c}`") for c in staged.columns if c != "_decoded"]
    return staged.select(*cols, F.col("_decoded.geometry").alias("geometry"),
                         F.col("_decoded.reason").alias("reject_reason"))


def transform_geometry(geom: Column, mapped_type: str) -> Column:
    """G10/G11/G12 by the mapped geometry type."""
    if mapped_type == "points":
        return G.centroid(geom)
    if mapped_type == "bbox":
        return G.envelope(geom)
    return geom


def layer_geometry(wkt: Column, mapped_type: str, target: int, srid: Column | int = C.WGS84) -> Column:
    """Decode -> re-project -> transform as one bound expression: ``struct<geometry, reason>``."""
    return layer_from_decoded(decode_geometry(wkt, srid), mapped_type, target)


def in_domain(geom: Column) -> Column:
    """Whether degrees are degrees: longitudes within 180, latitudes within 90; other CRSs have no such limit."""
    return (geom["srid"] != C.WGS84) | F.forall(
        G.all_points(geom), lambda p: (F.abs(p[0]) <= 180) & (F.abs(p[1]) <= 90))


def layer_from_decoded(decoded: Column, mapped_type: str, target: int) -> Column:
    """Re-project and transform an already decoded ``struct<geometry, reason>``."""
    def with_decoded(d):
        def with_moved(moved):
            reason = (F.when(d["reason"].isNotNull(), d["reason"]).when(moved.isNull(), F.lit("unsupported_crs"))
                      .when(C.moves(d["geometry"], target) & ~(in_domain(d["geometry"]) & G.all_finite(moved)),
                            F.lit("outside_crs")))
            return let(reason, lambda r: F.struct(F.when(r.isNull(), transform_geometry(moved, mapped_type)).alias("geometry"),
                                                  r.alias("reason")))
        return let(C.to_srid(d["geometry"], target), with_moved)
    return let(decoded, with_decoded)


def _layer_of(df: DataFrame, wkt_col: str, mapped_type: str, target: int, srid: int | str) -> DataFrame:
    keep = [c for c in df.columns if c not in (wkt_col, "geometry", "reject_reason")]
    decoded = _decoded_rows(df, wkt_col, srid, keep)
    return _expand(decoded, layer_from_decoded(F.col("_decoded"), mapped_type, target), "_decoded")


def to_layer(df: DataFrame, wkt_col: str, geometry_type: str = "footprint", crs: str = "wgs84",
             srid: int | str = C.WGS84, big_geometry_vertices: int | None = None) -> DataFrame:
    """The occurrence layer: attributes + ``geometry`` in the target CRS + ``reject_reason``.

    With ``big_geometry_vertices`` set, rows whose WKT has more vertices than
    that (counted cheaply from the text, before parsing) are validated by the
    distributed edge join of :mod:`geospan.operators.validity` instead of the
    per-row pair check, so one huge polygon is spread over many tasks; the
    rules and answers are the same. Every row is still parsed once on its own
    branch; that of the big rows is written to the checkpoint folder at once.
    """
    mapped_type, target = check_params(geometry_type, crs)
    if big_geometry_vertices is None:
        return _layer_of(df, wkt_col, mapped_type, target, srid)
    from geospan.operators.validity import invalid_geometries

    wkt = F.col(f"`{wkt_col}`")
    vertices = F.length(wkt) - F.length(F.regexp_replace(wkt, ",", "")) + 1
    small = df.filter(F.coalesce(vertices, F.lit(0)) <= big_geometry_vertices)
    big = df.filter(vertices > big_geometry_vertices)
    out_small = _layer_of(small, wkt_col, mapped_type, target, srid)
    decoded = (_decoded_rows(big, wkt_col, srid, big.columns, topology=False).withColumnRenamed("_decoded", "_d")
               .withColumn("_gid", F.monotonically_increasing_id()))
    checkpoint_dir(df.sparkSession)
    decoded = decoded.checkpoint()  # keys stay fixed: the branch is read twice below
    bad = invalid_geometries(decoded.select("_gid", F.col("_d.geometry").alias("geometry")), "_gid")
    flagged = decoded.join(bad.select(F.col("gid").alias("_gid"), F.lit(True).alias("_bad")), "_gid", "left")
    checked = F.struct(
        F.when(F.col("_bad").isNull(), F.col("_d.geometry")).alias("geometry"),
        F.when(F.col("_d.reason").isNotNull(), F.col("_d.reason"))
        .when(F.col("_bad").isNotNull(), F.lit("invalid")).alias("reason"))
    staged = flagged.select(*[F.col(f"`{c}`") for c in df.columns], checked.alias("_checked"))
    out_big = _expand(staged.drop(wkt_col), layer_from_decoded(F.col("_checked"), mapped_type, target), None)
    return out_small.unionByName(out_big.select(*out_small.columns))


def _keep(layer: DataFrame, cond: Column) -> DataFrame:
    """Filter on the decoded columns without re-running the decode.

    Catalyst pushes a filter below the projection that computes its columns
    and then evaluates the (expensive) decode twice. ``spark_partition_id()``
    is non-deterministic, which stops that push; it costs nothing to compute.
    Filters on source columns should be applied before :func:`to_layer` and
    still reach the scan.
    """
    return (layer.withColumn("_pid", F.spark_partition_id())
            .filter(cond & (F.col("_pid") >= 0)).drop("_pid"))


def good_rows(layer: DataFrame) -> DataFrame:
    """the usable rows (``reject_reason`` is null)."""
    return _keep(layer, F.col("reject_reason").isNull()).drop("reject_reason")


def rejected_rows(layer: DataFrame) -> DataFrame:
    """The quarantine: rejected rows with their reason."""
    return _keep(layer, F.col("reject_reason").isNotNull()).drop("geometry")


def reject_rollup(layer: DataFrame) -> DataFrame:
    """A01 + A02: rows per outcome ('ok' or the reject reason)."""
    return (layer.groupBy(F.coalesce(F.col("reject_reason"), F.lit("ok")).alias("outcome"))
            .agg(F.count(F.lit(1)).alias("n_rows")))
