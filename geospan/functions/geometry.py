"""Geometry column functions: construction, measures, centroid, envelope.

All functions take and return Spark ``Column`` expressions over the
``struct<gtype, srid, parts>`` layout of :mod:`geospan.functions.wkt`, so
they run inside the JVM over whole partitions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geospan.functions.wkt import GEOM_DDL, PARTS_DDL, let

import functools

from pyspark.sql import types as T

_INT_ARRAY = T.ArrayType(T.IntegerType())
POLYGONAL = ("POLYGON", "MULTIPOLYGON")
LINEAL = ("LINESTRING", "MULTILINESTRING")
PUNTAL = ("POINT", "MULTIPOINT")


def seq(start, stop) -> Column:
    """Inclusive integer range that is empty (never descending) when stop < start."""
    a = F.lit(start) if isinstance(start, int) else start
    b = F.lit(stop) if isinstance(stop, int) else stop
    return F.when(b >= a, F.sequence(a, b)).when(b < a, F.array().cast(_INT_ARRAY))


# ``let(value, body)``: evaluate ``value`` once and pass it to ``body`` as a
# lambda variable. Higher-order functions re-evaluate an expression each time
# it is used; binding it first keeps per-row work linear and plans small.


def bind_geometry(fn):
    """Decorator: evaluate the geometry argument once (see :func:`let`).

    Geometry functions read their argument many times; without the binding a
    nested expression (e.g. a re-projection feeding a centroid) would be copied
    into every use.
    """
    @functools.wraps(fn)
    def wrapper(geom, *args, **kwargs):
        if isinstance(geom, str):
            geom = F.col(geom)
        return let(geom, lambda g: fn(g, *args, **kwargs))
    return wrapper


def make_geom(gtype: Column, parts: Column, srid: Column | int = 4326) -> Column:
    srid_c = F.lit(srid) if isinstance(srid, int) else srid
    return F.struct(gtype.alias("gtype"), srid_c.cast(T.IntegerType()).alias("srid"), parts.cast(PARTS_DDL).alias("parts"))


def point(x: Column, y: Column, srid: int = 4326) -> Column:
    return make_geom(F.lit("POINT"), F.array(F.array(F.array(F.array(x, y)))), srid)


def all_points(geom: Column) -> Column:
    return F.flatten(F.flatten(geom["parts"]))


@bind_geometry
def num_points(geom: Column) -> Column:
    return F.size(all_points(geom))


def is_empty(geom: Column) -> Column:
    """A geometry with no coordinates."""
    return F.size(geom["parts"]) == 0


@bind_geometry
def bounds(geom: Column) -> Column:
    """``struct<minx, miny, maxx, maxy>`` over all vertices."""
    pts = all_points(geom)
    xs = F.transform(pts, lambda p: p[0])
    ys = F.transform(pts, lambda p: p[1])
    return F.struct(
        F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
        F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"),
    )


@bind_geometry
def all_finite(geom: Column) -> Column:
    """Every coordinate is a finite number (no NaN, no +-Infinity)."""
    return F.forall(all_points(geom), lambda p: (F.abs(p[0]) < F.lit(float("inf")))
                    & (F.abs(p[1]) < F.lit(float("inf"))))


@bind_geometry
def envelope(geom: Column) -> Column:
    """Bounding box as a geometry; a point stays a point, a flat box a line."""
    def of_bounds(b):
        lo = F.array(b["minx"], b["miny"])
        hi = F.array(b["maxx"], b["maxy"])
        flat_x, flat_y = b["minx"] == b["maxx"], b["miny"] == b["maxy"]
        box = F.array(lo, F.array(b["maxx"], b["miny"]), hi, F.array(b["minx"], b["maxy"]), lo)
        gtype = F.when(flat_x & flat_y, F.lit("POINT")).when(flat_x | flat_y, F.lit("LINESTRING")).otherwise(F.lit("POLYGON"))
        ring = F.when(flat_x & flat_y, F.array(lo)).when(flat_x | flat_y, F.array(lo, hi)).otherwise(box)
        return make_geom(gtype, F.array(F.array(ring)), geom["srid"])

    return F.when(geom.isNotNull() & (F.size(geom["parts"]) > 0), let(bounds(geom), of_bounds)).when(geom.isNotNull(), geom)


def _ring_moments(ring: Column) -> Column:
    """Per ring: doubled signed area, area moments and boundary length moments.

    Coordinates are taken relative to the ring's first vertex so large
    projected coordinates do not cancel.
    """
    n = F.size(ring)
    x0 = ring[0][0]
    y0 = ring[0][1]
    init = F.struct(
        F.lit(0.0).alias("c2"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"),
        F.lit(0.0).alias("len"), F.lit(0.0).alias("lx"), F.lit(0.0).alias("ly"),
    )

    def step(acc, e):
        return F.struct(
            (acc["c2"] + e["cross"]).alias("c2"),
            (acc["mx"] + e["cross"] * e["sx"]).alias("mx"),
            (acc["my"] + e["cross"] * e["sy"]).alias("my"),
            (acc["len"] + e["seg"]).alias("len"),
            (acc["lx"] + e["seg"] * e["sx"] / 2).alias("lx"),
            (acc["ly"] + e["seg"] * e["sy"] / 2).alias("ly"),
        )

    def edge(i):
        ax = ring[i][0] - x0
        ay = ring[i][1] - y0
        bx = ring[i + 1][0] - x0
        by = ring[i + 1][1] - y0
        return F.struct((ax * by - bx * ay).alias("cross"), (ax + bx).alias("sx"), (ay + by).alias("sy"),
                        F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay)).alias("seg"))

    def pack(m):
        return F.struct(
            m["c2"].alias("c2"), m["mx"].alias("mx"), m["my"].alias("my"),
            m["len"].alias("len"), m["lx"].alias("lx"), m["ly"].alias("ly"),
            x0.alias("x0"), y0.alias("y0"), n.alias("n"),
        )

    edges = F.transform(seq(0, n - 2), edge)
    return let(F.aggregate(edges, init, step), pack)


@bind_geometry
def centroid(geom: Column) -> Column:
    """Centroid point, by the highest dimension present.

    Polygons: area weighted, shells add and holes subtract whatever their
    orientation; when the area is zero the boundary's length-weighted centre
    is used, and when that length is zero the vertex mean. Lines: length
    weighted segment mid-points. Points: vertex mean.
    """
    gtype = geom["gtype"]
    # one row per ring: (moments, sign) with sign +1 for shells, -1 for holes
    rings = F.flatten(F.transform(geom["parts"], lambda pa: F.transform(
        pa, lambda r, k: F.struct(_ring_moments(r).alias("m"),
                                  F.when(k == 0, 1.0).otherwise(-1.0).alias("s")))))
    zero3 = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def area_acc(acc, rr):
        m = rr["m"]
        s = rr["s"]
        half = F.abs(m["c2"]) / 2
        sgn = F.signum(m["c2"])
        return F.struct(
            (acc["w"] + s * half).alias("w"),
            (acc["x"] + s * (half * m["x0"] + sgn * m["mx"] / 6)).alias("x"),
            (acc["y"] + s * (half * m["y0"] + sgn * m["my"] / 6)).alias("y"),
        )

    def line_acc(acc, rr):
        m = rr["m"]
        return F.struct(
            (acc["w"] + m["len"]).alias("w"),
            (acc["x"] + m["len"] * m["x0"] + m["lx"]).alias("x"),
            (acc["y"] + m["len"] * m["y0"] + m["ly"]).alias("y"),
        )

    def finish(m):
        area, line, mean = m["area"], m["line"], m["mean"]
        use_area = gtype.isin(*POLYGONAL) & (area["w"] != 0)
        use_line = ~use_area & ~gtype.isin(*PUNTAL) & (line["w"] > 0)
        cx = F.when(use_area, area["x"] / area["w"]).when(use_line, line["x"] / line["w"]) \
            .otherwise(mean["x"] / mean["w"])
        cy = F.when(use_area, area["y"] / area["w"]).when(use_line, line["y"] / line["w"]) \
            .otherwise(mean["y"] / mean["w"])
        return F.when(mean["w"] > 0,
                      make_geom(F.lit("POINT"), F.array(F.array(F.array(F.array(cx, cy)))), geom["srid"]))

    def moments(rs):
        pts = all_points(geom)
        mean = F.aggregate(pts, zero3, lambda a, p: F.struct(
            (a["w"] + 1.0).alias("w"), (a["x"] + p[0]).alias("x"), (a["y"] + p[1]).alias("y")))
        return F.struct(F.aggregate(rs, zero3, area_acc).alias("area"),
                        F.aggregate(rs, zero3, line_acc).alias("line"), mean.alias("mean"))

    # A point is its own centroid: most rows of a point layer need no moments.
    return F.when((gtype == "POINT") & (F.size(geom["parts"]) == 1), geom).when(geom.isNotNull(), let(let(rings, moments), finish))


def x_of(point_geom: Column) -> Column:
    return point_geom["parts"][0][0][0][0]


def y_of(point_geom: Column) -> Column:
    return point_geom["parts"][0][0][0][1]


@bind_geometry
def area(geom: Column) -> Column:
    """Planar area (shells minus holes) in the units of the geometry's CRS."""
    def ring_area(ring):
        def of_first(o):
            def step(acc, p):
                return F.struct((acc["c2"] + (acc["x"] * (p[1] - o[1]) - (p[0] - o[0]) * acc["y"])).alias("c2"),
                                (p[0] - o[0]).alias("x"), (p[1] - o[1]).alias("y"))
            zero = F.struct(*(F.lit(0.0).alias(c) for c in ("c2", "x", "y")))
            return F.abs(F.aggregate(ring, zero, step, lambda acc: acc["c2"])) / 2
        return let(F.get(ring, F.lit(0)), of_first)

    rings = F.flatten(F.transform(geom["parts"], lambda pa: F.transform(
        pa, lambda r, k: F.when(k == 0, 1.0).otherwise(-1.0) * ring_area(r))))
    return F.when(geom["gtype"].isin(*POLYGONAL), F.aggregate(rings, F.lit(0.0), lambda a, v: a + v)) \
        .otherwise(F.lit(0.0))


@bind_geometry
def promote_to_multi(geom: Column) -> Column:
    """Single types become their Multi type; ``parts`` already nests them."""
    gtype = geom["gtype"]
    return F.when(
        gtype.isin("POINT", "LINESTRING", "POLYGON"),
        make_geom(F.concat(F.lit("MULTI"), gtype), geom["parts"], geom["srid"]),
    ).otherwise(geom)


@bind_geometry
def simplify_single_part(geom: Column) -> Column:
    """A Multi* with exactly one member becomes that member; null stays null."""
    gtype = geom["gtype"]
    return F.when(
        gtype.startswith("MULTI") & (F.size(geom["parts"]) == 1),
        make_geom(F.substring(gtype, 6, 100), geom["parts"], geom["srid"]),
    ).otherwise(geom)


@bind_geometry
def type_name(geom: Column) -> Column:
    """The class name as the geometry library spells it (e.g. 'MultiPolygon')."""
    gtype = geom["gtype"]
    return (
        F.when(gtype == "POINT", "Point").when(gtype == "LINESTRING", "LineString")
        .when(gtype == "POLYGON", "Polygon").when(gtype == "MULTIPOINT", "MultiPoint")
        .when(gtype == "MULTILINESTRING", "MultiLineString")
        .when(gtype == "MULTIPOLYGON", "MultiPolygon")
    )


__all__ = [
    "GEOM_DDL", "make_geom", "point", "all_points", "num_points", "is_empty", "bounds",
    "all_finite", "envelope", "centroid", "x_of", "y_of", "area", "promote_to_multi",
    "simplify_single_part", "type_name",
]
