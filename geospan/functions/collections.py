"""Geometry-collection normalisation (G06-G09) as column expressions.

A parsed GEOMETRYCOLLECTION arrives as ``members: array<struct<gtype, parts>>``.
The rules, in order:

* one member            -> that member (not recursive);
* all Point / LineString / Polygon     -> the Multi type of the members;
* all MultiPoint / MultiLineString / MultiPolygon -> one Multi with all parts;
* anything else ("mixed") -> points and lines are buffered by
  ``BUFFER_DISTANCE`` degrees, polygons kept, and everything dissolved into a
  MultiPolygon.

The dissolve is done exactly when the pieces have pairwise disjoint bounding
boxes (then the union is the plain concatenation). Pieces that overlap, and
lines with more than two vertices, would need a general polygon overlay; such
rows get the reason ``needs_overlay`` instead of a guessed shape.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from geospan.functions.geometry import let, seq
from geospan.functions.wkt import PARTS_DDL

# Buffer distance in degrees and segments per quarter circle.
BUFFER_DISTANCE = 0.00001
QUADRANT_SEGMENTS = 16

_FULL = 4 * QUADRANT_SEGMENTS          # segments in a full circle
_STEP = 2 * math.pi / _FULL


def circle_ring(x: Column, y: Column, r: float = BUFFER_DISTANCE) -> Column:
    """Clockwise ring of the point buffer, starting east of the centre."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(_FULL)),
        lambda k: F.array(x + F.cos(-(k % _FULL) * _STEP) * r, y + F.sin(-(k % _FULL) * _STEP) * r),
    )


def capsule_ring(p: Column, q: Column, r: float = BUFFER_DISTANCE) -> Column:
    """Round-capped buffer of the segment p->q, clockwise."""
    ang = F.atan2(q[1] - p[1], q[0] - p[0])
    half = 2 * QUADRANT_SEGMENTS

    def arc(c, start):
        return F.transform(
            F.sequence(F.lit(0), F.lit(half)),
            lambda k: F.array(c[0] + F.cos(start - k * (math.pi / half)) * r,
                              c[1] + F.sin(start - k * (math.pi / half)) * r),
        )

    around_q = arc(q, ang + math.pi / 2)
    around_p = arc(p, ang - math.pi / 2)
    return F.concat(around_q, around_p, F.slice(around_q, 1, 1))


def _box(poly: Column) -> Column:
    pts = F.flatten(poly)
    xs = F.transform(pts, lambda p: p[0])
    ys = F.transform(pts, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
                    F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def _pieces(members: Column) -> Column:
    """Polygon parts of the buffered members (array of polygons = array of rings)."""
    def of_member(m):
        g = m["gtype"]
        return (
            F.when(g.isin("POINT", "MULTIPOINT"),
                   F.transform(m["parts"], lambda pa: F.array(circle_ring(pa[0][0][0], pa[0][0][1]))))
            .when(g.isin("LINESTRING", "MULTILINESTRING"),
                  F.transform(m["parts"], lambda pa: F.array(capsule_ring(pa[0][0], F.element_at(pa[0], -1)))))
            .otherwise(m["parts"])
        )
    return F.flatten(F.transform(members, of_member))


def _pairwise_disjoint(polys: Column) -> Column:
    return let(F.transform(polys, _box), _boxes_disjoint)


def _boxes_disjoint(boxes: Column) -> Column:
    n = F.size(boxes)
    return F.forall(
        seq(0, n - 1),
        lambda i: F.forall(
            seq(0, n - 1),
            lambda j: (i == j) | (boxes[i]["x1"] < boxes[j]["x0"]) | (boxes[j]["x1"] < boxes[i]["x0"])
            | (boxes[i]["y1"] < boxes[j]["y0"]) | (boxes[j]["y1"] < boxes[i]["y0"]),
        ),
    )


def normalize(parsed: Column) -> Column:
    """parse_wkt output -> ``struct<gtype, parts, reason>`` with collections resolved."""
    return let(parsed, _normalize)


def _normalize(parsed: Column) -> Column:
    members = parsed["members"]
    is_coll = parsed["gtype"] == "GEOMETRYCOLLECTION"

    def resolved(types):
        one_type = F.size(types) == 1
        t0 = types[0]
        flat_parts = F.flatten(F.transform(members, lambda m: m["parts"]))
        long_line = F.exists(members, lambda m: m["gtype"].isin("LINESTRING", "MULTILINESTRING") & F.exists(
            m["parts"], lambda pa: F.size(pa[0]) != 2))
        bad_line = F.exists(members, lambda m: m["gtype"].isin("LINESTRING", "MULTILINESTRING") & F.exists(
            m["parts"], lambda pa: F.size(F.array_distinct(pa[0])) < 2))
        mixed = (F.size(members) > 1) & ~one_type

        def with_pieces(pieces):
            coll_type = (
                F.when(F.size(members) == 1, members[0]["gtype"])
                .when(one_type & t0.startswith("MULTI"), t0)
                .when(one_type, F.concat(F.lit("MULTI"), t0))
                .otherwise(F.lit("MULTIPOLYGON"))
            )
            coll_parts = (
                F.when(F.size(members) == 1, members[0]["parts"])
                .when(one_type, flat_parts)
                .otherwise(pieces)
            )
            coll_reason = (
                F.when(bad_line, F.lit("invalid"))
                .when(mixed & (long_line | ~_pairwise_disjoint(pieces)), F.lit("needs_overlay"))
            )
            return F.struct(coll_type.alias("gtype"), coll_parts.cast(PARTS_DDL).alias("parts"),
                            coll_reason.alias("reason"))

        return let(F.when(mixed & ~long_line, _pieces(members)).cast(PARTS_DDL), with_pieces)

    def collection(_):
        return let(F.array_distinct(F.transform(members, lambda m: m["gtype"])), resolved)

    def finish(c):
        reason = F.when(parsed["reason"].isNotNull(), parsed["reason"]).when(is_coll, c["reason"])
        return F.struct(
            F.when(is_coll, c["gtype"]).otherwise(parsed["gtype"]).alias("gtype"),
            F.when(reason.isNull(), F.when(is_coll, c["parts"]).otherwise(parsed["parts"]))
            .cast(PARTS_DDL).alias("parts"),
            reason.alias("reason"),
        )

    coll = F.when(is_coll & parsed["reason"].isNull(), collection(F.lit(None)))
    return let(coll, finish)
