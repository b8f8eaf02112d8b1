"""Geometry validity (G03 structure, G04 topology) as column expressions.

Structure: finite coordinates, line strings with two distinct points, rings
with four points once consecutive repeats are dropped.

Topology (polygonal types only), by the simple-features rules:

* a ring may not touch or cross itself (adjacent edges may only share their
  common vertex);
* rings of one polygon, and polygons of one multipolygon, may touch at
  points but may not cross or share an edge;
* every hole lies inside its shell, holes do not nest, and no polygon of a
  multipolygon lies inside another (outside that one's holes);
* the interior of a polygon is connected: rings and the points at which they
  touch, taken as a graph, have no cycle (a hole that touches the shell at two
  points, or a ring of holes that touch each other, cuts the interior).

The per-row check here compares all edge pairs, with a bounding-box test
first; a single convex ring (the common case) skips the pair test. The
shuffle-based version for very large rings is in
:mod:`geospan.operators.validity`, which reuses the edge predicates below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geospan.functions.geometry import POLYGONAL, all_finite, bind_geometry, let, seq

_INF = float("inf")
_TOUCHES = T.ArrayType(T.StructType([T.StructField("r", T.IntegerType()), T.StructField("x", T.DoubleType()),
                                     T.StructField("y", T.DoubleType())]))


def dedup_ring(ring: Column) -> Column:
    """Drop consecutive repeated vertices (they carry no shape)."""
    return F.filter(ring, lambda p, k: (k == 0) | (p != ring[k - 1]))


@bind_geometry
def structurally_valid(geom: Column) -> Column:
    """Finite coordinates plus :func:`well_shaped`."""
    return all_finite(geom) & well_shaped(geom)


@bind_geometry
def well_shaped(geom: Column) -> Column:
    """Lines with two distinct points, rings with four points after de-duplication."""
    gtype = geom["gtype"]
    lines_ok = F.forall(geom["parts"], lambda pa: F.forall(pa, lambda r: F.size(F.array_distinct(r)) >= 2))
    rings_ok = F.forall(geom["parts"], lambda pa: F.forall(pa, lambda r: F.size(dedup_ring(r)) >= 4))
    shape = (
        F.when(gtype.isin("LINESTRING", "MULTILINESTRING"), lines_ok)
        .when(gtype.isin(*POLYGONAL), rings_ok)
        .otherwise(F.lit(True))
    )
    return shape


# ------------------------------------------------------------ edge predicates

def orient(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area of (a, b, c); > 0 when c is left of a->b."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def within(s, px, py) -> Column:
    return ((px >= F.least(s["x1"], s["x2"])) & (px <= F.greatest(s["x1"], s["x2"]))
            & (py >= F.least(s["y1"], s["y2"])) & (py <= F.greatest(s["y1"], s["y2"])))


def boxes_meet(s, t) -> Column:
    return ((F.least(s["x1"], s["x2"]) <= F.greatest(t["x1"], t["x2"]))
            & (F.least(t["x1"], t["x2"]) <= F.greatest(s["x1"], s["x2"]))
            & (F.least(s["y1"], s["y2"]) <= F.greatest(t["y1"], t["y2"]))
            & (F.least(t["y1"], t["y2"]) <= F.greatest(s["y1"], s["y2"])))


def edge_conflict(s, t) -> Column:
    """True when edges ``s`` and ``t`` (structs with j, r, i, m, x1, y1, x2, y2)
    meet in a way the validity rules forbid. ``j`` is the polygon, ``r`` the
    ring, ``i`` the edge's index in its ring and ``m`` the ring's edge count."""
    d1 = orient(t["x1"], t["y1"], t["x2"], t["y2"], s["x1"], s["y1"])
    d2 = orient(t["x1"], t["y1"], t["x2"], t["y2"], s["x2"], s["y2"])
    d3 = orient(s["x1"], s["y1"], s["x2"], s["y2"], t["x1"], t["y1"])
    d4 = orient(s["x1"], s["y1"], s["x2"], s["y2"], t["x2"], t["y2"])
    proper = (d1 * d2 < 0) & (d3 * d4 < 0)
    touch = (((d1 == 0) & within(t, s["x1"], s["y1"])) | ((d2 == 0) & within(t, s["x2"], s["y2"]))
             | ((d3 == 0) & within(s, t["x1"], t["y1"])) | ((d4 == 0) & within(s, t["x2"], t["y2"])))
    by_x = F.abs(s["x2"] - s["x1"]) >= F.abs(s["y2"] - s["y1"])
    lo_x = F.greatest(F.least(s["x1"], s["x2"]), F.least(t["x1"], t["x2"]))
    hi_x = F.least(F.greatest(s["x1"], s["x2"]), F.greatest(t["x1"], t["x2"]))
    lo_y = F.greatest(F.least(s["y1"], s["y2"]), F.least(t["y1"], t["y2"]))
    hi_y = F.least(F.greatest(s["y1"], s["y2"]), F.greatest(t["y1"], t["y2"]))
    overlap = (d1 == 0) & (d2 == 0) & F.when(by_x, lo_x < hi_x).otherwise(lo_y < hi_y)
    same_ring = (s["j"] == t["j"]) & (s["r"] == t["r"])
    gap = F.abs(s["i"] - t["i"])
    adjacent = same_ring & ((gap == 1) | (gap == s["m"] - 1))
    return (
        F.when(adjacent, overlap)
        .when(same_ring, proper | touch | overlap)
        .otherwise(proper | overlap)
    )


def ring_edges(ring_expr: Column, j, r) -> Column:
    """Edges of one (de-duplicated) ring as structs for :func:`edge_conflict`."""
    return let(ring_expr, lambda ring: _ring_edges(ring, j, r))


def _ring_edges(ring: Column, j, r) -> Column:
    m = F.size(ring) - 1
    return F.transform(
        seq(0, m - 1),
        lambda i: F.struct(
            F.lit(j).alias("j") if not isinstance(j, Column) else j.alias("j"),
            F.lit(r).alias("r") if not isinstance(r, Column) else r.alias("r"),
            i.alias("i"), m.alias("m"),
            ring[i][0].alias("x1"), ring[i][1].alias("y1"),
            ring[i + 1][0].alias("x2"), ring[i + 1][1].alias("y2"),
        ),
    )


def polygon_edges(parts: Column) -> Column:
    return F.flatten(F.flatten(F.transform(
        parts, lambda pa, j: F.transform(pa, lambda ring, r: ring_edges(dedup_ring(ring), j, r)))))


# ------------------------------------------------------------- ring tests

def _on_ring(ring: Column, px: Column, py: Column) -> Column:
    return F.exists(
        seq(0, F.size(ring) - 2),
        lambda k: (orient(ring[k][0], ring[k][1], ring[k + 1][0], ring[k + 1][1], px, py) == 0)
        & (px >= F.least(ring[k][0], ring[k + 1][0])) & (px <= F.greatest(ring[k][0], ring[k + 1][0]))
        & (py >= F.least(ring[k][1], ring[k + 1][1])) & (py <= F.greatest(ring[k][1], ring[k + 1][1])),
    )


def _inside_ring(ring: Column, px: Column, py: Column) -> Column:
    """Even-odd ray cast (boundary points are decided by :func:`_on_ring`)."""
    crossings = F.aggregate(
        seq(0, F.size(ring) - 2), F.lit(0),
        lambda acc, k: acc + F.when(
            ((ring[k][1] > py) != (ring[k + 1][1] > py))
            & (px < (ring[k + 1][0] - ring[k][0]) * (py - ring[k][1]) / (ring[k + 1][1] - ring[k][1]) + ring[k][0]),
            1).otherwise(0),
    )
    return crossings % 2 == 1


def _strictly_inside(ring, p) -> Column:
    return ~_on_ring(ring, p[0], p[1]) & _inside_ring(ring, p[0], p[1])


def _touches(rings: Column) -> Column:
    """Where rings of one polygon touch: distinct ``struct<r, x, y>``, one for each ring at each point."""
    def between(a, b):
        at = F.filter(rings[a], lambda p: _on_ring(rings[b], p[0], p[1]))
        return F.when(a != b, F.flatten(F.transform(at, lambda p: F.array(*[
            F.struct(r.cast("int").alias("r"), p[0].alias("x"), p[1].alias("y")) for r in (a, b)]))))
    last = F.size(rings) - 1
    found = F.flatten(F.transform(seq(0, last), lambda a: F.flatten(F.transform(
        seq(0, last), lambda b: F.coalesce(between(a, b), F.array().cast(_TOUCHES))))))
    return F.array_distinct(found)


def _cyclic(touches: Column) -> Column:
    """Whether the graph of rings and touching points has a cycle: what is left when ends are taken off again and again."""
    def cut(held, _):
        return F.filter(held, lambda t: F.exists(held, lambda o: (o["r"] == t["r"]) & ((o["x"] != t["x"]) | (o["y"] != t["y"])))
                        & F.exists(held, lambda o: (o["r"] != t["r"]) & (o["x"] == t["x"]) & (o["y"] == t["y"])))
    return F.size(F.aggregate(seq(1, F.size(touches)), touches, cut)) > 0


def interior_cut(geom: Column) -> Column:
    """Whether touching rings cut the interior of a polygon of ``geom`` in two.

    A rule of its own, applied to a decoded column: as a part of the expressions
    below, Spark's analysis of their nested functions would take minutes.
    """
    return geom["gtype"].isin(*POLYGONAL) & F.exists(
        geom["parts"], lambda rings: (F.size(rings) > 1) & let(_touches(rings), _cyclic))


def _convex_simple(ring: Column) -> Column:
    """A ring that is convex and simple: every turn has the same strict sign
    and the edge directions go round once (the x and y components of the
    edges each change sign at most twice). Repeated points or collinear runs
    make the test fail, which only sends the ring to the full check."""
    m = F.size(ring) - 1

    def turn_sign(k):
        a = ring[k]
        b = ring[k + 1]
        c = ring[F.when(k + 2 > m, 1).otherwise(k + 2)]
        return F.signum((b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]))

    def sign_changes(axis):
        signs = F.filter(F.transform(seq(0, m - 1), lambda k: F.signum(ring[k + 1][axis] - ring[k][axis])),
                         lambda v: v != 0)
        return let(signs, lambda sg: F.size(F.filter(
            seq(0, F.size(sg) - 1), lambda i: sg[i] != sg[(i + 1) % F.size(sg)])))

    turns = F.transform(seq(0, m - 1), turn_sign)
    same = let(turns, lambda t: F.forall(t, lambda v: v == F.get(t, 0)) & (F.get(t, 0) != 0))
    return (m >= 3) & same & (sign_changes(0) <= 2) & (sign_changes(1) <= 2)


def _full_check(parts: Column) -> Column:
    """Every rule over all edges and rings of ``parts`` (quadratic in edges)."""
    def clash(edges):
        n = F.size(edges)
        return F.exists(
            seq(0, n - 2),
            lambda a: let(edges[a], lambda ea: F.exists(
                F.slice(edges, a + 2, 1 << 30),
                lambda eb: boxes_meet(ea, eb) & edge_conflict(ea, eb),
            )),
        )

    edge_clash = let(polygon_edges(parts), clash)
    hole_outside = F.exists(parts, lambda pa: F.exists(
        F.slice(pa, 2, 1 << 30),
        lambda h: F.exists(h, lambda p: ~_on_ring(pa[0], p[0], p[1]) & ~_inside_ring(pa[0], p[0], p[1]))))
    nested_holes = F.exists(parts, lambda pa: F.exists(
        seq(1, F.size(pa) - 1),
        lambda a: F.exists(
            seq(1, F.size(pa) - 1),
            lambda b: (a != b) & F.exists(pa[a], lambda p: _strictly_inside(pa[b], p)))))
    k = F.size(parts)

    def inside_part(b, p):
        in_hole = F.exists(F.slice(parts[b], 2, 1 << 30),
                           lambda h: _on_ring(h, p[0], p[1]) | _inside_ring(h, p[0], p[1]))
        return _strictly_inside(parts[b][0], p) & ~in_hole

    nested_parts = F.exists(
        seq(0, k - 1),
        lambda a: F.exists(
            seq(0, k - 1),
            lambda b: (a != b) & F.exists(parts[a][0], lambda p: inside_part(b, p))))
    return ~edge_clash & ~hole_outside & ~nested_holes & ~nested_parts


def _shell_box(pa: Column) -> Column:
    xs = F.transform(pa[0], lambda p: p[0])
    ys = F.transform(pa[0], lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
                    F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def _boxes_apart(boxes: Column) -> Column:
    """Shell boxes pairwise disjoint (not even touching)."""
    n = F.size(boxes)
    return F.forall(seq(0, n - 1), lambda i: F.forall(
        seq(i + 1, n - 1),
        lambda j: (boxes[i]["x1"] < boxes[j]["x0"]) | (boxes[j]["x1"] < boxes[i]["x0"])
        | (boxes[i]["y1"] < boxes[j]["y0"]) | (boxes[j]["y1"] < boxes[i]["y0"])))


@bind_geometry
def topology_valid_inrow(geom: Column) -> Column:
    """G04 for one row: no forbidden edge contacts and correct ring nesting.

    Polygons whose shell boxes are pairwise apart cannot touch each other, so
    each is checked alone; a polygon without holes whose shell is convex and
    simple needs no edge-pair test at all. Only the rest pays the full
    quadratic check.
    """
    parts = geom["parts"]

    def part_ok(pa):
        return ((F.size(pa) == 1) & _convex_simple(pa[0])) | _full_check(F.array(pa))

    apart = let(F.transform(parts, _shell_box), _boxes_apart)
    return F.when(parts.isNull(), F.lit(None).cast(T.BooleanType())) \
        .when(~geom["gtype"].isin(*POLYGONAL), F.lit(True)) \
        .when(F.size(parts) == 1, part_ok(parts[0])) \
        .when(apart, F.forall(parts, part_ok)) \
        .otherwise(_full_check(parts))


@bind_geometry
def is_valid(geom: Column) -> Column:
    """Structure and topology but for :func:`interior_cut`; null geometry is not valid."""
    return F.coalesce(structurally_valid(geom) & topology_valid_inrow(geom), F.lit(False))
