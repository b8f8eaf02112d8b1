"""G04 as a distributed job: polygon validity by a grid self-join of edges.

The per-row check (:mod:`geospan.functions.validity`) compares every pair of
edges of a geometry inside one task. For geometries with very many vertices
that is quadratic work in one row, so this operator spreads it out:

1. every edge becomes a row ``(gid, part, ring, index, x1, y1, x2, y2)``;
2. each geometry gets a grid sized to about one edge per cell, computed within
   its row, and every edge is copied to the cells that it passes;
3. edges are self-joined on ``(gid, cell)`` — only edges that share a cell
   are compared, never all pairs of a geometry, and a dense cell is dealt to
   several tasks — and the same conflict rules as the per-row check are applied;
4. the vertices of geometries with several rings are tested against the other
   rings by a ray cast joined on ``(gid, y-band)``, with the per-row rules:
   holes lie in their shell and not in each other, polygons not in each other;
5. vertices that lie on another ring of their polygon make a graph of rings and
   touching points, whose cycles cut the interior.

Small geometries take the same steps within a batch of rows
(:mod:`geospan.functions.grid`): all their edges come out of one row, so no edge
of theirs is shuffled. Only the others are exploded into rows.

The result is the set of invalid geometry ids, which is small next to the
input; the caller anti-joins it (AQE turns that into a broadcast join when
the runtime size allows, and keeps a shuffle join otherwise).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geospan.functions.geometry import POLYGONAL, seq
from geospan.functions.grid import COPIES, EDGES, FEW, invalid_small, points_in
from geospan.functions.plain import cyclic_touches
from geospan.functions.validity import boxes_meet, dedup_ring, edge_conflict, orient, within
from geospan.functions.wkt import GEOM_TYPE, PARTS_DDL, let
from geospan.session import stored

#: A cell with more edges than this is dealt to several tasks.
DENSE = 512


def _cell_size(width, height, n, travel, reach):
    """About one edge a cell, but no smaller than keeps the copies of edges at ``COPIES`` or than doubles can tell apart."""
    span = F.greatest(width, height)
    size = F.greatest(span / F.ceil(F.sqrt(F.greatest(n, F.lit(1)))), travel / (n * COPIES), reach * 1e-11)
    return F.when(span <= 0, F.lit(1.0)).when(n <= FEW, span * 2).otherwise(size)


def _axis(k: int):
    return lambda p: p[k]


def _grid_of(parts):
    """``gx0, gy0, cell`` of one geometry, from its own coordinates, so that no edge is joined with its geometry's bounds."""
    def grid(points):
        xs, ys = (F.transform(points, _axis(axis)) for axis in (0, 1))
        travel = F.aggregate(F.flatten(parts), F.lit(0.0), lambda acc, ring: acc + F.aggregate(
            seq(1, F.size(ring) - 1), F.lit(0.0),
            lambda s, k: s + F.abs(ring[k][0] - ring[k - 1][0]) + F.abs(ring[k][1] - ring[k - 1][1])))
        box = F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
        return let(box, lambda q: F.struct(
            q["x0"].alias("gx0"), q["y0"].alias("gy0"),
            _cell_size(q["x1"] - q["x0"], q["y1"] - q["y0"], F.size(points), travel,
                       F.greatest(*[F.abs(q[c]) for c in ("x0", "x1", "y0", "y1")])).alias("cell")))
    return let(F.flatten(F.flatten(parts)), grid)


def edges_of(df: DataFrame, gid: str = "_gid", geom: str = "geometry") -> DataFrame:
    """One row per edge of every polygonal geometry (rings de-duplicated), with the grid of its geometry."""
    poly = df.filter(F.col(f"{geom}.gtype").isin(*POLYGONAL)).select(F.col(gid).alias("gid"), F.col(f"{geom}.parts").alias("parts"))
    parts = poly.withColumn("grid", _grid_of(F.col("parts"))).select("gid", "grid", F.posexplode("parts").alias("j", "rings"))
    rings = parts.select("gid", "grid", "j", F.posexplode("rings").alias("r", "ring")) \
        .withColumn("ring", dedup_ring(F.col("ring"))).withColumn("m", F.greatest(F.size("ring") - 1, F.lit(0)))
    # Ends are paired before they are exploded: a ring carried along would be copied for each of its edges.
    ends = F.zip_with(F.slice("ring", 1, F.col("m")), F.slice("ring", 2, F.col("m")), lambda p, q: F.struct(
        p[0].alias("x1"), p[1].alias("y1"), q[0].alias("x2"), q[1].alias("y2")))
    return (rings.select("gid", "grid", "j", "r", "m", F.posexplode(ends).alias("i", "e"))
            .select("gid", "j", "r", "i", "m", "e.x1", "e.y1", "e.x2", "e.y2", "grid.gx0", "grid.gy0", "grid.cell"))


def _with_grid(edges: DataFrame) -> DataFrame:
    """The grid of each geometry for edges that came without one."""
    if "cell" in edges.columns:
        return edges
    stats = edges.groupBy("gid").agg(
        F.min(F.least("x1", "x2")).alias("gx0"), F.min(F.least("y1", "y2")).alias("gy0"),
        F.max(F.greatest("x1", "x2")).alias("gx1"), F.max(F.greatest("y1", "y2")).alias("gy1"),
        F.sum(F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))).alias("travel"), F.count(F.lit(1)).alias("n_edges"))
    corners = [F.abs(c) for c in ("gx0", "gx1", "gy0", "gy1")]
    cell = _cell_size(F.col("gx1") - F.col("gx0"), F.col("gy1") - F.col("gy0"), F.col("n_edges"), F.col("travel"), F.greatest(*corners))
    return edges.join(stats.select("gid", "gx0", "gy0", cell.alias("cell")), "gid")


def grid_cells(edges: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the edges with ``cell_id``, one row for each cell of its geometry's grid that an edge passes.

    In each column of cells the rows are those of the part of the edge that lies
    in it, with a thousandth of a cell to spare for rounding, and never beyond
    the edge's own box: a long edge has as many copies as the cells along it,
    not those of its box. Edges that touch share the cell of the touching point.
    """
    g = _with_grid(edges)
    size, spare = F.col("cell"), F.col("cell") * 1e-3
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")

    def cell_of(v, v0):
        return F.floor((v - F.col(v0)) / size).cast("long")

    def y_at(x):
        at = F.least(F.greatest((x - F.col("x1")) / dx, F.lit(0.0)), F.lit(1.0))
        return F.col("y1") + at * dy

    def rows_of(cx):
        low = F.col("gx0") + cx * size - spare
        ends = F.when(dx == 0, F.struct(F.col("y1").alias("a"), F.col("y2").alias("b"))).otherwise(
            F.struct(y_at(F.greatest(low, left)).alias("a"), y_at(F.least(low + size + 2 * spare, right)).alias("b")))
        first, last = cell_of(F.least("y1", "y2"), "gy0"), cell_of(F.greatest("y1", "y2"), "gy0")
        return let(ends, lambda e: F.sequence(
            F.least(F.greatest(cell_of(F.least(e["a"], e["b"]) - spare, "gy0"), first), last),
            F.greatest(F.least(cell_of(F.greatest(e["a"], e["b"]) + spare, "gy0"), last), first)))

    return g.select(*columns, F.explode(F.flatten(F.transform(
        F.sequence(cell_of(left, "gx0"), cell_of(right, "gx0")),
        lambda cx: F.transform(rows_of(cx), lambda cy: cx * 4294967296 + cy)))).alias("cell_id"))


def spread_cells(cells: DataFrame, dense: int = DENSE) -> tuple[DataFrame, DataFrame]:
    """Two sides of a self-join of ``cells`` on ``gid, cell_id, salt``.

    A cell of more than ``dense`` edges is dealt by hash to as many salts as it
    has that many: one side lies in its salt, the other in all of them, so that
    each pair meets once and no cell is one task's work.
    """
    full = cells.groupBy("gid", "cell_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > dense).select(
        "gid", "cell_id", F.ceil(F.col("n") / dense).cast("int").alias("salts"))
    salted = cells.join(full, ["gid", "cell_id"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    own = F.pmod(F.xxhash64("j", "r", "i"), F.col("salts")).cast("int")
    return (salted.withColumn("salt", own).drop("salts"),
            salted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"))


def invalid_by_edges(edges: DataFrame) -> DataFrame:
    """Geometry ids with a forbidden edge contact (crossing, touching, overlap)."""
    cells = grid_cells(edges, ["gid", "j", "r", "i", "m", "x1", "y1", "x2", "y2"])
    left, right = spread_cells(cells)
    a, b = left.alias("a"), right.alias("b")
    key_a = F.struct(F.col("a.j"), F.col("a.r"), F.col("a.i"))
    key_b = F.struct(F.col("b.j"), F.col("b.r"), F.col("b.i"))
    pairs = a.join(b, (F.col("a.gid") == F.col("b.gid")) & (F.col("a.cell_id") == F.col("b.cell_id"))
                   & (F.col("a.salt") == F.col("b.salt")) & (key_a < key_b))
    sa = F.struct(*[F.col(f"a.{c}").alias(c) for c in ("j", "r", "i", "m", "x1", "y1", "x2", "y2")])
    sb = F.struct(*[F.col(f"b.{c}").alias(c) for c in ("j", "r", "i", "m", "x1", "y1", "x2", "y2")])
    return pairs.filter(boxes_meet(sa, sb) & edge_conflict(sa, sb)).select(F.col("a.gid").alias("gid")).distinct()


def _by_band(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and vertices of geometries with several rings, with the bands of y that they reach: ``lines, probes``."""
    rings = edges.groupBy("gid", "j", "r").agg(F.min("y1").alias("lo"), F.max("y1").alias("hi"), F.count(F.lit(1)).alias("n"),
                                               F.sum(F.abs(F.col("y2") - F.col("y1"))).alias("travel"))
    stats = rings.groupBy("gid").agg(F.min("lo").alias("y0"), F.max("hi").alias("top"), F.sum("n").alias("n"),
                                     F.sum("travel").alias("travel"), F.count(F.lit(1)).alias("n_rings"))
    height = F.col("top") - F.col("y0")
    # As many bands as keep the copies of edges at about two for each edge.
    bands = F.when(F.col("travel") > 0, F.greatest(F.lit(1.0), F.ceil(F.col("n") * height / F.col("travel")))).otherwise(1.0)
    stats = stats.filter("n_rings > 1").select("gid", "y0", F.when(height > 0, height / bands).otherwise(1.0).alias("h"))
    cut = edges.join(stats, "gid")

    def band(v):
        return F.floor((v - F.col("y0")) / F.col("h")).cast("long")
    lines = cut.select("gid", F.col("j").alias("tj"), F.col("r").alias("tr"), "x1", "y1", "x2", "y2",
                       F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))).alias("band"))
    probes = cut.select("gid", "j", "r", "i", F.col("x1").alias("px"), F.col("y1").alias("py"), band(F.col("y1")).alias("band"))
    return lines, probes


def _on_line():
    edge = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    return (orient(*edge.values(), F.col("px"), F.col("py")) == 0) & within(edge, F.col("px"), F.col("py"))


def invalid_nesting(edges: DataFrame) -> DataFrame:
    """Geometry ids whose rings lie in each other in a way the per-row rules forbid.

    Every vertex is tested against the edges of the other rings that share its
    y-band, so a ring that passes through a touching point is seen as well.
    """
    lines, probes = _by_band(edges)
    # A hole is asked about the rings of its own polygon, a shell about all other polygons.
    asked = F.when(F.col("r") > 0, (F.col("tj") == F.col("j")) & (F.col("tr") != F.col("r"))).otherwise(F.col("tj") != F.col("j"))
    spans = (F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))
    crosses = F.when(spans, F.col("px") < (F.col("x2") - F.col("x1")) * (F.col("py") - F.col("y1"))
                     / (F.col("y2") - F.col("y1")) + F.col("x1")).otherwise(False)
    on = _on_line()
    met = (probes.join(lines, ["gid", "band"]).filter(asked).select("gid", "j", "r", "i", "tj", "tr", crosses.alias("crosses"),
                                                                    on.alias("on"))
           .filter("crosses or on").groupBy("gid", "j", "r", "i", "tj", "tr")
           .agg((F.count_if("crosses") % 2 == 1).alias("inside"), F.max("on").alias("on")))
    seen = met.groupBy("gid", "j", "r", "i", "tj").agg(
        F.max(F.expr("tr = 0 and (inside or on)")).alias("in_shell"),
        F.max(F.expr("tr = 0 and inside and not on")).alias("well_in_shell"),
        F.max(F.expr("tr > 0 and (inside or on)")).alias("in_hole"),
        F.max(F.expr("tr > 0 and inside and not on")).alias("well_in_hole"))
    nested = seen.filter("case when r > 0 then well_in_hole else well_in_shell and not in_hole end").select("gid")
    out_of_shell = probes.filter("r > 0").join(seen.filter("r > 0 and in_shell"), ["gid", "j", "r", "i"], "left_anti").select("gid")
    return nested.union(out_of_shell).distinct()


def invalid_interior(edges: DataFrame) -> DataFrame:
    """Geometry ids of which touching rings cut a polygon's interior in two.

    Vertices that lie on another ring of their polygon come from the join on
    y-bands; only these touches, few in sane data, are gathered by polygon,
    and many polygons are decided in one batch.
    """
    lines, probes = _by_band(edges)
    met = probes.join(lines, ["gid", "band"]).filter((F.col("tj") == F.col("j")) & (F.col("tr") != F.col("r")) & _on_line())
    ends = met.select("gid", "j", F.explode(F.array("r", "tr")).alias("r"), F.col("px").alias("x"), F.col("py").alias("y")).distinct()
    held = ends.groupBy("gid", "j").agg(F.collect_list(F.struct("r", "x", "y")).alias("touches"))
    return held.filter(cyclic_touches(F.col("touches"))).select("gid").distinct()


def invalid_geometries(df: DataFrame, gid: str = "_gid", geom: str = "geometry") -> DataFrame:
    """G04 (edges, nesting of rings, connected interior) over a whole table: the ids of invalid polygonal rows.

    ``df`` is read twice, small geometries and large: store it or cut it with a
    checkpoint. The joins of the small ones are made at once, in one pass over
    the rows; what it finds, and the geometries left to the shuffled joins, are
    kept in the checkpoint folder.
    """
    poly = df.filter(F.col(f"{geom}.gtype").isin(*POLYGONAL)).select(F.col(gid).alias("gid"), F.col(f"{geom}.parts").alias("parts"))
    large = poly.filter(points_in(F.col("parts")) > EDGES).select("gid", F.lit(None).cast("boolean").alias("bad"), "parts")
    held = stored(invalid_small(poly).union(large))
    left = held.filter("bad is null").select("gid", F.struct(F.lit("MULTIPOLYGON").alias("gtype"), F.lit(4326).alias("srid"),
                                                             F.col("parts").cast(PARTS_DDL).alias("parts")).cast(GEOM_TYPE).alias("geometry"))
    edges = edges_of(left, "gid")
    small = held.filter("bad").select("gid")
    return small.union(invalid_by_edges(edges)).union(invalid_nesting(edges)).union(invalid_interior(edges)).distinct()
