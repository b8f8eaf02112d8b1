"""G09 as a distributed job: the union of overlapping pieces by an arrangement of their edges.

Mixed collections whose buffered members are not apart (``needs_overlay``) are
dissolved here, many geometries at a time:

1. points and line segments become their buffers, every ring is turned so that
   its interior lies to the left, and edges become rows;
2. edges of different pieces that share a grid cell of their geometry are held
   against each other; where two meet, both are cut at the same point;
3. sub-edges of one place are one; two of opposite direction have the interior
   on both sides and vanish;
4. a sub-edge whose middle lies inside another piece (a ray cast joined on
   y-bands) is not on the boundary;
5. what is left is the boundary; each geometry's sub-edges are traced to rings.

Where the boundary does not close (edges that meet at angles too small for
doubles) the geometry keeps ``needs_overlay``.

Small collections of points and polygons take the same steps within a batch of
rows (:mod:`geospan.functions.union`); only the others are shuffled.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geospan.functions.collections import capsule_ring, circle_ring
from geospan.functions.geometry import seq
from geospan.functions.union import trace_rings, union_plain
from geospan.functions.validity import boxes_meet, dedup_ring, orient, within
from geospan.functions.wkt import GEOM_TYPE, PARTS_DDL, parse_wkt
from geospan.operators.validity import grid_cells
from geospan.session import stored

RINGS_DDL = "array<array<array<array<double>>>>"


def _snapped(ring: Column) -> Column:
    """Buffers of neighbouring segments share arcs, computed from either end: 13 decimals make them equal again."""
    return F.transform(ring, lambda p: F.array(F.round(p[0], 13), F.round(p[1], 13)))


def pieces_of(members: Column) -> Column:
    """Polygons (arrays of rings) of a collection's members, points and each segment of lines buffered."""
    def of_member(m):
        return (F.when(m["gtype"].isin("POINT", "MULTIPOINT"),
                       F.transform(m["parts"], lambda part: F.array(_snapped(circle_ring(part[0][0][0], part[0][0][1])))))
                .when(m["gtype"].isin("LINESTRING", "MULTILINESTRING"), F.flatten(F.transform(m["parts"], lambda part: F.transform(
                    seq(1, F.size(dedup_ring(part[0])) - 1),
                    lambda i: F.array(_snapped(capsule_ring(dedup_ring(part[0])[i - 1], dedup_ring(part[0])[i])))))))
                .otherwise(m["parts"]))
    return F.flatten(F.transform(members, of_member)).cast(PARTS_DDL)


def _turned_edges(pieces: DataFrame) -> DataFrame:
    """``gid, p`` (piece)``, e`` (edge)`` , x1, y1, x2, y2`` with the interior on the left."""
    rings = (pieces.select("gid", F.posexplode("pieces").alias("p", "rings")).select("gid", "p", F.posexplode("rings").alias("r", "ring"))
             .withColumn("ring", dedup_ring(F.col("ring"))))
    area = F.aggregate(seq(0, F.size("ring") - 2), F.lit(0.0), lambda total, i: total
                       + (F.col("ring")[i][0] - F.col("ring")[0][0]) * (F.col("ring")[i + 1][1] - F.col("ring")[0][1])
                       - (F.col("ring")[i + 1][0] - F.col("ring")[0][0]) * (F.col("ring")[i][1] - F.col("ring")[0][1]))
    rings = rings.withColumn("turn", (area > 0) != (F.col("r") == 0)).withColumn(
        "ring", F.when(F.col("turn"), F.reverse("ring")).otherwise(F.col("ring")))
    ends = F.transform(seq(0, F.size("ring") - 2), lambda i: F.struct(
        F.col("ring")[i][0].alias("x1"), F.col("ring")[i][1].alias("y1"),
        F.col("ring")[i + 1][0].alias("x2"), F.col("ring")[i + 1][1].alias("y2")))
    return rings.select("gid", "p", "r", F.posexplode(ends).alias("i", "s")).select(
        "gid", "p", F.struct("p", "r", "i").alias("e"), "s.*")


def _cuts(edges: DataFrame) -> DataFrame:
    """``gid, e, x, y``: where edges of different pieces meet, the same point for both."""
    cells = grid_cells(edges, ["gid", "p", "e", "x1", "y1", "x2", "y2"])
    a, b = (cells.select("gid", "cell_id", F.col("p").alias(f"p{s}"), F.struct("e", "x1", "y1", "x2", "y2").alias(s)) for s in "ab")
    a_, b_ = F.col("a"), F.col("b")
    met = a.join(b, ["gid", "cell_id"]).filter((F.col("pa") < F.col("pb")) & boxes_meet(a_, b_)).select("gid", "a", "b").distinct()

    def side(s, t, end):
        return orient(t["x1"], t["y1"], t["x2"], t["y2"], s[f"x{end}"], s[f"y{end}"])
    d1, d2, d3, d4 = side(a_, b_, 1), side(a_, b_, 2), side(b_, a_, 1), side(b_, a_, 2)
    share = d1 / (d1 - d2)
    cross = F.struct((a_["x1"] + share * (a_["x2"] - a_["x1"])).alias("x"), (a_["y1"] + share * (a_["y2"] - a_["y1"])).alias("y"))

    def touch(flat, s, t, end):  # an end of s on t
        return F.when((flat == 0) & within(t, s[f"x{end}"], s[f"y{end}"]), F.struct(s[f"x{end}"].alias("x"), s[f"y{end}"].alias("y")))
    points = F.array(F.when((d1 * d2 < 0) & (d3 * d4 < 0), cross), touch(d1, a_, b_, 1), touch(d2, a_, b_, 2),
                     touch(d3, b_, a_, 1), touch(d4, b_, a_, 2))
    found = met.select("gid", "a", "b", F.explode(F.array_compact(points)).alias("at"))
    return found.select("gid", F.explode(F.array("a.e", "b.e")).alias("e"), "at.*")


def _split(edges: DataFrame, cuts: DataFrame) -> DataFrame:
    """Sub-edges, one for each place: ``gid, x1, y1, x2, y2, owners``; those with the interior on both sides left out."""
    at = cuts.groupBy("gid", "e").agg(F.collect_set(F.struct("x", "y")).alias("at"))
    along = lambda c: (c["x"] - F.col("x1")) * (F.col("x2") - F.col("x1")) + (c["y"] - F.col("y1")) * (F.col("y2") - F.col("y1"))
    stops = F.array_distinct(F.concat(
        F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))),
        F.transform(F.array_sort(F.transform(F.coalesce("at", F.array().cast("array<struct<x:double,y:double>>")),
                                             lambda c: F.struct(along(c).alias("t"), c.alias("c")))), lambda s: s["c"]),
        F.array(F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))))
    cut = edges.join(at, ["gid", "e"], "left").withColumn("stops", stops)
    subs = cut.select("gid", "p", F.explode(F.transform(seq(0, F.size("stops") - 2), lambda i: F.struct(
        F.col("stops")[i].alias("a"), F.col("stops")[i + 1].alias("b")))).alias("s"))
    ahead = F.col("s.a") < F.col("s.b")
    places = subs.groupBy("gid", F.least("s.a", "s.b").alias("lo"), F.greatest("s.a", "s.b").alias("hi")).agg(
        F.max(ahead).alias("ahead"), F.max(~ahead).alias("back"), F.collect_set("p").alias("owners"))
    a, b = (F.when(F.col("ahead"), F.col(x)).otherwise(F.col(y)) for x, y in (("lo", "hi"), ("hi", "lo")))
    return places.filter("ahead <> back").select("gid", a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"),
                                                 b["y"].alias("y2"), "owners")


def _boundary(subs: DataFrame, edges: DataFrame) -> DataFrame:
    """Sub-edges whose middle lies inside no other piece."""
    stats = edges.groupBy("gid").agg(F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("y1", "y2")).alias("top"),
                                     F.sum(F.abs(F.col("y2") - F.col("y1"))).alias("travel"), F.count(F.lit(1)).alias("n"))
    height = F.col("top") - F.col("y0")
    bands = F.greatest(F.lit(1.0), F.ceil(F.col("n") * height / F.col("travel")))
    stats = stats.select("gid", "y0", F.when((height > 0) & (F.col("travel") > 0), height / bands).otherwise(1.0).alias("h"))
    band = lambda y: F.floor((y - F.col("y0")) / F.col("h")).cast("long")
    lines = edges.join(stats, "gid").select("gid", "p", *(F.col(c).alias(f"l{c}") for c in ("x1", "y1", "x2", "y2")), F.explode(
        F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))).alias("band"))
    probes = subs.join(stats, "gid").withColumn("mx", (F.col("x1") + F.col("x2")) / 2).withColumn(
        "my", (F.col("y1") + F.col("y2")) / 2).withColumn("band", band(F.col("my")))
    spans = (F.col("ly1") > F.col("my")) != (F.col("ly2") > F.col("my"))
    right = F.col("mx") < (F.col("lx2") - F.col("lx1")) * (F.col("my") - F.col("ly1")) / (F.col("ly2") - F.col("ly1")) + F.col("lx1")
    place = ["gid", "x1", "y1", "x2", "y2"]
    inside = (probes.join(lines, ["gid", "band"]).filter(spans & ~F.array_contains("owners", F.col("p"))).filter(right)
              .groupBy(*place, "p").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").select(*place).distinct())
    return subs.join(inside, place, "left_anti").select(*place)


def dissolve(pieces: DataFrame) -> DataFrame:
    """``gid, parts`` of the union of each row's ``pieces`` (``gid, pieces``); parts are null where it does not close."""
    edges = _turned_edges(pieces).checkpoint()
    rest = _boundary(_split(edges, _cuts(edges)), edges)
    kind = pieces.schema["gid"].dataType.simpleString()

    def trace(table: pa.Table) -> pa.Table:
        parts = trace_rings(list(zip(*(table[c].to_pylist() for c in ("x1", "y1", "x2", "y2")))))
        deep = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))
        return pa.table({"gid": table["gid"][:1], "parts": pa.array([parts], deep)})
    return rest.groupBy("gid").applyInArrow(trace, f"gid {kind}, parts {RINGS_DDL}")


def dissolve_mixed(df: DataFrame, wkt_col: str, gid: str) -> DataFrame:
    """Rows that :func:`with_geometry` left as ``needs_overlay``, with their ``geometry`` where the union closes.

    ``df`` holds the unique key ``gid``, ``wkt_col``, ``geometry`` and
    ``reject_reason``, and is read twice: store it or cut it with a checkpoint.
    Other rows come through as they are. Rows that the batch decides are
    shuffled nowhere; only those left are dissolved by the joins.
    """
    open_ = F.coalesce(F.col("reject_reason") == "needs_overlay", F.lit(False))
    tried = stored(df.filter(open_).withColumn("_parts", union_plain(F.col(f"`{wkt_col}`"))).withColumn("_left", F.col("_parts").isNull()))
    # Kept apart: a filter that Spark derives from the explode of the pieces would parse the text of every row.
    left = stored(tried.filter("_left").drop("_parts", "_left"))
    pieces = left.select(F.col(gid).alias("gid"), parse_wkt(F.col(wkt_col)).alias("w")).select("gid", pieces_of(F.col("w.members")).alias("pieces"))
    done = dissolve(pieces).filter("parts is not null").select(F.col("gid").alias(gid), F.col("parts").cast(PARTS_DDL).alias("_parts"))
    both = tried.filter("not _left").drop("_left").unionByName(left.join(done, gid, "left"))
    made = F.struct(F.lit("MULTIPOLYGON").alias("gtype"), F.lit(4326).alias("srid"), F.col("_parts").alias("parts")).cast(GEOM_TYPE)
    others = [F.col(f"`{c}`") for c in df.columns if c not in ("geometry", "reject_reason")]
    closed = both.select(*others, F.when(F.col("_parts").isNotNull(), made).otherwise(F.col("geometry")).alias("geometry"),
                         F.when(F.col("_parts").isNull(), F.col("reject_reason")).alias("reject_reason"))
    return df.filter(~open_).select(*others, "geometry", "reject_reason").unionByName(closed)
