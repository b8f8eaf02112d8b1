"""The union of overlapping pieces against counted cells and sampled points; mixed collections end to end."""

import math
import random

import numpy as np
from frames import rows_of
from pyspark.sql import functions as F

from geospan.functions import geometry as G
from geospan.functions.validity import is_valid
from geospan.operators.layer import with_geometry
from geospan.functions.union import EDGES, union_plain
from geospan.functions.wkt import parse_wkt
from geospan.operators.overlay import dissolve, dissolve_mixed, pieces_of, trace_rings
from geospan.session import stored

PIECES = "gid long, pieces array<array<array<array<double>>>>"


def rectangle(x0, y0, x1, y1):
    return [[[float(x), float(y)] for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]]


def ring_area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def union_area(parts):
    return sum(ring_area(ring) for part in parts for ring in part)


def inside(x, y, ring):
    hit = np.zeros(len(x), bool)
    for a, b in zip(ring, ring[1:]):
        if a[1] != b[1]:
            hit ^= ((a[1] > y) != (b[1] > y)) & (x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0])
    return hit


def test_union_of_rectangles_equals_counted_cells(spark):
    rng = random.Random(4)
    rows = []
    for gid in range(60):
        corners = [(rng.randint(0, 8), rng.randint(0, 8)) for _ in range(rng.randint(1, 7))]
        rows.append((gid, [rectangle(x, y, x + rng.randint(1, 5), y + rng.randint(1, 5)) for x, y in corners]))
    got = {r.gid: r.parts for r in dissolve(spark.createDataFrame(rows, PIECES)).collect()}
    for gid, pieces in rows:
        cells = {(x, y) for piece in pieces for x in range(int(piece[0][0][0]), int(piece[0][2][0]))
                 for y in range(int(piece[0][0][1]), int(piece[0][2][1]))}
        assert union_area(got[gid]) == len(cells)
        assert all(ring_area(part[0]) > 0 and all(ring_area(hole) < 0 for hole in part[1:]) for part in got[gid])


def test_union_of_triangles_covers_the_sampled_points(spark):
    rng = random.Random(6)
    rows = []
    for gid in range(15):
        pieces = []
        for _ in range(4):
            ring = [[rng.random() * 10, rng.random() * 10] for _ in range(3)]
            pieces.append([ring + ring[:1]])
        rows.append((gid, pieces))
    got = {r.gid: r.parts for r in dissolve(spark.createDataFrame(rows, PIECES)).collect()}
    x, y = np.random.default_rng(1).random((2, 3000)) * 10
    for gid, pieces in rows:
        want = np.any([inside(x, y, piece[0]) for piece in pieces], axis=0)
        made = np.any([inside(x, y, part[0]) & ~np.any([inside(x, y, h) for h in part[1:]] or [np.zeros(len(x), bool)], axis=0)
                       for part in got[gid]], axis=0)
        assert (want == made).all()


def test_mixed_collections(spark):
    square = "POLYGON ((3 3, 5 3, 5 5, 3 5, 3 3))"
    texts = [f"GEOMETRYCOLLECTION ({square}, POINT (4 4))", f"GEOMETRYCOLLECTION ({square}, POINT (3 4))",
             f"GEOMETRYCOLLECTION ({square}, LINESTRING (2 2, 4 4, 6 4))", "GEOMETRYCOLLECTION (POINT (9 9), LINESTRING (0 0, 1 0, 1 1))",
             f"GEOMETRYCOLLECTION ({square}, POINT (9 9))", "POINT (1 2)", "junk", None,
             f"GEOMETRYCOLLECTION ({square}, MULTIPOLYGON (((4 4, 6 4, 6 6, 4 6, 4 4)), ((8 8, 9 8, 9 9, 8 8))))"]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, wkt string")
    rows = with_geometry(df, "wkt", drop_wkt=False).checkpoint()
    assert [r.reject_reason for r in rows.orderBy("key").collect()] == ["needs_overlay"] * 4 + [None, None, "unparsable", "null_wkt", "needs_overlay"]
    done = dissolve_mixed(rows, "wkt", "key").select("key", "reject_reason", "geometry.gtype", G.area(F.col("geometry")).alias("area"),
                                                     is_valid(F.col("geometry")).alias("valid"), F.size("geometry.parts").alias("n"))
    got = {r.key: r for r in done.collect()}
    assert [got[i].reject_reason for i in range(9)] == [None] * 6 + ["unparsable", "null_wkt", None]
    r, tube = 1e-5, 2e-5
    half_disc = 64 / 2 * math.sin(2 * math.pi / 64) * r * r / 2
    want = {0: 4, 1: 4 + half_disc, 2: 4 + tube * (math.sqrt(2) + 1), 3: tube * 2 + half_disc * 2, 8: 4 + 4 - 1 + 0.5}
    for key, area in want.items():
        assert abs(got[key].area - area) < (1e-9 if key in (2, 3) else 1e-12) and got[key].gtype == "MULTIPOLYGON" and got[key].valid
    assert [got[i].n for i in (0, 1, 2, 3, 8)] == [1, 1, 1, 2, 2]


def test_boundaries_that_do_not_close_are_named():
    ring = [(0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 0)]
    assert trace_rings(ring) == [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]
    assert trace_rings(ring[:2]) is None and trace_rings([]) is None


def test_no_pieces(spark):
    assert dissolve(spark.createDataFrame([], PIECES)).count() == 0


def _polygon(rng):
    x, y, w, h = rng.randint(0, 8), rng.randint(0, 8), rng.randint(1, 5), rng.randint(1, 5)
    ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)] if rng.random() < 0.6 else [(x, y), (x + w, y + 1), (x + 1, y + h + 1)]
    rings = [ring] + ([[(x + 0.25, y + 0.25), (x + 0.5, y + 0.25), (x + 0.5, y + 0.5)]] if rng.random() < 0.3 and len(ring) == 4 else [])
    turned = [r[::-1] if rng.random() < 0.5 else r for r in rings]
    return "(" + ", ".join("(" + ", ".join(f"{a} {b}" for a, b in [*r, r[0]]) + ")" for r in turned) + ")"


def test_batch_makes_the_union_that_the_joins_make(spark):
    """Before, the edges of every row went through some ten shuffles, small geometries too."""
    rng = random.Random(8)
    texts = []
    for _ in range(120):
        points = [f"POINT ({rng.randint(0, 9)} {rng.randint(0, 9)})" for _ in range(rng.randint(0, 2))]
        texts.append(f"GEOMETRYCOLLECTION ({', '.join([*points, 'POLYGON ' + _polygon(rng)])}, MULTIPOLYGON ("
                     + ", ".join(_polygon(rng) for _ in range(rng.randint(1, 3))) + "))")
    df = rows_of(spark, texts).withColumn("gid", F.monotonically_increasing_id()).checkpoint()
    pieces = df.select("gid", pieces_of(parse_wkt(F.col("wkt"))["members"]).alias("pieces"))
    want = {r.gid: r.parts for r in dissolve(pieces).collect()}
    got = {r.gid: r.parts for r in df.select("gid", union_plain(F.col("wkt")).alias("parts")).collect()}
    assert len(got) == 120 and all(p is not None for p in want.values())

    def rings(parts):  # where rings touch, the joins may begin and link them in another order of edges
        return sorted(round(ring_area(r), 9) for part in parts for r in part), sorted({tuple(p) for part in parts for r in part for p in r})
    assert {g: rings(p) for g, p in got.items()} == {g: rings(p) for g, p in want.items()}
    assert sum(got[g] == want[g] for g in got) > 60


def test_large_and_odd_collections_are_left_to_the_joins(spark):
    square = "POLYGON ((3 3, 5 3, 5 5, 3 5, 3 3))"
    many = ", ".join(f"POINT ({k} 4)" for k in range(EDGES // 64 + 1))
    texts = [f"GEOMETRYCOLLECTION ({square}, {many})", f"GEOMETRYCOLLECTION ({square}, LINESTRING (2 2, 4 4))", None, "junk",
             f"GEOMETRYCOLLECTION ({square}, POINT (4 4))"]
    rows = rows_of(spark, texts).coalesce(1).select("wkt", union_plain(F.col("wkt")).isNull().alias("left")).collect()
    assert [r.left for r in rows] == [True, True, True, True, False]
    decoded = with_geometry(rows_of(spark, texts), "wkt", drop_wkt=False).withColumn("key", F.monotonically_increasing_id())
    done = dissolve_mixed(stored(decoded), "wkt", "key")
    assert {r.wkt: r.reject_reason for r in done.collect()} == dict(zip(texts, [None, None, "null_wkt", "unparsable", None]))
