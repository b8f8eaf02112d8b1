"""The grid of edges: cells along an edge, dense cells, very large rings."""

import math
import random

from pyspark.sql import functions as F

from geospan.functions.validity import boxes_meet, edge_conflict
from geospan.operators.validity import COPIES, edges_of, grid_cells, invalid_by_edges, invalid_geometries, spread_cells

GEOMETRY = "gid long, geometry struct<gtype:string,srid:int,parts:array<array<array<array<double>>>>>"


def polygons(spark, rings):
    return spark.createDataFrame([(n, ("POLYGON", 4326, [[[list(map(float, p)) for p in ring]]])) for n, ring in enumerate(rings)], GEOMETRY)


def test_edges_that_meet_share_a_cell(spark):
    rng = random.Random(11)
    rings = []
    for n in range(60):
        scale, far = rng.choice([1, 9, 1000]), rng.choice([0, 0.1, 6.7e6])
        ring = [(far + rng.randint(0, scale) / rng.choice([1, 3]), far + rng.randint(0, scale)) for _ in range(rng.choice([3, 8, 25]))]
        rings.append(ring + ring[:1])
    edges = edges_of(polygons(spark, rings), "gid").cache()
    names = ["j", "r", "i", "m", "x1", "y1", "x2", "y2"]
    a, b = (F.struct(*[F.col(f"{s}.{c}").alias(c) for c in names]) for s in "ab")
    every = edges.alias("a").join(edges.alias("b"), (F.col("a.gid") == F.col("b.gid")) & (F.col("a.i") < F.col("b.i")))
    bad = {r.gid for r in every.filter(boxes_meet(a, b) & edge_conflict(a, b)).select("a.gid").distinct().collect()}
    assert {r.gid for r in invalid_by_edges(edges).collect()} == bad and 10 < len(bad) < 60
    met = {(r.gid, r.i, r.k) for r in every.filter(boxes_meet(a, b) & edge_conflict(a, b)).select(
        "a.gid", "a.i", F.col("b.i").alias("k")).collect()}
    for dense in (1, 4, 512):
        left, right = spread_cells(grid_cells(edges, ["gid", *names]), dense)
        pairs = left.alias("a").join(right.alias("b"), (F.col("a.gid") == F.col("b.gid")) & (F.col("a.cell_id") == F.col("b.cell_id"))
                                     & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.i") < F.col("b.i")))
        assert met <= {(r.gid, r.i, r.k) for r in pairs.select("a.gid", "a.i", F.col("b.i").alias("k")).collect()}


def test_copies_follow_the_edge_not_its_box(spark):
    comb = [(x, y) for k in range(500) for x, y in ((k, k), (k + 900, k + 0.1), (k + 0.5, k + 0.5))]
    edges = edges_of(polygons(spark, [comb + [(0, 900), (0, 0)]]), "gid")
    copies = grid_cells(edges, ["gid", "i"]).groupBy("i").count().agg(F.avg("count").alias("mean")).first().mean
    assert copies <= COPIES + 2


def test_ring_of_200000_vertices_is_spread(spark):
    n = 200_000
    k = F.col("id")
    angle, radius = k * (2 * math.pi / n), 10 + (k % 2) * 1e-3
    ring = spark.range(n).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y")))),
                                          lambda p: F.array(p["x"], p["y"])).alias("ring"))
    closed = F.concat("ring", F.slice("ring", 1, 1))
    # The second one goes back to an earlier vertex's place: it crosses itself once.
    broken = F.concat(F.slice("ring", 1, 1000), F.array(F.element_at("ring", 500)), F.slice("ring", 1001, n), F.slice("ring", 1, 1))
    both = ring.select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("gid"), closed.alias("ring")),
                                         F.struct(F.lit(1).cast("long").alias("gid"), broken.alias("ring")))).alias("x")).select(
        "x.gid", F.struct(F.lit("POLYGON").alias("gtype"), F.lit(4326).alias("srid"), F.array(F.array(F.col("x.ring"))).alias("parts")).alias("geometry"))
    edges = edges_of(both, "gid")
    cells = grid_cells(edges, ["gid", "j", "r", "i"])
    assert cells.count() <= (COPIES + 2) * (2 * n + 1)
    dealt = cells.repartition(8, "gid", "cell_id").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 2 * min(r["count"] for r in dealt)
    assert [r.gid for r in invalid_geometries(both, "gid").collect()] == [1]
