"""The grid join of small geometries in their batch, against the check by row and the shuffled joins."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from frames import rows_of
from geospan.functions import grid, plain
from geospan.operators import validity as V
from geospan.operators.layer import with_geometry


def _rings(rng):
    n = rng.choice([3, 5, 8, 30, 60, 120])
    turns = sorted(rng.random() * 2 * math.pi for _ in range(n))
    ring = [(50 + rng.uniform(5, 40) * math.cos(a), 50 + rng.uniform(5, 40) * math.sin(a)) for a in turns]
    if rng.random() < 0.4:
        i, k = rng.randrange(n), rng.randrange(n)
        ring[i], ring[k] = ring[k], ring[i]
    if rng.random() < 0.3:
        ring = [(round(x / 4), round(y / 4)) for x, y in ring]
    holes = []
    for _ in range(rng.choice([0, 0, 1, 3])):
        x, y, w = rng.uniform(30, 60), rng.uniform(30, 60), rng.uniform(1, 4)
        holes.append([(x, y), (x + w, y), (x + w, y + w), (x, y + w)])
    return "(" + ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in [*r, r[0]]) + ")" for r in (ring, *holes)) + ")"


def _texts(n):
    rng = random.Random(3)
    return [f"POLYGON {_rings(rng)}" if rng.random() < 0.8 else f"MULTIPOLYGON ({_rings(rng)}, {_rings(rng)})" for _ in range(n)]


def test_edges_that_share_a_cell_break_the_rules_that_all_pairs_break():
    text = pa.array(_texts(400))
    shaped = plain._result(text, False, True)
    whole = plain._result(text, True, True).field("reason").to_pylist()
    got = grid._invalid(shaped.field("parts")).to_pylist()
    fine = [k for k, reason in enumerate(shaped.field("reason").to_pylist()) if reason is None]
    assert [got[k] for k in fine] == [whole[k] == "invalid" for k in fine] and {got[k] for k in fine} == {True, False}
    s, _ = grid._nested(shaped.field("parts"))
    ring, _, _, *ends = plain._edges(s)
    mine, n = s.row_of_ring()[ring], len(s.parts)
    assert 4 * len(grid.cell_pairs(mine, n, *ends)[0]) < len(plain._row_pairs(mine, n)[0])


def test_odd_shapes_are_left_to_the_joins():
    square = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
    odd = [[[square[:-1]]], [[square, []]], [[]], [], None, [[[[0.0, 0.0], [4.0, 0.0], [4.0, 0.0], [0.0, 0.0]]]],
           [[[[0.0, 0.0], [4.0, math.nan], [4.0, 4.0], [0.0, 0.0]]]], [[[[1e80 * x, y] for x, y in square]]]]
    deep = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))
    bow = [square[0], square[2], square[1], square[3], square[0]]
    assert grid._invalid(pa.array([[[square]], *odd, [[bow]]], deep)).to_pylist() == [False, *[None] * len(odd), True]
    for lost in ([[[None, *square]]], [[[[0.0], *square]]]):
        assert grid._invalid(pa.array([lost, [[bow]]], deep)).to_pylist() == [None, None]


def test_only_large_geometries_are_exploded(spark, monkeypatch):
    """Before, every edge of every geometry was a row of the shuffled joins, copied to both sides of each."""
    wheel = [(round(math.cos(k * math.pi / 200), 9), round(math.sin(k * math.pi / 200), 9)) for k in range(400)]
    swapped = [*wheel[:20], wheel[21], wheel[20], *wheel[22:]]
    large = [f"POLYGON (({', '.join(f'{x} {y}' for x, y in [*w, w[0]])}))" for w in (wheel, swapped)]
    texts = [*_texts(60), *large]
    rows = with_geometry(rows_of(spark, texts).coalesce(1).withColumn("id", F.monotonically_increasing_id()), "wkt", topology=False).checkpoint()
    edges = V.edges_of(rows, "id").checkpoint()
    want = {r.gid for r in V.invalid_by_edges(edges).union(V.invalid_nesting(edges)).union(V.invalid_interior(edges)).collect()}
    seen, edges_of = [], V.edges_of
    monkeypatch.setattr(V, "edges_of", lambda df, *a: seen.append(df) or edges_of(df, *a))
    assert {r.gid for r in V.invalid_geometries(rows, "id").collect()} == want
    assert {r.gid for r in seen[0].select("gid").collect()} == {60, 61} and 61 in want and 60 not in want
    assert 10 < len(want) < 55 and np.array([len(t) for t in texts]).max() > plain.LONGEST
