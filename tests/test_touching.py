"""Touching rings: each row checked once, texts counted before the join, cycles of touches by the batch."""

import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from frames import rows_of
from geospan.functions import plain
from geospan.functions.plain import cyclic_touches
from geospan.operators.layer import with_geometry
from geospan.operators.validity import edges_of, invalid_geometries, invalid_interior
from geospan.plans import catalog
from geospan.session import stored

SF = "/root/testdata/sf0.001"


def _diamond(x, y):
    return f"({x + 1} {y}, {x} {y + 1}, {x - 1} {y}, {x} {y - 1}, {x + 1} {y})"


def _holes(cells):
    """A square with diamonds that touch their neighbours on the grid."""
    return "POLYGON ((-9 -9, 19 -9, 19 19, -9 19, -9 -9), " + ", ".join(_diamond(2 * x, 2 * y) for x, y in cells) + ")"


def _lattices():
    rng = random.Random(7)
    grid = [(x, y) for x in range(4) for y in range(4)]
    return sorted({_holes(sorted(rng.sample(grid, rng.randint(1, 9)))) for _ in range(120)})


def _has_cycle(ties):
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v
    cyclic = False
    for r, x, y in set(ties):
        a, b = find(r), find((x, y))
        cyclic |= a == b
        root[a] = b
    return cyclic


def test_rows_are_counted_before_the_join(spark, monkeypatch):
    """Before, the view was made twice and every row was shuffled with its text; edges carried the text of their polygon."""
    seen, asked, view = [], [], catalog.view
    monkeypatch.setattr(catalog, "stored", lambda df: seen.append(stored(df)) or seen[-1])
    monkeypatch.setattr(catalog, "view", lambda *a, **k: asked.append(a) or view(*a, **k))
    out = catalog.touching_rings(spark, SF)
    assert len(asked) == 1 and [df.columns for df in seen] == [["kind", "wkt", "by_row", "n"], ["wkt", "geometry", "_gid"]]
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{SF}/lineitem.parquet')")
    want = con.execute(catalog.TOUCHING_RINGS).fetchall()
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert seen[0].agg(F.sum("n")).first()[0] == con.execute("select count(*) from lineitem").fetchone()[0]


def test_reason_without_geometry_is_the_same_reason(spark):
    texts = _lattices() + ["POLYGON ((0 0, 1 1, 1 0, 0 1, 0 0))", "POINT (1 2) or so", "POINT (-0 1)", "  ", None, "POINT EMPTY",
                           "POLYGON ((-0 0, 12 0, 12 12, 0 12, -0 0), (-0 4, 6 2, 12 4, 6 6, -0 4))", "POINT (1" + " " * plain.LONGEST + "2)"]
    df = rows_of(spark, texts).coalesce(1)
    both = [sorted(map(repr, map(tuple, with_geometry(df, "wkt", drop_wkt=False, geometry=g).select("wkt", "reject_reason").collect())))
            for g in (True, False)]
    assert both[0] == both[1]
    assert with_geometry(df, "wkt", geometry=False).columns == ["reject_reason"]
    assert df.select(plain.plain_geometry(F.col("wkt"), geometry=False).alias("p")).schema.simpleString() == "struct<p:struct<reason:string>>"


def test_cycles_of_touches_by_the_batch(spark):
    """Before, each polygon was a call of a Python function of its own, which workers without the package could not load."""
    rng = random.Random(5)
    held = [[(rng.randint(0, 3), float(rng.randint(0, 1)), float(rng.randint(0, 1))) for _ in range(rng.randint(0, 8))] for _ in range(400)]
    df = spark.createDataFrame([(k, ties) for k, ties in enumerate(held)], "k int, t array<struct<r:int,x:double,y:double>>").coalesce(2)
    got = {r.k for r in df.filter(cyclic_touches(F.col("t"))).select("k").collect()}
    assert got == {k for k, ties in enumerate(held) if _has_cycle(ties)} and 20 < len(got) < 380
    shapes = with_geometry(rows_of(spark, _lattices()), "wkt", drop_wkt=False, topology=False)
    interior = invalid_interior(edges_of(shapes, "wkt"))
    assert "FlatMapGroupsInArrow" not in interior._jdf.queryExecution().executedPlan().toString()
    by_row = {r.wkt for r in with_geometry(rows_of(spark, _lattices()), "wkt", drop_wkt=False).filter("reject_reason = 'invalid'").collect()}
    assert {r.gid for r in interior.collect()} <= {r.gid for r in invalid_geometries(shapes, "wkt").collect()} == by_row
    assert 5 < len(by_row) < len(_lattices()) - 5


def test_long_chains_of_rings_have_no_cycle_until_closed():
    """Ends taken off one at a time would take as many rounds as the chain is long."""
    k = 200_000
    order = np.random.default_rng(1).permutation(k + 1)
    ring, point = np.concatenate((order[:-1], order[1:])), np.tile(np.arange(k), 2)
    assert len(plain._in_cycles(ring, point)) == 0
    assert len(plain._in_cycles(np.append(ring, order[[0, -1]]), np.append(point, [k, k]))) == 2 * k + 2


def test_blocks_of_rows_do_not_change_the_answer(monkeypatch):
    text = pa.array(_lattices() + ["MULTIPOLYGON (((0 0, 6 0, 6 6, 0 6, 0 0), (1 1, 5 1, 5 5, 1 5, 1 1)), ((2 2, 4 2, 4 4, 2 4, 2 2)))",
                                   "MULTIPOLYGON (((0 0, 6 0, 6 6, 0 6, 0 0)), ((2 2, 4 2, 4 4, 2 4, 2 2)))"] * 3)
    whole = plain._result(text, True, True)
    monkeypatch.setattr(plain, "PAIRS", 1000)
    assert plain._result(text, True, True).equals(whole) and whole.field("reason").null_count > 10
    assert plain._result(text, True, True, False).field("reason").equals(whole.field("reason"))
