"""Geometry text by the batch: the same answers as the column expressions."""

import random

from pyspark.sql import functions as F

from frames import rows_of
from geospan.functions.collections import normalize
from geospan.functions.plain import LONGEST, plain_geometry
from geospan.functions.validity import interior_cut
from geospan.functions.wkt import parse_wkt
from geospan.operators.layer import decode_geometry, with_geometry
from geospan.operators.union import to_table


def _ring(rng, x=0, y=0, size=6):
    points = [(x + rng.randint(0, size), y + rng.randint(0, size)) for _ in range(rng.randint(3, 5))]
    if rng.random() < 0.4:
        a, b = rng.randint(1, 4), rng.randint(1, 4)
        points = [(x, y), (x + a, y), (x + a, y + b), (x, y + b)]
    return "(" + ", ".join(f"{p} {q}" for p, q in [*points, points[0] if rng.random() < 0.95 else (9, 9)]) + ")"


def _polygon(rng, x=0, y=0):
    return "(" + ", ".join(_ring(rng, x, y) if k else f"({x} {y}, {x + 6} {y}, {x + 6} {y + 6}, {x} {y + 6}, {x} {y})"
                           for k in range(rng.randint(1, 3))) + ")"


def _texts():
    rng = random.Random(3)
    out = [f"POLYGON ({_ring(rng)})" for _ in range(150)] + ["POLYGON " + _polygon(rng) for _ in range(250)]
    out += ["MULTIPOLYGON (" + ", ".join(_polygon(rng, rng.randint(0, 9), rng.randint(0, 9)) for _ in range(2)) + ")" for _ in range(80)]
    out += [f"GEOMETRYCOLLECTION (POINT ({rng.randint(-3, 9)} 2), POLYGON {_polygon(rng)})" for _ in range(40)]
    # Holes that touch the shell and each other, with and without a cut of the interior.
    square, left = "(0 0, 12 0, 12 12, 0 12, 0 0)", "(0 4, 4 2, 6 4, 4 6, 0 4)"
    out += [f"POLYGON ({square}, (0 4, 6 2, 12 4, 6 6, 0 4))", f"POLYGON ({square}, {left}, (6 4, 8 2, 12 4, 8 6, 6 4))",
            f"POLYGON ({square}, {left}, (6 4, 8 2, 10 4, 8 6, 6 4))"]
    out += ["point z ( +1.5 2. -7e0 )", "MULTIPOINT (1 2, (3 4), 5 6)", "MULTIPOINT ((1 2),(3 4))", "LineString(0 0, 2e1 0)", "LINESTRING (1 1, 1 1)",
            "LINESTRING (1 1)", "MultiLineString((0 0, 2 0), (0 4, .6 4))", "POINT (1 2) or so", "POINT (1 2", "POINT (1 2, 3 4)", "POINT (-0 1)",
            "POINT (1e400 2)", "POINT (1 2 3 4)", "POINT M (1 2 3)", "POINT EMPTY", "POINTZ (1 2 3)", "point\t(1\n2)", "  ", None, "nothing", "((",
            "GEOMETRYCOLLECTION (POINT (1 2))", "GEOMETRYCOLLECTION (POINT (1 2), POINT (3 4))", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (5 5, 6 6))",
            "GEOMETRYCOLLECTION (MULTIPOINT (1 2, 3 4), MULTIPOINT ((5 6)))", "GEOMETRYCOLLECTION (LINESTRING (1 2, 3 4), LINESTRING (5 6, 7 8, 9 9))",
            "GEOMETRYCOLLECTION (POLYGON ((0 0, 1 0, 1 1, 0 0)), MULTIPOLYGON (((5 5, 6 5, 6 6, 5 5)), ((8 8, 9 8, 9 9, 8 8))))",
            "POLYGON ((0 0, 0 0, 1 0, 1 1, 0 0))", "POLYGON ((0 0, 1 0, 0 0, 0 0))", "POLYGON ((0 0, 1 0, 0 0))", "0POINT (1 2)", "MULTIPOINT (1 2, 3)"]
    return out + ["POINT (1" + " " * LONGEST + "2)"]


def test_batches_decide_as_the_expressions_do(spark):
    texts = _texts()
    df = rows_of(spark, texts).coalesce(2)
    slow = df.select("wkt", decode_geometry(F.col("wkt")).alias("d"))
    cut = F.col("d.reason").isNull() & F.coalesce(interior_cut(F.col("d.geometry")), F.lit(False))
    want = slow.select("wkt", F.when(~cut, F.col("d.geometry.gtype")).alias("t"), F.when(~cut, F.col("d.geometry.parts")).alias("p"),
                       F.when(cut, "invalid").otherwise(F.col("d.reason")).alias("r")).collect()
    got = with_geometry(df, "wkt", drop_wkt=False).select("wkt", "geometry.gtype", "geometry.parts", "reject_reason").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))
    reasons = [r["r"] for r in want]
    assert min(reasons.count(r) for r in (None, "invalid", "needs_overlay", "unparsable")) > 5


def test_most_texts_are_decided_by_the_batch(spark):
    """Before, every row went through the expressions, at some hundred microseconds each."""
    df = rows_of(spark, _texts()).coalesce(1)
    assert df.filter(plain_geometry(F.col("wkt")).isNull()).count() <= 15
    long = rows_of(spark, ["POINT (1" + " " * LONGEST + "2)"])
    assert long.filter(plain_geometry(F.col("wkt")).isNull()).count() == 1


def test_edges_and_rules_left_to_the_join(spark):
    df = rows_of(spark, ["POLYGON ((0 0, 1 1, 1 0, 0 1, 0 0))", "POLYGON ((0 0, 1 0, 0 0, 0 0))"])
    got = with_geometry(df, "wkt", topology=False).select("reject_reason").collect()
    assert [r[0] for r in got] == [None, "invalid"]


def test_batches_without_rules_read_what_the_expressions_read(spark):
    """The table export keeps geometries that are not valid; before, all of its rows went through the expressions."""
    texts = _texts() + ["GEOMETRYCOLLECTION (LINESTRING (1 1, 1 1))", "GEOMETRYCOLLECTION (LINESTRING (1 1, 1 1), LINESTRING (1 1, 2 2))",
                        "MULTILINESTRING ((1 1, 1 1), (2 2, 3 3))"]
    df = rows_of(spark, texts).coalesce(2)
    want = df.select("wkt", normalize(parse_wkt(F.col("wkt"))).alias("n")).select("wkt", F.when(F.col("n.reason").isNull(), F.col("n.gtype")).alias("t"), F.when(
        F.col("n.reason").isNull(), F.col("n.parts")).alias("p"), "n.reason").collect()
    known = {r.wkt: r for r in want}
    plain = df.select("wkt", plain_geometry(F.col("wkt"), rules=False).alias("g")).filter("g is not null").select("wkt", "g.*").collect()
    assert len(plain) >= len(texts) - 25
    assert sorted(map(repr, map(tuple, plain))) == sorted(repr(tuple(known[r.wkt])) for r in plain)
    table = to_table([rows_of(spark, [t for t in texts if t and "((" in t]).select("wkt", F.lit(4326).alias("srid"), F.col("wkt").alias("key"))])
    got = {r.key: (r.geometry_issue, r.footprintWKT) for r in table.collect()}
    assert {k for k, v in got.items() if v[1] is None} == {k for k in got if known[k].reason is not None or known[k].p is None}
    assert got["POLYGON ((0 0, 1 0, 0 0, 0 0))"] == (None, "POLYGON ((0 0, 1 0, 0 0, 0 0))")
