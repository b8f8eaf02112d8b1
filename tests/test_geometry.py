"""Geometry column functions (mirrors the reference's helper tests)."""

import math

import pytest
from pyspark.sql import functions as F

from frames import rows_of
from geospan.functions import crs as C
from geospan.functions import geometry as G
from geospan.functions.wkt import to_wkt
from geospan.operators.layer import decode_geometry, with_geometry


def decode(spark, wkts):
    df = rows_of(spark, wkts).select("wkt", decode_geometry(F.col("wkt")).alias("d"))
    return df.select("wkt", F.col("d.geometry").alias("g"), F.col("d.reason").alias("reason"))


def test_parse_point_invalid_and_empty(spark):
    got = {r.wkt: r for r in decode(spark, ["POINT(10 20)", "INVALID WKT STRING", ""]).collect()}
    p = got["POINT(10 20)"].g
    assert p.gtype == "POINT" and p.parts == [[[[10.0, 20.0]]]]
    assert got["INVALID WKT STRING"].g is None and got["INVALID WKT STRING"].reason == "unparsable"
    assert got[""].g is None and got[""].reason == "blank_wkt"


def test_null_and_empty_and_nonfinite(spark):
    got = {r.wkt: r.reason for r in decode(spark, [None, "POINT EMPTY", "POINT (1e400 2)", "POINT ZM (1 2 3 4)"]).collect()}
    assert got == {None: "null_wkt", "POINT EMPTY": "empty", "POINT (1e400 2)": "non_finite",
                   "POINT ZM (1 2 3 4)": "unsupported_dimension"}


def test_wkt_numbers_and_z(spark):
    cases = {
        "POINT (.5 60.)": [[[[0.5, 60.0]]]],
        "POINT (+25 -.5e1)": [[[[25.0, -5.0]]]],
        "POINT Z (1 2 3)": [[[[1.0, 2.0]]]],
        "point (1 2 3)": [[[[1.0, 2.0]]]],
        "LINESTRING Z (1 2 3, 4 5 6)": [[[[1.0, 2.0], [4.0, 5.0]]]],
        "MULTIPOINT ((1 2), (3 4))": [[[[1.0, 2.0]]], [[[3.0, 4.0]]]],
        "MULTIPOINT (1 2, 3 4)": [[[[1.0, 2.0]]], [[[3.0, 4.0]]]],
        "MULTILINESTRING ((1 2, 3 4), (5 6, 7 8))": [[[[1.0, 2.0], [3.0, 4.0]]], [[[5.0, 6.0], [7.0, 8.0]]]],
        "GEOMETRYCOLLECTION Z (POINT Z (1 2 3))": [[[[1.0, 2.0]]]],
    }
    got = {r.wkt: r.g and r.g.parts for r in decode(spark, list(cases)).collect()}
    assert got == cases


def test_wkt_with_leftovers_is_rejected(spark):
    bad = ["LINESTRING (1 2, 3 4), (5 6, 7 8)", "POLYGON ((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5))",
           "LINESTRING (1 2, 3 4))", "LINESTRING ((1,2),(3,4))", "LINESTRING ([1,2],[3,4])", "POINT ((25 60))",
           "POINT (25, 60)", "POINT ()", "POINT (1)", "POINT (1 2, 3 4)", "POINT (. 2)", "POINT (1 2) x",
           "LINESTRING (1 2 3 4)", "LINESTRING ((1 2, 3 4))", "POLYGON (0 0, 1 0, 1 1, 0 0)",
           "MULTIPOINT (((1 2)))", "POLYGON ((0 0, 1 0, 1 1))", "POLYGON ((0 0, 1 0, 1 1, 0 1))",
           'LINESTRING (1 2, 3 4),"e":1,"x":(1)']
    got = {r.wkt: (r.g, r.reason) for r in decode(spark, bad).collect()}
    expected = {w: (None, "unparsable") for w in bad} | {"LINESTRING (1 2 3 4)": (None, "unsupported_dimension")}
    assert got == expected


def test_normalize_collections(spark):
    cases = {
        "GEOMETRYCOLLECTION (POINT (10 20))": ("POINT", 1),
        "GEOMETRYCOLLECTION (POINT (0 0), POINT (1 1), POINT (2 2))": ("MULTIPOINT", 3),
        "GEOMETRYCOLLECTION (POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0)), POLYGON ((2 2, 3 2, 3 3, 2 3, 2 2)))":
            ("MULTIPOLYGON", 2),
        "GEOMETRYCOLLECTION (MULTILINESTRING ((0 0, 1 1)), MULTILINESTRING ((2 2, 3 3), (4 4, 5 5)))":
            ("MULTILINESTRING", 3),
        "POINT (10 20)": ("POINT", 1),
    }
    got = {r.wkt: (r.g.gtype, len(r.g.parts)) for r in decode(spark, list(cases)).collect()}
    assert got == cases


def test_buffer_and_dissolve_mixed(spark):
    wkt = "GEOMETRYCOLLECTION (POINT (0 0), LINESTRING (1 1, 2 2), POLYGON ((3 3, 4 3, 4 4, 3 4, 3 3)))"
    r = decode(spark, [wkt]).select("g", G.area(F.col("g")).alias("a")).first()
    assert r.g.gtype == "MULTIPOLYGON" and len(r.g.parts) == 3
    assert r.a > 1
    # point buffer: 64-gon of radius 1e-5
    circle = r.g.parts[0][0]
    assert len(circle) == 65 and circle[0] == circle[-1]


def test_overlapping_mixed_needs_overlay(spark):
    r = decode(spark, ["GEOMETRYCOLLECTION (POINT (0.5 0.5), POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0)))"]).first()
    assert r.g is None and r.reason == "needs_overlay"


def test_centroid_bbox_footprint(spark):
    df = decode(spark, ["POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))", "POLYGON ((0 0, 2 1, 1 2, 0 1, 0 0))"])
    out = {r.wkt: r for r in df.select("wkt", to_wkt(G.centroid(F.col("g"))).alias("c"),
                                        G.bounds(G.envelope(F.col("g"))).alias("b"),
                                        G.envelope(F.col("g"))["gtype"].alias("t"),
                                        to_wkt(F.col("g")).alias("fp")).collect()}
    assert out["POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"].c == "POINT (1 1)"
    quad = out["POLYGON ((0 0, 2 1, 1 2, 0 1, 0 0))"]
    assert tuple(quad.b) == (0.0, 0.0, 2.0, 2.0) and quad.t == "POLYGON"
    assert quad.fp == "POLYGON ((0 0, 2 1, 1 2, 0 1, 0 0))"


def test_validity(spark):
    cases = {
        "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))": None,
        "POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))": "invalid",                      # bow-tie
        "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 3 2, 3 3, 2 3, 2 2))": None,
        "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (12 2, 13 2, 13 3, 12 3, 12 2))": "invalid",  # hole outside
        "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((1 1, 3 1, 3 3, 1 3, 1 1)))": "invalid",  # overlap
        "MULTIPOLYGON (((0 0, 10 0, 10 10, 0 10, 0 0)), ((5 5, 6 5, 6 6, 5 5)))": "invalid",   # nested
        "POLYGON ((0 0, 4 0, 4 4, 2 0, 0 4, 0 0))": "invalid",                 # self-touch
        "LINESTRING (1 1, 1 1)": "invalid",
        "POLYGON ((0 0, 1 0, 1 1))": "unparsable",                             # ring not closed
    }
    got = {r.wkt: r.reason for r in decode(spark, list(cases)).collect()}
    assert got == cases


def test_tm35fin_known_point_and_roundtrip(spark):
    e, n = C.tm35fin_forward(F.lit(27.0), F.lit(60.0))
    lon, lat = C.tm35fin_inverse(e, n)
    r = spark.range(1).select(e.alias("e"), n.alias("n"), lon.alias("lon"), lat.alias("lat")).first()
    assert r.e == pytest.approx(500000.0, abs=1e-6)
    assert r.n == pytest.approx(6651411.1902, abs=1e-3)
    assert r.lon == pytest.approx(27.0, abs=1e-9) and r.lat == pytest.approx(60.0, abs=1e-9)


def test_reproject_geometry_roundtrip(spark):
    df = decode(spark, ["POLYGON ((21 60, 22 60, 22 61, 21 61, 21 60))"])
    back = df.select(C.to_srid(C.to_srid(F.col("g"), C.TM35FIN), C.WGS84).alias("b")).first().b
    for p, q in zip(back.parts[0][0], [[21, 60], [22, 60], [22, 61], [21, 61], [21, 60]]):
        assert math.isclose(p[0], q[0], abs_tol=1e-9) and math.isclose(p[1], q[1], abs_tol=1e-9)
    assert back.srid == 4326


def test_with_geometry_drops_wkt(spark):
    df = spark.createDataFrame([(1, "POINT (1 2)")], "id long, wkt string")
    out = with_geometry(df, "wkt")
    assert "wkt" not in out.columns and {"geometry", "reject_reason"} <= set(out.columns)


def test_reprojection_rejects_what_is_outside_the_crs(spark):
    from geospan.operators.layer import to_layer
    texts = ["POINT (25 60)", "POINT (117 0)", "POINT (25 95)", "POINT (500000 6651411)", "POINT (25 -90.5)"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, wkt string")
    got = {r.i: r.reject_reason for r in to_layer(df, "wkt", "point", "euref").collect()}
    assert got == {0: None, 1: "outside_crs", 2: "outside_crs", 3: "outside_crs", 4: "outside_crs"}
    kept = {r.i: r.reject_reason for r in to_layer(df, "wkt", "point", "wgs84").collect()}
    assert set(kept.values()) == {None}  # nothing is moved


def test_building_a_layer_starts_no_job(spark):
    from geospan.operators.layer import to_layer
    jobs = spark.sparkContext.statusTracker()
    df = spark.range(10).selectExpr("concat('POINT (25 ', id, ')') as wkt").groupBy("wkt").count()
    spark.sparkContext.setJobGroup("layer-build", "building only")
    to_layer(df, "wkt", "point", "euref")
    spark.sparkContext.setJobGroup("other", "")
    assert list(jobs.getJobIdsForGroup("layer-build")) == []
