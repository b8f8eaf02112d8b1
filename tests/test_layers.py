"""Layer job, sinks, vector sources and the table job."""

import json
import os

import pytest
from pyspark.sql import functions as F

from geospan.operators.layer import good_rows, reject_rollup, to_layer
from geospan.operators.union import to_table
from geospan.plans.convert import convert_export
from geospan.sinks.layers import write_layer, write_table_csv
from geospan.sources.vector import read_geojson, read_gml, read_kml


def test_process_partition_point(spark, tmp_path):
    df = spark.createDataFrame([(1, "POINT (10 20)")], "id long, wkt string")
    lay = good_rows(to_layer(df, "wkt", "footprint", "wgs84"))
    r = lay.first()
    assert lay.count() == 1 and r.geometry.srid == 4326 and r.geometry.parts == [[[[10.0, 20.0]]]]
    stats = write_layer(to_layer(df, "wkt"), str(tmp_path / "layer"))
    assert stats["good"] == 1 and os.path.isdir(tmp_path / "layer" / "status=ok")
    back = spark.read.parquet(str(tmp_path / "layer")).first()
    assert back.geometry_wkt == "MULTIPOINT ((10 20))" and back.status == "ok"


def test_empty_partition_raises(spark, tmp_path):
    df = spark.createDataFrame([(1, "INVALID")], "id long, wkt string")
    with pytest.raises(ValueError, match="no usable geometry"):
        write_layer(to_layer(df, "wkt"), str(tmp_path / "empty"))


def test_layer_types_and_rollup(spark):
    df = spark.createDataFrame([(1, "POLYGON ((20 60, 21 60, 21 61, 20 61, 20 60))"), (2, ""), (3, None)],
                               "id long, wkt string")
    pts = good_rows(to_layer(df, "wkt", "point", "euref")).first().geometry
    assert pts.gtype == "POINT" and pts.srid == 3067 and 100000 < pts.parts[0][0][0][0] < 200000
    bbox = good_rows(to_layer(df, "wkt", "bbox", "wgs84")).first().geometry
    assert bbox.parts == [[[[20.0, 60.0], [21.0, 60.0], [21.0, 61.0], [20.0, 61.0], [20.0, 60.0]]]]
    roll = dict(reject_rollup(to_layer(df, "wkt")).collect())
    assert roll == {"ok": 1, "blank_wkt": 1, "null_wkt": 1}
    with pytest.raises(ValueError):
        to_layer(df, "wkt", "centroid", "wgs84")


def test_convert_export_end_to_end(spark, tmp_path):
    p = tmp_path / "data.tsv"
    p.write_text("id\tWGS84 WKT\n1\tPOINT (25 60)\n2\tnope\n", encoding="utf-8")
    out = convert_export(spark, str(p), str(tmp_path / "out"), kind="flat", geometry_type="point", crs="euref",
                         filename="data", log_dir=str(tmp_path / "log"))
    assert out["good"] == 1 and out["rows"] == 2 and out["conversion_id"] == "data_tech_point_euref"
    again = convert_export(spark, str(p), str(tmp_path / "out2"), kind="flat", geometry_type="point",
                           crs="euref", filename="data", log_dir=str(tmp_path / "log"))
    assert again.get("skipped") is True


def test_geojson_kml_gml_to_table(spark, tmp_path):
    gj = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"name": "a", "n": 1},
         "geometry": {"type": "MultiPoint", "coordinates": [[25.5, 60.25]]}},
        {"type": "Feature", "properties": {"name": "b", "n": 2},
         "geometry": {"type": "Polygon", "coordinates": [[[20, 60], [21, 60], [21, 61], [20, 60]]]}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(gj))
    kml = ('<kml><Document><Folder><Placemark><name>k1</name><Point><coordinates>24.5,60.5,0</coordinates>'
           '</Point></Placemark></Folder></Document></kml>')
    (tmp_path / "b.kml").write_text(kml)
    gml = ('<FeatureCollection xmlns:gml="http://www.opengis.net/gml"><gml:featureMember><site><label>g1</label>'
           '<geometry><gml:Point srsName="EPSG:3067"><gml:pos>500000 6651411.1902</gml:pos></gml:Point>'
           '</geometry></site></gml:featureMember></FeatureCollection>')
    (tmp_path / "c.gml").write_text(gml)
    layers = [read_geojson(spark, str(tmp_path / "a.geojson")), read_kml(spark, str(tmp_path / "b.kml")),
              read_gml(spark, str(tmp_path / "c.gml"), row_tag="gml:featureMember")]
    table = to_table(layers)
    assert table.columns[-1] == "footprintWKT"
    wkts = sorted(r.footprintWKT for r in table.collect())
    assert "POINT (25.5 60.25)" in wkts                      # one-part multipoint simplified
    assert "POLYGON ((20 60, 21 60, 21 61, 20 60))" in wkts
    assert "POINT (24.5 60.5)" in wkts
    assert "POINT (27 60)" in wkts                            # EPSG:3067 re-projected
    write_table_csv(table, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4


def test_skip_unreadable_layers_and_crs_guard(spark):
    from geospan.operators.union import read_layers_safely, require_crs

    good = spark.createDataFrame([(1, "POINT (1 2)", 4326)], "id long, wkt string, srid int")
    empty = good.limit(0)

    def broken():
        raise OSError("cannot read")

    layers = read_layers_safely({"a": lambda: good, "b": broken, "c": lambda: empty})
    assert len(layers) == 1
    with pytest.raises(RuntimeError, match="None of the layers"):
        read_layers_safely({"b": broken})
    nocrs = spark.createDataFrame([(1, "POINT (1 2)", None)], "id long, wkt string, srid int")
    with pytest.raises(RuntimeError, match="coordinate reference system"):
        require_crs([nocrs])
    require_crs([good])


def test_big_geometries_take_the_join_path(spark):
    wkts = ["POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))", "POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))",
            "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 3 2, 3 3, 2 3, 2 2))",
            "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (12 2, 13 2, 13 3, 12 3, 12 2))",
            "POINT (1 2)", "bad"]
    df = spark.createDataFrame(list(enumerate(wkts)), "id long, wkt string")
    inrow = {r.id: r.reject_reason for r in to_layer(df, "wkt").collect()}
    joined = {r.id: r.reject_reason for r in to_layer(df, "wkt", big_geometry_vertices=3).collect()}
    assert inrow == joined == {0: None, 1: "invalid", 2: None, 3: "invalid", 4: None, 5: "unparsable"}


def test_both_validity_paths_give_equal_answers(spark):
    import random

    def box(x, y, w, h=None):
        h = w if h is None else h
        return f"({x} {y}, {x + w} {y}, {x + w} {y + h}, {x} {y + h}, {x} {y})"
    big = box(0, 0, 10)
    fixed = {
        f"MULTIPOLYGON (({big}), ({box(2, 2, 1)}))": "invalid",  # nested parts
        f"MULTIPOLYGON (({big}, {box(2, 2, 4)}), ({box(3, 3, 1)}))": None,  # an island in a hole
        f"MULTIPOLYGON (({box(3, 3, 1)}), ({big}, {box(2, 2, 4)}))": None,
        f"POLYGON ({big}, {box(2, 2, 4)}, {box(3, 3, 1)})": "invalid",  # nested holes
        f"POLYGON ({big}, (0 5, 2 4, 2 6, 0 5))": None,  # a hole that touches its shell by its first vertex
        f"POLYGON ({big}, (10 5, 8 4, 8 6, 10 5))": None,
        f"POLYGON ({big}, (2 4, 0 5, 2 6, 2 4))": None,
        f"POLYGON ({big}, (0 5, -2 4, -2 6, 0 5))": "invalid",  # touches from outside
        f"POLYGON ({big}, (10 5, 12 4, 12 6, 10 5))": "invalid",
        f"POLYGON ({big}, {box(12, 2, 1)})": "invalid",
        f"POLYGON ({big}, {box(12, 20, 1)})": "invalid",
        "POLYGON ((0 0, 10 0, 10 5, 10 10, 0 10, 0 0), (9 4, 10 5, 11 6, 9 6, 9 4))": "invalid",  # passes through a vertex
        f"MULTIPOLYGON (({big}), ({box(10, 10, 2)}))": None,  # parts that touch at a point
    }
    rng = random.Random(4)
    made = list(fixed)
    for _ in range(120):
        rings = [box(*(rng.randint(0, 8) for _ in range(2)), rng.randint(1, 6), rng.randint(1, 6)) for _ in range(3)]
        tri = "({0} {1}, {2} {3}, {4} {5}, {0} {1})".format(*(rng.randint(0, 9) for _ in range(6)))
        made += [f"POLYGON ({big}, {tri}, {rings[0]})", f"MULTIPOLYGON (({big}, {rings[0]}), ({rings[1]}), ({tri}))"]
    df = spark.createDataFrame(list(enumerate(made)), "id long, wkt string")
    inrow = {r.id: r.reject_reason for r in to_layer(df, "wkt").collect()}
    joined = {r.id: r.reject_reason for r in to_layer(df, "wkt", big_geometry_vertices=3).collect()}
    assert [joined[i] for i in range(len(fixed))] == list(fixed.values())
    assert inrow == joined and 20 < sum(v is None for v in joined.values()) < len(made) - 20


def test_bounds_are_planned_once_and_points_are_their_own_centroids(spark):
    """Before, each of the four bounds columns held the whole expression, and a point's centroid all moments of its rings."""
    from geospan.functions import geometry as G
    from geospan.operators.layer import with_geometry
    from geospan.sinks.layers import layer_columns
    texts = ["POINT (1 2)", "MULTIPOINT (1 2, 3 6)", "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))", "POINT EMPTY", None]
    layer = with_geometry(spark.createDataFrame([(t,) for t in texts], "wkt string"), "wkt", drop_wkt=False).checkpoint()
    out = layer_columns(layer)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_min") == 2 and plan.count("array_max") == 2
    got = {r.wkt: (r.geometry_wkt, r.srid, r.minx, r.miny, r.maxx, r.maxy) for r in out.collect()}
    assert got["MULTIPOINT (1 2, 3 6)"] == ("MULTIPOINT ((1 2), (3 6))", 4326, 1, 2, 3, 6)
    assert got["POINT (1 2)"] == ("MULTIPOINT ((1 2))", 4326, 1, 2, 1, 2) and got[None] == got["POINT EMPTY"] == (None,) * 6
    centres = {r.wkt: r.c and (r.c.gtype, r.c.srid, r.c.parts) for r in layer.select("wkt", G.centroid(layer["geometry"]).alias("c")).collect()}
    assert [centres[t] for t in texts] == [("POINT", 4326, [[[[1, 2]]]]), ("POINT", 4326, [[[[2, 4]]]]), ("POINT", 4326, [[[[1, 1]]]]), None, None]
