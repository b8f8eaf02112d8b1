"""Vector files: GeoJSON over several tasks, KML and GML structure, broken sources."""

import json
import random

import pytest
from pyspark.sql import functions as F

from geospan.sources import archives
from geospan.sources.geojson import split_features
from geospan.sources.vector import read_geojson, read_gml, read_kml, read_vector


def feature(props, geometry, **more):
    return {"type": "Feature", **more, "properties": props, "geometry": geometry}


def collection(features, **more):
    return {"type": "FeatureCollection", **more, "features": features}


def point(x, y, *z):
    return {"type": "Point", "coordinates": [x, y, *z]}


@pytest.fixture
def small_splits(spark, monkeypatch):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    monkeypatch.setattr(archives, "_CHUNK_BYTES", 100)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_one_geojson_line_is_read_by_many_tasks(spark, tmp_path, small_splits):
    rng = random.Random(5)
    texts = ['a}b{c', 'say "hi"', "back\\slash\\", '\\"}', "[{]}", "plain", "Ä 村", "}" * 40, '"features": [{']
    feats = []
    for n in range(300):
        props = {"n": n, "text": rng.choice(texts), "deep": {"a": [{"b": n}], "c": {"d": "}"}}}
        line = [[rng.randint(0, 99), rng.randint(0, 99)] for _ in range(rng.choice([2, 3, 90]))]
        geom = rng.choice([point(n, 1), {"type": "LineString", "coordinates": line}, None])
        feats.append(feature(props, geom, id=n) if n % 3 else {"geometry": geom, "properties": props, "type": "Feature"})
    crs = {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3067"}}
    (tmp_path / "a.geojson").write_text(json.dumps(collection(feats, crs=crs, bbox=[0, 0, 1, 1]), ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.geojson").write_text(json.dumps({"features": feats[:7], "type": "FeatureCollection"}, indent=2))
    (tmp_path / "c.json").write_text(json.dumps(collection([])))
    chunks = archives.file_chunks(spark, str(tmp_path), "*.*json", sep="}")
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "a.geojson")).rdd.getNumPartitions() > 5
    assert chunks.count() > 20
    got = read_geojson(spark, str(tmp_path)).collect()
    want = []
    for part, srid in ((feats, 3067), (feats[:7], 4326)):
        for f in part:
            g = f["geometry"]
            wkt = None if g is None else "POINT ({} {})".format(*g["coordinates"]) if g["type"] == "Point" else \
                "LINESTRING (" + ", ".join(f"{x} {y}" for x, y in g["coordinates"]) + ")"
            want.append((f["properties"]["n"], f["properties"]["text"], f["properties"]["deep"]["a"][0]["b"], wkt, srid))
    assert sorted(((r.n, r.text, r.deep.a[0].b, r.wkt, r.srid) for r in got), key=str) == sorted(want, key=str)


def test_geojson_shapes_crs_and_names(spark, tmp_path):
    ring, hole = [[0, 0], [9, 0], [9, 9], [0, 0]], [[5, 2], [6, 2], [6, 3], [5, 2]]
    shapes = {
        "POINT (1.5 -2)": point(1.5, -2, 30),
        "POINT (1 2)": {"type": "Point", "coordinates": [1, 2]},
        "POLYGON ((0 0, 9 0, 9 9, 0 0), (5 2, 6 2, 6 3, 5 2))": {"type": "Polygon", "coordinates": [ring, hole]},
        "MULTIPOLYGON (((0 0, 9 0, 9 9, 0 0)), ((5 2, 6 2, 6 3, 5 2)))": {"type": "MultiPolygon", "coordinates": [[ring], [hole]]},
        "MULTILINESTRING ((0 0, 9 0), (1 1, 2 2))": {"type": "MultiLineString", "coordinates": [[[0, 0, 1], [9, 0, 1]], [[1, 1], [2, 2]]]},
        "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))": {"type": "GeometryCollection", "geometries": [
            point(1, 2), {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}]},
        "POINT EMPTY": {"type": "Point", "coordinates": []},
        "GEOMETRYCOLLECTION EMPTY": {"type": "GeometryCollection", "geometries": []},
    }
    feats = [feature({"wkt": k, "Name": "x"}, g) for k, g in shapes.items()]
    crs84 = {"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}}
    (tmp_path / "a.geojson").write_text(json.dumps(collection(feats, crs=crs84)))
    got = read_geojson(spark, str(tmp_path), srid=3067).collect()
    assert sorted((r.wkt_property, r.wkt, r.srid) for r in got) == sorted((k, k, 4326) for k in shapes)
    declared = read_geojson(spark, str(tmp_path), properties="Name string, missing int")
    assert declared.columns == ["Name", "missing", "wkt", "srid"] and declared.count() == len(shapes)


def test_single_feature_damaged_and_empty_files(spark, tmp_path):
    (tmp_path / "one.geojson").write_text(json.dumps(feature({"a": {"b": {"c": 1}}}, point(1, 2))))
    (tmp_path / "bare.geojson").write_text(json.dumps(point(3, 4)))
    (tmp_path / "none.geojson").write_text(json.dumps(collection([])))
    cut = json.dumps(collection([feature({"a": {"b": {"c": 2}}}, point(5, 6))] * 3))[:-40]
    (tmp_path / "cut.geojson").write_text(cut)
    issues = []
    rows = read_geojson(spark, str(tmp_path), issues=issues).collect()
    assert sorted(r.wkt for r in rows) == ["POINT (1 2)", "POINT (3 4)"]
    assert [(p.rsplit("/", 1)[1], e) for p, e in issues] == [("cut.geojson", "not a whole JSON text")]
    with pytest.raises(RuntimeError, match="cut.geojson"):
        read_geojson(spark, str(tmp_path))
    _, files = split_features(spark, str(tmp_path))
    assert files.count() == 4 and files.filter(F.col("error").isNotNull()).count() == 1


def test_kml_structure(spark, tmp_path, small_splits):
    ring = "0,0,1 9,0,1 9,9,1 0,0,1"
    marks = {
        "hole": (f"<Polygon><outerBoundaryIs><LinearRing><coordinates>{ring}</coordinates></LinearRing></outerBoundaryIs>"
                 "<innerBoundaryIs><LinearRing><coordinates>\n 5,2 6,2\n6,3 5,2 </coordinates></LinearRing></innerBoundaryIs>"
                 "<innerBoundaryIs><LinearRing><coordinates>7,2 8,2 8,3 7,2</coordinates></LinearRing></innerBoundaryIs></Polygon>",
                 "POLYGON ((0 0, 9 0, 9 9, 0 0), (5 2, 6 2, 6 3, 5 2), (7 2, 8 2, 8 3, 7 2))"),
        "points": ("<MultiGeometry><Point><coordinates>1,2</coordinates></Point><Point><coordinates>3, 4</coordinates></Point></MultiGeometry>",
                   "MULTIPOINT ((1 2), (3 4))"),
        "nested": ("<MultiGeometry><Point><coordinates>1,2</coordinates></Point><MultiGeometry><LineString><coordinates>1,2 3,4"
                   "</coordinates></LineString><MultiGeometry><Point><coordinates>5,6</coordinates></Point></MultiGeometry>"
                   "</MultiGeometry></MultiGeometry>", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (1 2, 3 4), POINT (5 6))"),
        "one": ("<MultiGeometry><Point><coordinates>1,2</coordinates></Point></MultiGeometry>", "POINT (1 2)"),
        "none": ("", None),
        "void": ("<Point><coordinates> </coordinates></Point>", None),
    }
    body = "".join(
        f'<Placemark id="{k}"><name>{k} &amp; co</name><ExtendedData><Data name="n"><value>{i}</value></Data>'
        f'<SchemaData schemaUrl="#s"><SimpleData name="species">sp {i}</SimpleData><SimpleData name="bad">x</SimpleData></SchemaData>'
        f"</ExtendedData><styleUrl>#p</styleUrl>{g}</Placemark>\n" for i, (k, (g, _)) in enumerate(marks.items()))
    (tmp_path / "a.kml").write_text(f'<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder>{body * 20}'
                                    "</Folder></Document></kml>")
    rows = read_kml(spark, str(tmp_path / "a.kml"), attributes="species string, n int, bad int, name string").collect()
    want = [(f"{k} & co", w, f"sp {i}", i, None, None) for i, (k, (_, w)) in enumerate(marks.items())] * 20
    assert sorted(((r.name, r.wkt, r.species, r.n, r.bad, r.name_data) for r in rows), key=str) == sorted(want, key=str)
    assert {r.srid for r in rows} == {4326}


def test_gml_structure_and_axis_order(spark, tmp_path):
    ns = 'xmlns:gml="http://www.opengis.net/gml/3.2"'
    ring = "<gml:LinearRing><gml:posList>{}</gml:posList></gml:LinearRing>"
    poly = ("<gml:Polygon{}><gml:exterior>" + ring.format("60 20 60 21 61 21 60 20") + "</gml:exterior><gml:interior>"
            + ring.format("60.2 20.5 60.2 20.6 60.3 20.6 60.2 20.5") + "</gml:interior></gml:Polygon>")
    lonlat = "((20 60, 21 60, 21 61, 20 60), (20.5 60.2, 20.6 60.2, 20.6 60.3, 20.5 60.2))"
    urn, short = ' srsName="urn:ogc:def:crs:EPSG::4326"', ' srsName="EPSG:3067"'
    shapes = [
        (poly.format(urn), "POLYGON " + lonlat, 4326),
        (poly.format(' srsName="http://www.opengis.net/def/crs/EPSG/0/4326"'), "POLYGON " + lonlat, 4326),
        (f"<gml:MultiSurface{urn}><gml:surfaceMember>{poly.format('')}</gml:surfaceMember></gml:MultiSurface>",
         f"MULTIPOLYGON ({lonlat})", 4326),
        ('<gml:Point srsName="EPSG:4326"><gml:pos>20 60</gml:pos></gml:Point>', "POINT (20 60)", 4326),
        (f'<gml:Point{urn}><gml:pos srsDimension="3">60 20 5</gml:pos></gml:Point>', "POINT (20 60)", 4326),
        ('<gml:Point srsName="urn:ogc:def:crs:EPSG::3067"><gml:pos>500000 6651411</gml:pos></gml:Point>', "POINT (500000 6651411)", 3067),
        (f'<gml:MultiPoint{short}><gml:pointMember><gml:Point><gml:pos>1 2</gml:pos></gml:Point></gml:pointMember><gml:pointMember>'
         "<gml:Point><gml:coordinates>3,4</gml:coordinates></gml:Point></gml:pointMember></gml:MultiPoint>", "MULTIPOINT ((1 2), (3 4))", 3067),
        (f"<gml:MultiPoint{short}><gml:pointMembers><gml:Point><gml:pos>1 2</gml:pos></gml:Point><gml:Point><gml:pos>3 4</gml:pos>"
         "</gml:Point></gml:pointMembers></gml:MultiPoint>", "MULTIPOINT ((1 2), (3 4))", 3067),
        (f'<gml:LineString{short}><gml:posList srsDimension="3">1 2 0 3 4 0</gml:posList></gml:LineString>', "LINESTRING (1 2, 3 4)", 3067),
        (f"<gml:LineString{short}><gml:pos>1 2</gml:pos><gml:pos>3 4</gml:pos></gml:LineString>", "LINESTRING (1 2, 3 4)", 3067),
        (f"<gml:Curve{short}><gml:segments><gml:LineStringSegment><gml:posList>1 2 3 4</gml:posList></gml:LineStringSegment>"
         "<gml:LineStringSegment><gml:posList>3 4 5 6</gml:posList></gml:LineStringSegment></gml:segments></gml:Curve>",
         "LINESTRING (1 2, 3 4, 5 6)", 3067),
        ("<gml:Polygon><gml:outerBoundaryIs><gml:LinearRing><gml:coordinates>0,0 9,0 9,9 0,0</gml:coordinates></gml:LinearRing>"
         "</gml:outerBoundaryIs></gml:Polygon>", "POLYGON ((0 0, 9 0, 9 9, 0 0))", None),
        ("", None, None),
    ]
    members = "".join(f'<gml:featureMember><s:site gml:id="s.{i}"><gml:boundedBy><gml:Envelope/></gml:boundedBy><s:label>l{i}</s:label>'
                      f"<s:n>{i}</s:n>{'<s:last>x</s:last>' if i == 12 else ''}<s:geom>{g}</s:geom></s:site></gml:featureMember>" for i, (g, _, _) in enumerate(shapes))
    (tmp_path / "a.gml").write_text(f"<s:c {ns}>{members}</s:c>")
    want = [(f"l{i}", i, w, s) for i, (_, w, s) in enumerate(shapes)]
    inferred = read_gml(spark, str(tmp_path / "a.gml"), row_tag="gml:featureMember")
    declared = read_gml(spark, str(tmp_path / "a.gml"), row_tag="gml:featureMember", geometry_field="geom", feature="site",
                        properties="label string, n int")
    assert inferred.filter("last = 'x'").first().n == 12
    for df in (declared, inferred):
        assert sorted((r.label, r.n, r.wkt, r.srid) for r in df.collect()) == sorted(want)


def test_read_vector_leaves_broken_sources_out(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps(collection([feature({"n": 1}, point(1, 2))])))
    (tmp_path / "b.kml").write_text("<kml><Placemark><name>k</name><Point><coordinates>3,4</coordinates></Point></Placemark></kml>")
    layers = read_vector(spark, [str(tmp_path / "a.geojson"), str(tmp_path / "gone.geojson"), (str(tmp_path / "b.kml"), {"depth": 1}),
                                 str(tmp_path / "c.shp")])
    assert [df.first().wkt for df in layers] == ["POINT (1 2)", "POINT (3 4)"]
    with pytest.raises(RuntimeError, match="None of the layers"):
        read_vector(spark, [str(tmp_path / "gone.kml")])


def test_path_job_scans_once_and_keeps_an_earlier_table(spark, tmp_path):
    from geospan.plans.convert import convert_vector

    out = str(tmp_path / "csv")
    good = tmp_path / "a.geojson"
    good.write_text(json.dumps(collection([feature({"n": 1}, {"type": "MultiPoint", "coordinates": [[1, 2]]}), feature({"n": 2}, None)])))
    done = convert_vector(spark, [str(good)], out)
    assert done == {"rows": 2, "unparsable": 0, "path": out}
    read = spark.read.option("header", True).csv(out)
    assert read.columns == ["n", "footprintWKT"] and sorted((r.n, r.footprintWKT) for r in read.collect()) == [("1", "POINT (1 2)"), ("2", None)]
    none = tmp_path / "none.geojson"
    none.write_text(json.dumps(collection([])))
    odd = tmp_path / "odd.geojson"
    odd.write_text(json.dumps(collection([feature({}, point(1, 2))], crs={"type": "name", "properties": {"name": "EPSG:2393"}})))
    lost = tmp_path / "lost.geojson"
    lost.write_text(json.dumps(collection([feature({}, point(1, 2))], crs={"type": "name", "properties": {"name": "urn:ogc:def:crs:x"}})))
    for bad, words in ((none, "no features"), (odd, "cannot be converted"), (lost, "no coordinate reference system")):
        with pytest.raises(RuntimeError, match=words):
            convert_vector(spark, [str(bad)], out)
        assert spark.read.option("header", True).csv(out).count() == 2
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_dir()) == ["csv"]
