"""Landing-directory conversion (O05) and text decoding fallback."""

from pyspark.sql import functions as F

from geospan.sources.tsv import decode_text
from geospan.streaming.convlog import convert_landing


def test_landing_directory_conversion(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    names = ["id", "WGS84 WKT"]
    (landing / "a.tsv").write_text("id\tWGS84 WKT\n1\tPOINT (25 60)\n2\tbad\n", encoding="utf-8")
    (landing / "b.tsv").write_text("id\tWGS84 WKT\n3\tPOINT (26 61)\n", encoding="utf-8")
    q = convert_landing(spark, str(landing), str(tmp_path / "out"), str(tmp_path / "ck"), names, "WGS84 WKT",
                        geometry_type="point", crs="euref")
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    ok = out.filter(F.col("status") == "ok")
    assert sorted(r.id for r in ok.collect()) == ["1", "3"]
    assert {r.srid for r in ok.collect()} == {3067}
    assert [r.reject_reason for r in out.filter(F.col("status") == "rejected").collect()] == ["unparsable"]


def test_decode_text_latin1_fallback(spark):
    df = spark.createDataFrame([(bytearray("Ä".encode("latin-1")),), (bytearray("Ä".encode("utf-8")),)], "b binary")
    got = [r.t for r in df.select(decode_text(F.col("b")).alias("t")).collect()]
    assert got == ["Ä", "Ä"]


def test_vector_file_latin1_fallback(spark, tmp_path):
    import json

    from geospan.sources.vector import file_encoding, read_geojson

    gj = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"name": "Äänekoski"},
         "geometry": {"type": "Point", "coordinates": [25.7, 62.6]}}]}
    (tmp_path / "latin.geojson").write_bytes(json.dumps(gj, ensure_ascii=False).encode("latin-1"))
    (tmp_path / "utf").mkdir()
    (tmp_path / "utf" / "u.geojson").write_text(json.dumps(gj, ensure_ascii=False), encoding="utf-8")
    assert file_encoding(spark, str(tmp_path / "latin.geojson")) == "ISO-8859-1"
    assert file_encoding(spark, str(tmp_path / "utf")) == "UTF-8"
    for p in (tmp_path / "latin.geojson", tmp_path / "utf"):
        r = read_geojson(spark, str(p)).first()
        assert r.name == "Äänekoski" and r.wkt == "POINT (25.7 62.6)"


def test_each_vector_file_has_its_own_charset(spark, tmp_path):
    from geospan.sources.vector import read_geojson, read_gml, read_kml
    for kind in ("geojson", "kml", "gml"):
        (tmp_path / kind).mkdir()
    for n, (name, enc) in enumerate([("Mörkö", "utf-8"), ("Kesämäki", "latin-1"), ("plain", "utf-8"), ("Åbo 村", "utf-8")]):
        bodies = {
            "geojson": '{"type": "FeatureCollection", "features": [\n{"type": "Feature", "properties": {"name": "%s"}, '
                       '"geometry": {"type": "Point", "coordinates": [1, 2]}}]}' % name,
            "kml": "<kml><Placemark><name>%s</name><Point><coordinates>1,2</coordinates></Point></Placemark></kml>" % name,
            "gml": '<c><featureMember><t><name>%s</name><geometry><Point srsName="EPSG:4326"><pos>1 2</pos></Point>'
                   "</geometry></t></featureMember></c>" % name}
        for kind, body in bodies.items():
            (tmp_path / kind / f"{n} [a].{kind}").write_bytes(body.encode(enc))
    for kind, read in (("geojson", read_geojson), ("kml", read_kml), ("gml", read_gml)):
        rows = read(spark, str(tmp_path / kind)).collect()
        assert sorted((r.name, r.wkt) for r in rows) == sorted(
            (n, "POINT (1 2)") for n in ("Mörkö", "Kesämäki", "plain", "Åbo 村"))
