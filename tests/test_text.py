"""Text conversions, dictionary and readers."""

import os

from pyspark.sql import functions as F

from frames import rows_of
from geospan.functions.text import null_tokens, to_boolean, to_number
from geospan.sources.dictionary import column_types, read_dictionary
from geospan.sources.tsv import read_flat, read_occurrences, read_rows, typed_column


def test_convert_boolean_value(spark):
    vals = ["true", "TRUE", "1", "false", "FALSE", "0", "maybe", "2", "", "123", None]
    got = dict(rows_of(spark, vals, "v string").select("v", to_boolean(F.col("v")).alias("b")).collect())
    assert [got[v] for v in vals] == [True, True, True, False, False, False, None, None, None, None, None]


def test_convert_numeric_with_na(spark):
    vals = ["123", "123.45", "-10", "not_a_number", "", " 7 ", "1e2", "1_000", "2d", "inf", "nan", ".5", "5."]
    got = dict(rows_of(spark, vals, "v string").select("v", to_number(F.col("v")).alias("n")).collect())
    assert [got[v] for v in vals] == [123.0, 123.45, -10.0, None, None, 7.0, 100.0, 1000.0, None, None, None,
                                      0.5, 5.0]


def test_null_tokens(spark):
    vals = ["NA", "null", "", "n/a", "x", "#N/A"]
    got = dict(rows_of(spark, vals, "v string").select("v", null_tokens(F.col("v")).alias("t")).collect())
    assert got == {"NA": None, "null": None, "": None, "n/a": None, "x": "x", "#N/A": None}


def test_default_column_types(spark, tmp_path):
    p = tmp_path / "dict.tsv"
    p.write_text("tech\tfi\ten\tdtype\nid\ttunniste\tid\tint\nname\tnimi\tname\tstr\n"
                 "active\taktiivinen\tactive\tbool\n", encoding="utf-8")
    assert read_dictionary(spark, str(p), "en") == {"id": "int", "name": "str", "active": "bool"}
    assert read_dictionary(spark, str(p), "fi") == {"tunniste": "int", "nimi": "str", "aktiivinen": "bool"}
    tech = column_types("tech")
    assert tech["isSensitiveTaxon"] == "bool" and tech["individualCount"] == "int"
    assert column_types("fi")["WGS84 geometria"] == "object"


def test_converters_by_dtype(spark):
    df = rows_of(spark, ["1"], "v string")
    r = df.select(typed_column(F.col("v"), "bool").alias("b"), typed_column(F.col("v"), "int").alias("i"),
                  typed_column(F.col("v"), "str").alias("s")).first()
    assert (r.b, r.i, r.s) == (True, 1.0, "1")


def _write(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_read_occurrences_three_headers(spark, tmp_path):
    tech = ["occurrenceID", "scientificName", "isSensitiveTaxon", "individualCount", "footprintWKT"]
    fi = ["Havainnon tunniste", "Tieteellinen nimi", "Sensitiivinen laji", "Tulkittu yksilömäärä (min)",
          "WGS84 geometria"]
    en = ["Occurrence ID", "Scientific Name", "Is Sensitive Taxon", "Interpreted Individual Count (min)",
          "Footprint WKT"]
    lines = ["\t".join(tech), "\t".join(fi), "\t".join(en),
             'A1\tParus "major"\ttrue\t3\tPOINT (25 60)',
             "A2\tNA\tFALSE\t\tPOINT (26 61)",
             "A3\tshort row",
             "A4\ttoo\tmany\tfields\there\textra",
             "",
             "   "]
    path = _write(tmp_path / "occ.txt", lines)
    for lang, names in (("tech", tech), ("fi", fi), ("en", en)):
        df = read_occurrences(spark, path, lang)
        assert df.columns == names
        rows = sorted(df.collect(), key=lambda r: r[0])
        assert [r[0] for r in rows] == ["A1", "A2", "A3"]
        assert rows[0][1] == 'Parus "major"' and rows[0][2] is True and rows[0][3] == 3.0
        assert rows[1][1] is None and rows[1][2] is False and rows[1][3] is None
        assert rows[2][1] == "short row" and rows[2][4] is None


def test_read_flat_and_rows(spark, tmp_path):
    path = _write(tmp_path / "flat.tsv", ["id\tWGS84 WKT\tcount", "1\tPOINT (1 2)\t5", "2\tNA\t"])
    df = read_flat(spark, path)
    assert df.columns == ["id", "WGS84 WKT", "count"]
    assert sorted(tuple(r) for r in df.collect()) == [("1", "POINT (1 2)", "5"), ("2", None, None)]
    hdr = ["Unit.ID", "Gathering.Conversions.WGS84_WKT", "Gathering.Conversions.YKJ_1KM.Lat(N)",
           "Gathering.Conversions.WGS84.LatMin(N)"]
    path = _write(tmp_path / "rows_1.tsv", ["\t".join(hdr), "u1\tPOINT (1 2)\t667\t60.1"])
    df = read_rows(spark, path)
    assert df.columns == ["Unit.ID", "Gathering.Conversions.WGS84_WKT"]
