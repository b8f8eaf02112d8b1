"""Files of several languages, kinds, headers, types and CRSs in one batch."""

from pyspark.sql import functions as F

from geospan.streaming.landing import NO_LAYER_MESSAGE, NO_REQUEST_MESSAGE, REQUEST_SCHEMA, convert_requests, export_lines


def test_each_file_is_converted_as_its_request_says(spark, tmp_path):
    from geospan.sources.tsv import WKT_COLUMN
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    landing.mkdir()
    ids = {"tech": "ID_t", "fi": "ID_f", "en": "ID_e"}
    box = "POLYGON ((24 60, 26 60, 26 62, 24 62, 24 60))"

    def occurrences(name, order, rows):
        heads = [[ids[lang], WKT_COLUMN[lang]] for lang in ("tech", "fi", "en")]
        lines = [h[::order] for h in heads] + [r[::order] for r in rows]
        (landing / name).write_text("".join("\t".join(x) + "\n" for x in lines), encoding="utf-8")
    occurrences("a.tsv", 1, [["1", box], ["2", "nope"]])
    occurrences("b.tsv", -1, [["3", box]])  # the other order of columns
    occurrences("c d+e [1].tsv", 1, [["4", "POINT (27 60)"]])
    (landing / "f.tsv").write_text("id\tWGS84 WKT\n5\tPOINT (25 60)\n6\tPOINT (25 61)\n", encoding="utf-8")
    (landing / "lost.tsv").write_text("id\tWGS84 WKT\n7\tPOINT (25 60)\n", encoding="utf-8")
    (landing / "odd.tsv").write_text("id\tsomething\n8\tx\n", encoding="utf-8")
    requests = [("a.tsv", "occurrences", "tech", "point", "wgs84"), ("b.tsv", "occurrences", "tech", "point", "wgs84"),
                ("c d+e [1].tsv", "occurrences", "fi", "footprint", "euref"), ("f.tsv", "flat", "en", "bbox", "wgs84"),
                ("odd.tsv", "flat", "en", "bbox", "wgs84")]
    spark.createDataFrame(requests, REQUEST_SCHEMA).write.parquet(str(tmp_path / "requests"))
    for _ in range(2):  # a second run finds nothing new
        convert_requests(spark, str(landing), str(tmp_path / "requests"), out, str(tmp_path / "ck")).awaitTermination(120)
    outcomes = {r.path.rsplit("/", 1)[1]: (r.rows, r.good, r.error) for r in spark.read.parquet(out + "/outcomes/batch=0").collect()}
    assert outcomes == {"a.tsv": (2, 1, None), "b.tsv": (1, 1, None), "c d+e [1].tsv": (1, 1, None), "f.tsv": (2, 2, None),
                        "lost.tsv": (0, 0, NO_REQUEST_MESSAGE), "odd.tsv": (0, 0, NO_LAYER_MESSAGE)}
    got = {}
    for path in sorted((tmp_path / "out" / "layers" / "batch=0").glob("request=*/layer=*")):
        for r in spark.read.parquet(str(path)).filter("status = 'ok'").collect():
            key = next(r[c] for c in ("ID_t", "ID_f", "ID_e", "id") if c in r.__fields__)
            got[key] = (r.geometry_wkt, r.srid)
    assert got["1"] == got["3"] == ("MULTIPOINT ((25 61))", 4326)
    assert got["4"][1] == 3067 and got["4"][0].startswith("MULTIPOINT ((500000 ")
    assert {got["5"][1], got["6"][1]} == {4326} and set(got) == {"1", "3", "4", "5", "6"}


def test_line_numbers_of_files_in_many_splits(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.txt").write_text("".join(f"{n} {i}\n" for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = export_lines(spark, [str(tmp_path / f"{n}.txt") for n in range(3)])
        heads = rows.filter(F.col("line_no") < 3).collect()
        assert rows.count() == 6000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.value, r.line_no) for r in heads) == [(f"{n} {i}", i) for n in range(3) for i in range(3)]
