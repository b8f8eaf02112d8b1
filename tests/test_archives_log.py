"""Archives (S08-S10, A05) and the conversion log."""

import datetime as dt
import zipfile

from pyspark.sql import functions as F

from geospan.operators import archives as A
from geospan.operators import convlog as L
from geospan.sources.archives import open_archives, payload_lines
from geospan.streaming.convlog import LOG_SCHEMA, current_status, start_status_stream


def _zip(path, members):
    with zipfile.ZipFile(path, "w") as zf:
        for name, data in members.items():
            zf.writestr(name, data)
    return str(path)


def test_sidecars_and_classification(spark, tmp_path):
    d = tmp_path / "zips"
    d.mkdir()
    _zip(d / "ok.zip", {"test.shp": "x", "test.shx": "x", "test.dbf": "x"})
    _zip(d / "bad.zip", {"Test.SHP": "x"})
    _zip(d / "occ.zip", {"readme.txt": "x", "occurrences.txt": "a\tb\n1\t2\n".encode() + "é\t3\n".encode("latin-1") + "é\t4\n".encode()})
    _zip(d / "rows.zip", {"x/rows_2.tsv": "h\nv\n", "rows_1.tsv": "h\nw\n"})
    archives = open_archives(spark, str(d))
    inv = archives.members
    missing = {(r.archive.rsplit("/", 1)[-1], r.shapefile): r.missing for r in A.missing_sidecars(inv).collect()}
    assert missing == {("bad.zip", "test.shp"): "test.dbf, test.shx"}
    msg = A.sidecar_message(A.missing_sidecars(inv)).first().message
    assert "files are missing" in msg and "'test.shp' missing test.dbf, test.shx" in msg
    kinds = {r.archive.rsplit("/", 1)[-1]: (r.payload_kind, r.payload_member)
             for r in A.classify_archives(inv).collect()}
    assert kinds["occ.zip"] == ("occurrences", "occurrences.txt")
    assert kinds["rows.zip"] == ("rows", "x/rows_2.tsv")      # first in archive order
    assert kinds["ok.zip"] == ("rejected", None)
    lines = payload_lines(archives, A.classify_archives(inv)).filter(F.col("archive").endswith("occ.zip"))
    assert [r.value for r in lines.orderBy("line_no").collect()] == ["a\tb", "1\t2", "é\t3", "é\t4"]


def _log_rows():
    t0 = dt.datetime(2024, 1, 1)
    return [
        ("c1", 1, t0, "processing", 0, None, None),
        ("c1", 2, t0 + dt.timedelta(minutes=1), "processing", 50, None, None),
        ("c1", 3, t0 + dt.timedelta(minutes=2), "complete", None, "out/c1.zip", None),
        ("c2", 4, t0, "processing", None, None, None),
        ("c3", 5, t0, "processing", 10, None, None),
        ("c3", 6, t0 + dt.timedelta(days=2), "failed", None, None, "boom"),
    ]


def test_latest_status_merge(spark):
    log = spark.createDataFrame(_log_rows(), LOG_SCHEMA)
    st = {r.conversion_id: r for r in L.latest_status(log).collect()}
    assert (st["c1"].status, st["c1"].progress_percent, st["c1"].output) == ("complete", 50, "out/c1.zip")
    assert (st["c2"].status, st["c2"].progress_percent) == ("processing", 0)
    assert (st["c3"].status, st["c3"].error, st["c3"].progress_percent) == ("failed", "boom", 10)
    assert L.active_count(L.latest_status(log)).first().processing == 1
    req = spark.createDataFrame([("c1",), ("c2",), ("c3",), ("c4",)], "conversion_id string")
    assert sorted(r[0] for r in L.skip_known(req, L.latest_status(log)).collect()) == ["c3", "c4"]
    now = F.lit(dt.datetime(2024, 1, 3, 12)).cast("timestamp_ntz")
    assert sorted(r.conversion_id for r in L.expired(L.latest_status(log), now).collect()) == ["c1", "c2"]


def test_progress_and_key(spark):
    r = spark.range(1).select(L.progress_percent(F.lit(29), F.lit(100)).alias("p"),
                              L.progress_percent(F.lit(3), F.lit(3)).alias("q"),
                              L.conversion_key(F.lit("HBF.1"), F.lit("fi"), F.lit("bbox"), F.lit("euref")).alias("k")
                              ).first()
    assert r.p == 28 and r.q == 99 and r.k == "HBF.1_fi_bbox_euref"   # float math as in the original


def test_status_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "log"
    spark.createDataFrame(_log_rows(), LOG_SCHEMA).write.parquet(str(src))
    q = start_status_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    batch = L.latest_status(spark.read.parquet(str(src)))
    columns = ["conversion_id", "status", "updated_at", "progress_percent", "output", "error"]
    got = current_status(spark, str(tmp_path / "out"))
    assert sorted(got.columns) == sorted(batch.columns)
    assert {tuple(r) for r in got.select(columns).collect()} == {tuple(r) for r in batch.select(columns).collect()}


def test_status_stream_drops_old_state(spark, tmp_path):
    src, rows = tmp_path / "log", []
    for day in (1, 11, 21):
        one = [(f"id{day}", day, dt.datetime(2024, 1, day), "processing", None, None, None)]
        spark.createDataFrame(one, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        q = start_status_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination(120)
        rows.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert rows[-1] <= 2  # of three ids ten days apart
    got = current_status(spark, str(tmp_path / "out"))
    assert {(r.conversion_id, r.progress_percent) for r in got.collect()} == {("id1", 0), ("id11", 0), ("id21", 0)}
