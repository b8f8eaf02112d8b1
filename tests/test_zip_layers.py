"""ZIP archives: byte ranges over the file system's reader, members, lines, and the job to layers."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from geospan.operators.archives import classify_archives
from geospan.plans.convert import NO_PAYLOAD_MESSAGE, convert_archives
from geospan.sinks.layers import NO_GEOMETRY_MESSAGE
from geospan.sources.archives import file_chunks, open_archives, payload_lines

HEADERS = ["occurrenceID\ttaxonRank\tfootprintWKT", "Havainnon tunniste\tTaksonominen taso\tWGS84 geometria",
           "Occurrence ID\tTaxon rank\tFootprint WKT"]


def packed(members, **options):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", options.pop("method", zipfile.ZIP_DEFLATED), **options) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


class Unseekable(io.RawIOBase):
    """Makes zipfile write sizes after the data."""

    def __init__(self):
        self.data = b""

    def writable(self):
        return True

    def write(self, b):
        self.data += bytes(b)
        return len(b)


def name_of(path):
    return path.rsplit("/", 1)[-1]


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_chunks_are_the_file(spark, tmp_path, small_splits):
    rng = random.Random(1)
    files = {"a.zip": rng.randbytes(150_000), "b.zip": b"\n\n", "c.zip": b"x", "d.zip": b"ends\n", "e.zip": b"\r\n\xff" * 900,
             "f.zip": b"no line end " * 5000}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    chunks = file_chunks(spark, str(tmp_path)).collect()
    got = {}
    for r in sorted(chunks, key=lambda r: (r.archive, r.at)):
        assert r.at == len(got.get(name_of(r.archive), b""))
        got[name_of(r.archive)] = got.get(name_of(r.archive), b"") + r.data
    assert got == files
    assert sum(name_of(r.archive) == "a.zip" for r in chunks) > 3  # read by several tasks


def test_members_and_lines(spark, tmp_path, small_splits):
    rng = random.Random(2)
    long = [f"{i}\t{rng.random()}\t{'é' * (i % 7)}" for i in range(6_000)]
    body = "\n".join(long).encode()
    descriptor = Unseekable()
    with zipfile.ZipFile(descriptor, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("occurrences.txt", body)
    big = packed([("readme.txt", "x"), ("sub/", ""), ("occurrences.txt", body)])
    wide = io.BytesIO()
    with zipfile.ZipFile(wide, "w") as z, z.open("occurrences.txt", "w", force_zip64=True) as member:
        member.write(b"\xef\xbb\xbfa\r\nb\r\n")
    bad_crc = bytearray(packed([("occurrences.txt", "first\nsecond\n")], method=zipfile.ZIP_STORED))
    bad_crc[bad_crc.find(b"second")] ^= 1
    noted = io.BytesIO()
    with zipfile.ZipFile(noted, "w") as z:
        z.writestr("occurrences.txt", "one\nlast line")
        z.comment = b"note " * 3000
    files = {"big.zip": big, "stored.zip": packed([("occurrences.txt", body)], method=zipfile.ZIP_STORED),
             "descriptor.zip": descriptor.data, "stub.zip": b"#!/bin/sh\n" * 900 + big, "wide.zip": wide.getvalue(),
             "crc.zip": bytes(bad_crc), "noted.zip": noted.getvalue(), "cut.zip": big[:-30], "empty.zip": b"",
             "none.zip": packed([]), "latin.zip": packed([("x/rows_1.tsv", "h\n".encode() + "é\n".encode("latin-1") + "é\n".encode())]),
             "bzip.zip": packed([("occurrences.txt", "x")], method=zipfile.ZIP_BZIP2)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    archives = open_archives(spark, str(tmp_path))
    members = {}
    for r in archives.members.collect():
        members.setdefault(name_of(r.archive), []).append((r.ord, r.member, r.size, r.is_dir, r.error))
    whole = (2, "occurrences.txt", len(body), False, None)
    assert sorted(members["big.zip"]) == [(0, "readme.txt", 1, False, None), (1, "sub/", 0, True, None), whole] == sorted(members["stub.zip"])
    assert members["cut.zip"] == [(-1, None, None, None, "not a ZIP archive")]
    assert members["empty.zip"] == [(-1, None, None, None, "empty file")]
    assert "none.zip" not in members  # an archive without entries
    lines, errors = {}, {}
    for r in payload_lines(archives, classify_archives(archives.members)).collect():
        if r.error:
            errors[name_of(r.archive)] = r.error
        else:
            lines.setdefault(name_of(r.archive), {})[r.line_no] = r.value
    lines = {k: [v[i] for i in range(len(v))] for k, v in lines.items()}
    assert all(lines[k] == long for k in ("big.zip", "stored.zip", "descriptor.zip", "stub.zip"))
    assert lines["wide.zip"] == ["a", "b"] and lines["noted.zip"] == ["one", "last line"] and lines["latin.zip"] == ["h", "é", "é"]
    assert errors == {"crc.zip": "damaged member", "bzip.zip": "compression method 12"}


@pytest.mark.parametrize("lang", ["tech", "fi", "en"])
def test_archives_to_layers(spark, tmp_path, lang):
    def export(rows, order=(0, 1, 2)):
        head = ["\t".join([h.split("\t")[i] for i in order]) for h in HEADERS]
        return "\n".join(head + ["\t".join([r[i] for i in order]) for r in rows]) + "\n"
    good = [("o1", "species", "POINT (25 60)"), ("o2", "NA", "POINT (26 61)"), ("o3", "genus", "junk")]
    files = {"plain.zip": [("occurrences.txt", export(good)), ("citation.txt", "x")],
             "turned.zip": [("occurrences.txt", export(good[:1] * 2, (2, 0, 1)))],
             "latin.zip": [("occurrences.txt", export([("ä", "lajî", "POINT (24 60)")]).encode("latin-1"))],
             "rows.zip": [("d/rows_7.tsv", "Unit\tGathering.Conversions.WGS84_WKT\tGathering.Conversions.WGS84.LatMin(N)\nu1\tPOINT (25 62)\t62\n")],
             "nothing.zip": [("occurrences.txt", export([("o", "x", "")]))],
             "other.zip": [("data.csv", "a,b")]}
    if lang != "tech":  # the other two differ in the header line only
        files = {name: files[name] for name in ("plain.zip", "turned.zip", "latin.zip")}
    for name, members in files.items():
        (tmp_path / name).write_bytes(packed(members))
    (tmp_path / "torn.zip").write_bytes(packed(files["plain.zip"])[:200])
    out = tmp_path / "out"
    got = {name_of(r.archive): (r.payload_kind, r.rows, r.good, r.error)
           for r in convert_archives(spark, str(tmp_path), str(out), lang, "bbox", "wgs84").collect()}
    want = {
        "plain.zip": ("occurrences", 3, 2, None), "turned.zip": ("occurrences", 2, 2, None), "latin.zip": ("occurrences", 1, 1, None),
        "rows.zip": ("rows", 1, 1, None), "nothing.zip": ("occurrences", 1, 0, NO_GEOMETRY_MESSAGE),
        "other.zip": ("rejected", 0, 0, NO_PAYLOAD_MESSAGE), "torn.zip": ("rejected", 0, 0, "not a ZIP archive")}
    assert got == {name: row for name, row in want.items() if name in files or name == "torn.zip"}
    column = HEADERS[["tech", "fi", "en"].index(lang)].split("\t")
    seen = []
    for layer in sorted(out.glob("layer=*")):
        df = spark.read.parquet(str(layer)).filter("status = 'ok'")
        if column[0] in df.columns:
            seen += [(name_of(r._archive), r[column[0]], r[column[1]], r.geometry_wkt) for r in df.collect()]
        else:
            assert "Gathering.Conversions.WGS84.LatMin(N)" not in df.columns
    assert sorted(seen) == [("latin.zip", "ä", "lajî", "MULTIPOINT ((24 60))"), ("plain.zip", "o1", "species", "MULTIPOINT ((25 60))"),
                            ("plain.zip", "o2", None, "MULTIPOINT ((26 61))"), *[("turned.zip", "o1", "species", "MULTIPOINT ((25 60))")] * 2]
