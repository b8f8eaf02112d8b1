"""ZIP archives on any storage that Spark reads.

A file is scanned as raw bytes by Spark's own splittable text source: records
end at byte 0x0A, nothing is decoded, and each task joins its records back into
chunks of a few megabytes. One file is thus read by as many tasks as it has
splits, through whatever file system its path names, with no local path, no
limit on its size and no whole file in a row. Chunks are written once as a
table; their lengths alone give each its offset.

The directory of an archive and the chosen member are byte ranges of it: the
chunks that overlap a range are sorted and streamed through one task, which
parses entries or inflates as they come and never holds the range. Inflating
a member is sequential by its format; its lines are written as a table, from
where they are read in parallel again.
"""

from __future__ import annotations

import codecs
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geospan.session import checkpoint_dir

MEMBERS_SCHEMA = ("archive string, ord long, member string, size long, is_dir boolean, packed long, header_at long, "
                  "method int, crc long, encrypted boolean, error string")
LINES_SCHEMA = "archive string, member string, line_no long, value string, error string"
_CHUNKS_SCHEMA = "archive string, file_size long, block long, seq int, data binary"
_RANGE_SCHEMA = "archive string, dir_at long, dir_size long, entries long, shift long, error string"
_CHUNK_BYTES = 4 << 20
_LINES = 10000

# Fixed values of the ZIP format: signatures, layouts (little-endian) and the marks of 64-bit fields.
END_SIGNATURE, END64_SIGNATURE, LOCATOR_SIGNATURE = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
ENTRY_SIGNATURE, LOCAL_SIGNATURE = b"PK\x01\x02", b"PK\x03\x04"
END_LAYOUT, END64_LAYOUT, LOCATOR_LAYOUT = "<4s4H2LH", "<4sQ2H2L4Q", "<4sLQL"
ENTRY_LAYOUT, LOCAL_LAYOUT = "<4s6H3L5H2L", "<4s5H3L2H"
MARK_16, MARK_32, EXTRA_64, UTF8_FLAG, ENCRYPTED_FLAG = 0xFFFF, 0xFFFFFFFF, 1, 0x800, 1
STORED, DEFLATED = 0, 8
#: The end record may be this far from the end of the file: its comment, itself, the 64-bit records before it.
_TAIL = 65535 + 22 + 20 + 56


@dataclass
class Archives:
    """``chunks``: archive, file_size, at, data. ``members``: one row per entry (``MEMBERS_SCHEMA``)."""

    chunks: DataFrame
    members: DataFrame


def _stored(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _join_records(batches: Iterator[pa.RecordBatch], sep: bytes) -> Iterator[pa.RecordBatch]:
    """Records of a split -> chunks that end with ``sep``; ``seq`` counts them within the split."""
    key, seq, held, size = None, 0, [], 0

    def chunk():
        return pa.RecordBatch.from_pydict({"archive": [key[0]], "file_size": [key[1]], "block": [key[2]],
                                           "seq": pa.array([seq], pa.int32()), "data": [b"".join(held)]})
    for batch in batches:
        if not batch.num_rows:
            continue
        files = pc.dictionary_encode(batch.column("archive")).indices.to_numpy()
        blocks = batch.column("block").to_numpy()
        ends = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for low, high in zip([0, *ends], [*ends, batch.num_rows]):
            run = batch.slice(low, high - low)
            now = tuple(run.column(c)[0].as_py() for c in ("archive", "file_size", "block"))
            if now != key or size >= _CHUNK_BYTES:
                if held:
                    yield chunk()
                seq, held, size = (seq + 1 if now == key else 0), [], 0
                key = now
            value = run.column("value")
            whole = pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value)
            held += [pc.binary_join(whole, pa.scalar(sep, value.type))[0].as_py(), sep]
            size += len(held[-2]) + 1
    if held:
        yield chunk()


def _path(uri: Column) -> Column:
    """Local files are named with one slash or with three; here with one."""
    return F.regexp_replace(uri, "^file:/+", "file:/")


def file_chunks(spark: SparkSession, path: str, glob: str = "*.zip", sep: str = "\n") -> DataFrame:
    """Whole files as chunks ``archive, file_size, at, data``; ``at`` is the offset of ``data``'s first byte.

    A chunk ends just after a ``sep`` (one ASCII character), or with its file.
    """
    end = sep.encode("ascii")
    records = (spark.read.option("lineSep", sep).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
               .text(path).select(F.col("value").cast("binary").alias("value"), _path(F.col("_metadata.file_path")).alias("archive"),
                                  F.col("_metadata.file_size").alias("file_size"),
                                  F.col("_metadata.file_block_start").alias("block")))
    chunks = _stored(records.mapInArrow(lambda batches: _join_records(batches, end), _CHUNKS_SCHEMA))
    place = ["archive", "block", "seq"]
    before = Window.partitionBy("archive").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select(*place, F.length("data").alias("n")).select(
        *place, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"))
    # The last record of a file may have had no line end.
    kept = F.least(F.length("data"), (F.col("file_size") - F.col("at")).cast("int"))
    return chunks.join(offsets, place).select("archive", "file_size", "at",
                                              F.substring("data", F.lit(1), kept).alias("data"))


def _ordered(chunks: DataFrame, ranges: DataFrame, low: Column, high: Column, keys: list[str]) -> DataFrame:
    """The bytes [low, high) of each row of ``ranges``, as chunks sorted within their partition by key and offset."""
    wanted = ranges.withColumn("_low", low).withColumn("_high", high)
    hit = chunks.join(wanted, "archive").filter((F.col("at") < F.col("_high")) & (F.col("at") + F.length("data") > F.col("_low")))
    skip = F.greatest(F.col("_low") - F.col("at"), F.lit(0)).cast("int")
    length = F.least(F.length("data"), (F.col("_high") - F.col("at")).cast("int")) - skip
    # One partition for each range as far as there are cores: what a task streams is a matter of its time alone.
    return (hit.withColumn("data", F.substring("data", skip + 1, length))
            .repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "at"))


def _streams(batches, n_keys: int) -> Iterator[tuple]:
    """``(row, pieces)`` for each run of rows with equal first ``n_keys`` columns; ``pieces`` yields their data."""
    def rows():
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                yield {c: batch.column(c)[i].as_py() for c in names}
    source = rows()
    row = next(source, None)
    while row is not None:
        key = [row[c] for c in list(row)[:n_keys]]
        rest = [row]

        def pieces():
            while rest:
                yield rest[0]["data"]
                following = next(source, None)
                if following is None or [following[c] for c in list(following)[:n_keys]] != key:
                    rest.clear()
                    ahead.append(following)
                else:
                    rest[0] = following
        ahead: list = []
        stream = pieces()
        yield row, stream
        for _ in stream:  # what the consumer left
            pass
        row = ahead[0]


def _find_directories(batches):
    for first, pieces in _streams(batches, 1):
        tail, size = b"".join(pieces), first["file_size"]
        base, row = size - len(tail), None
        at = tail.rfind(END_SIGNATURE)
        if at >= 0 and len(tail) - at >= struct.calcsize(END_LAYOUT):
            _, _, _, _, entries, dir_size, dir_at, _ = struct.unpack_from(END_LAYOUT, tail, at)
            end = base + at
            locator = at - struct.calcsize(LOCATOR_LAYOUT)
            if locator >= 0 and tail[locator:locator + 4] == LOCATOR_SIGNATURE:
                wide = tail.rfind(END64_SIGNATURE, 0, locator)
                if wide >= 0:
                    *_, entries, dir_size, dir_at = struct.unpack_from(END64_LAYOUT, tail, wide)
                    end = base + wide
            # Bytes before the archive (a self-extracting stub) shift all its offsets.
            if dir_size <= end and dir_at <= end - dir_size:
                row = (first["archive"], end - dir_size, dir_size, entries, end - dir_size - dir_at, None)
        yield _table([row or (first["archive"], None, None, None, None, "not a ZIP archive")], _RANGE_SCHEMA)


def _parse_directories(batches):
    for first, pieces in _streams(batches, 1):
        archive, held, at, ord_, rows = first["archive"], b"", 0, 0, []
        need = struct.calcsize(ENTRY_LAYOUT)
        entries = first["entries"]
        for piece in pieces:
            held, at = held[at:] + piece, 0
            while ord_ < entries and len(held) - at >= need:
                (sign, _, _, flags, method, _, _, crc, packed, size, n_name, n_extra, n_note, _, _, _, header_at) = \
                    struct.unpack_from(ENTRY_LAYOUT, held, at)
                whole = need + n_name + n_extra + n_note
                if sign != ENTRY_SIGNATURE:
                    entries = ord_
                    break
                if len(held) - at < whole:
                    break
                name = held[at + need:at + need + n_name]
                extra = held[at + need + n_name:at + need + n_name + n_extra]
                size, packed, header_at = _wide_fields(extra, size, packed, header_at)
                member = name.decode("utf-8" if flags & UTF8_FLAG else "cp437", "replace")
                rows.append((archive, ord_, member, size, member.endswith("/"), packed, header_at + first["shift"], method, crc,
                             bool(flags & ENCRYPTED_FLAG), None))
                at, ord_ = at + whole, ord_ + 1
            if len(rows) >= _LINES:
                yield _table(rows, MEMBERS_SCHEMA)
                rows = []
        if ord_ < first["entries"]:
            rows.append((archive, -1, None, None, None, None, None, None, None, None, "damaged directory"))
        if rows:
            yield _table(rows, MEMBERS_SCHEMA)


def _wide_fields(extra: bytes, *fields: int) -> list[int]:
    """Sizes and offset, those marked as too wide taken from the 64-bit extra field in their order."""
    at, wide = 0, b""
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, at)
        if kind == EXTRA_64:
            wide = extra[at + 4:at + 4 + n]
        at += 4 + n
    out = []
    for value in fields:
        if value == MARK_32 and len(wide) >= 8:
            value, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
        out.append(value)
    return out


def _table(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names = [field.split(" ")[0] for field in ddl.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [kinds[field.split(" ")[1]] for field in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def open_archives(spark: SparkSession, path: str, glob: str = "*.zip") -> Archives:
    """Every archive under ``path`` with its members.

    A file that is no archive, is empty, or whose directory cannot be read has a
    row with ``ord`` -1 and an ``error``; its other rows are the entries before
    the damage.
    """
    chunks = file_chunks(spark, path, glob)
    tails = _ordered(chunks.filter(F.col("at") + F.length("data") > F.col("file_size") - _TAIL),
                     chunks.select("archive", F.col("file_size").alias("_size")).distinct(),
                     F.greatest(F.col("_size") - _TAIL, F.lit(0)), F.col("_size"), ["archive"])
    ranges = _stored(tails.select("archive", "file_size", "data").mapInArrow(_find_directories, _RANGE_SCHEMA))
    good = ranges.filter("error is null and entries > 0").drop("error")
    first = _ordered(chunks, good, F.col("dir_at"), F.col("dir_at") + F.col("dir_size"), ["archive"])
    members = first.select("archive", "entries", "shift", "data").mapInArrow(
        _parse_directories, MEMBERS_SCHEMA)
    # Scans leave out files without a byte; the listing, which the driver holds anyway, has them.
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
              .load(path).inputFiles())
    files = spark.createDataFrame(pa.table({"archive": pa.array(listed, pa.string())})).select(_path(F.col("archive")).alias("archive"))
    lost = ranges.filter("error is not null").select("archive", "error").unionByName(
        files.join(ranges, "archive", "left_anti").select("archive", F.lit("empty file").alias("error")))
    lost = lost.select("archive", F.lit(-1).cast("long").alias("ord"), *[
        F.lit(None).cast(t).alias(c) for c, t in (f.split(" ") for f in MEMBERS_SCHEMA.split(", ")[2:-1])], "error")
    return Archives(chunks, _stored(members.unionByName(lost)))


def archive_inventory(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """``(archive, ord, member, size, is_dir)``; a damaged archive gives ord -1."""
    return open_archives(spark, path, glob).members.select("archive", "ord", "member", "size", "is_dir")


class _Payload:
    """Inflates one member as its bytes arrive: local header, data, checksum."""

    def __init__(self, row):
        self.row, self.header, self.left = row, b"", row["packed"]
        self.inflate = zlib.decompressobj(-15) if row["method"] == DEFLATED else None
        self.crc, self.size, self.started = 0, 0, False

    def feed(self, piece: bytes) -> bytes:
        if not self.started:
            self.header += piece
            need = struct.calcsize(LOCAL_LAYOUT)
            if len(self.header) < need:
                return b""
            sign, *_, n_name, n_extra = struct.unpack_from(LOCAL_LAYOUT, self.header)
            if sign != LOCAL_SIGNATURE:
                raise ValueError("no member at the recorded place")
            if len(self.header) < need + n_name + n_extra:
                return b""
            self.started, piece = True, self.header[need + n_name + n_extra:]
        piece = piece[:self.left]
        self.left -= len(piece)
        out = self.inflate.decompress(piece) if self.inflate else piece
        if self.inflate and not self.left:
            out += self.inflate.flush()
        self.crc, self.size = zlib.crc32(out, self.crc), self.size + len(out)
        return out

    def check(self):
        if self.left or not self.started or self.size != self.row["size"] or self.crc != self.row["crc"]:
            raise ValueError("damaged member")


def _decoded(line: bytes) -> str:
    """UTF-8, a line that is not as Latin-1."""
    try:
        return line.decode("utf-8")
    except UnicodeDecodeError:
        return line.decode("latin-1")


def _read_members(batches):
    for first, pieces in _streams(batches, 2):
        archive, member, n, rest, rows, error = first["archive"], first["member"], 0, b"", [], None
        payload = _Payload(first)
        try:
            if first["encrypted"] or first["method"] not in (STORED, DEFLATED):
                raise ValueError("encrypted member" if first["encrypted"] else f"compression method {first['method']}")
            for piece in pieces:
                # A compressed piece may hold a thousand times its size.
                for at in range(0, len(piece), 65536):
                    *lines, rest = (rest + payload.feed(piece[at:at + 65536])).split(b"\n")
                    for line in lines:
                        if not n and line.startswith(codecs.BOM_UTF8):
                            line = line[3:]
                        rows.append((archive, member, n, _decoded(line.rstrip(b"\r")), None))
                        n += 1
                    if len(rows) >= _LINES:
                        yield _table(rows, LINES_SCHEMA)
                        rows = []
            payload.check()
        except (ValueError, zlib.error) as problem:
            error = str(problem)
        if rest and not error:
            rows.append((archive, member, n, _decoded(rest.rstrip(b"\r")), None))
        if error:
            rows.append((archive, member, -1, None, error))
        if rows:
            yield _table(rows, LINES_SCHEMA)


def payload_lines(archives: Archives, classified: DataFrame) -> DataFrame:
    """``archive, member, line_no, value, error`` of each archive's chosen member.

    Lines end at LF or CR LF; a line that is not UTF-8 is read as Latin-1. A
    member that cannot be read to its end (damaged, encrypted, unknown
    compression, wrong checksum) has a row with ``line_no`` -1 and an ``error``.
    Of entries that share the name the last counts, as an archive's update does.
    """
    chosen = classified.filter(F.col("payload_member").isNotNull()).select("archive", F.col("payload_member").alias("member"))
    last = F.max_by(F.struct("packed", "header_at", "method", "crc", "size", "encrypted"), "ord").alias("e")
    places = archives.members.join(chosen, ["archive", "member"]).groupBy("archive", "member").agg(last).select(
        "archive", "member", "e.*")
    # Local names and extra fields are at most 65,535 bytes each.
    upto = F.col("header_at") + F.col("packed") + struct.calcsize(LOCAL_LAYOUT) + 2 * MARK_16
    data = _ordered(archives.chunks, places, F.col("header_at"), upto, ["archive", "member"])
    columns = ["archive", "member", "packed", "method", "crc", "size", "encrypted", "data"]
    return _stored(data.select(*columns).mapInArrow(_read_members, LINES_SCHEMA))
