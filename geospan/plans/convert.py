"""The conversion jobs end to end (the service's two user jobs, as batch jobs).

``convert_export``: an occurrence export (multi-header, flat or "rows" TSV)
-> geometry layer in the requested CRS and geometry type, written with its
quarantine, with status updates appended to the conversion log.

``convert_archives``: a folder of ZIP exports -> one layer for each set of header
lines, with the outcome of every archive.

``convert_layers``, ``convert_vector``: vector layers, or their files -> one CSV table with ``footprintWKT``.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from geospan.operators.archives import classify_archives
from geospan.operators.convlog import COMPLETE, FAILED, PROCESSING, conversion_key, latest_status
from geospan.operators.layer import check_params, to_layer
from geospan.operators.union import table_problem, to_table
from geospan.sinks.layers import NO_GEOMETRY_MESSAGE, NoGeometry, publish, write_layer, write_table_csv
from geospan.sources.archives import open_archives, payload_lines
from geospan.sources.dictionary import LANGUAGE_ROW, column_types
from geospan.sources.tsv import (FLAT_WKT_COLUMN, ROWS_EXCLUDED_COLUMNS, ROWS_WKT_COLUMN, WKT_COLUMN, dedupe_names,
                                 read_flat, read_occurrences, read_rows, split_lines, type_columns)
from geospan.sources.vector import read_vector
from geospan.streaming.convlog import LOG_SCHEMA

NO_PAYLOAD_MESSAGE = "The archive has neither an occurrence file nor a rows file."


def _log(spark: SparkSession, log_dir: str | None, cid: str, status: str, **fields) -> None:
    if not log_dir:
        return
    now = dt.datetime.now(dt.timezone.utc)
    row = {"conversion_id": cid, "event_id": int(now.timestamp() * 1e6),
           "ts": now, "status": status, "progress_percent": fields.get("progress_percent"),
           "output": fields.get("output"), "error": fields.get("error")}
    spark.createDataFrame([row], LOG_SCHEMA).write.mode("append").parquet(log_dir)


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _create(fs, where) -> bool:
    """Creates an empty file unless it exists, in one step of the file system."""
    try:
        if fs.getUri().getScheme() == "file":
            os.close(os.open(where.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        else:
            fs.create(where, False).close()
    except FileExistsError:
        return False
    except Exception:
        if fs.exists(where):
            return False
        raise
    return True


def claim(spark: SparkSession, path: str, hours: float = 24) -> bool:
    """Whether this run, and no other, now holds the claim file ``path``.

    The file is created only if it is absent (on local disks by exclusive open;
    elsewhere by Hadoop's ``create`` without overwriting, which is atomic on HDFS
    and on stores with conditional writes). A claim older than ``hours`` belongs
    to a run that died. Who may clear it away is settled in the same manner, by a
    file named after its time, which stays, so that nobody who saw the dead claim
    late can clear a new one.
    """
    where, fs = _file(spark, path)
    fs.mkdirs(where.getParent())
    if _create(fs, where):
        return True
    try:
        made = fs.getFileStatus(where).getModificationTime()
    except Exception:
        if fs.exists(where):
            raise
        return _create(fs, where)  # just released
    if dt.datetime.now().timestamp() - made / 1000 < hours * 3600:
        return False
    taken = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".taken-{where.getName()}-{made}")
    if not _create(fs, taken):
        return False
    fs.delete(where, False)
    return _create(fs, where)


def release(spark: SparkSession, path: str) -> None:
    where, fs = _file(spark, path)
    fs.delete(where, False)


def _known(spark: SparkSession, log_dir: str, cid: str, hours: float) -> bool:
    """Done already, or in work by a run whose last word is younger than ``hours``."""
    where, fs = _file(spark, log_dir)
    if not fs.exists(where):
        return False
    state = latest_status(spark.read.schema(LOG_SCHEMA).parquet(log_dir)).filter(F.col("conversion_id") == cid)
    young = F.col("updated_at") > F.lit(dt.datetime.now(dt.timezone.utc) - dt.timedelta(hours=hours))
    return not state.filter((F.col("status") == COMPLETE) | ((F.col("status") == PROCESSING) & young)).isEmpty()


def read_export(spark: SparkSession, path: str, kind: str, lang: str) -> tuple[DataFrame, str]:
    """The reader and WKT column for an export kind."""
    if kind == "occurrences":
        return read_occurrences(spark, path, lang), WKT_COLUMN[lang]
    if kind == "flat":
        return read_flat(spark, path), FLAT_WKT_COLUMN
    if kind == "rows":
        return read_rows(spark, path), ROWS_WKT_COLUMN
    raise ValueError(f"unknown export kind {kind!r}")


def convert_export(spark: SparkSession, path: str, out_dir: str, kind: str = "occurrences", lang: str = "tech",
                   geometry_type: str = "footprint", crs: str = "wgs84", filename: str = "export",
                   log_dir: str | None = None, skip_if_known: bool = True, claim_hours: float = 24) -> dict:
    """One export -> a layer, once: with a log, a conversion that is done or in work is skipped.

    A run first claims its conversion id (a file in ``<log_dir>-claims``), then looks
    at the log, so of concurrent runs of one id exactly one converts.
    """
    check_params(geometry_type, crs)
    cid = spark.range(1).select(conversion_key(F.lit(filename), F.lit(lang), F.lit(geometry_type),
                                               F.lit(crs))).first()[0]
    held = None
    if skip_if_known and log_dir:
        name = hashlib.sha256(cid.encode()).hexdigest()
        held = f"{log_dir.rstrip('/')}-claims/{name}"
        if not claim(spark, held, claim_hours):
            return {"conversion_id": cid, "skipped": True}
    try:
        if held and _known(spark, log_dir, cid, claim_hours):
            return {"conversion_id": cid, "skipped": True}
        _log(spark, log_dir, cid, PROCESSING, progress_percent=0)
        try:
            df, wkt_col = read_export(spark, path, kind, lang)
            stats = write_layer(to_layer(df, wkt_col, geometry_type, crs), out_dir)
        except Exception as exc:
            _log(spark, log_dir, cid, FAILED, error=str(exc))
            raise
        _log(spark, log_dir, cid, COMPLETE, progress_percent=100, output=out_dir)
    finally:
        if held:
            release(spark, held)
    return {"conversion_id": cid, **stats}


def _header(lines: DataFrame) -> DataFrame:
    """``archive, payload_kind, header``: the first three lines of an occurrence file, the first of a rows or flat file."""
    n = F.when(F.col("payload_kind") == "occurrences", 3).otherwise(1)
    return (lines.filter((F.col("line_no") >= 0) & (F.col("line_no") < n)).groupBy("archive", "payload_kind")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]).alias("header")))


def archive_layers(lines: DataFrame, lang: str = "tech", geometry_type: str = "footprint", crs: str = "wgs84") -> list[DataFrame]:
    """One layer (with an ``archive`` column) for each different header among ``lines``.

    ``lines``: ``archive, payload_kind, line_no, value``. Columns are named and
    typed by each archive's own header, so that archives may differ in columns or
    in their order; only the distinct headers reach the driver, which plans one
    job for each. An occurrence file of fewer than three lines has no layer.
    """
    headers = _header(lines)
    kinds = sorted(headers.select("payload_kind", "header").distinct().collect(), key=lambda r: (r.payload_kind, r.header))
    out = []
    for kind, header in kinds:
        if kind == "occurrences" and len(header) < 3:
            continue
        wanted = headers.filter((F.col("payload_kind") == kind) & (F.col("header") == F.array(*map(F.lit, header)))).select("archive")
        body = lines.filter((F.col("payload_kind") == kind) & (F.col("line_no") >= len(header))).join(wanted, "archive", "left_semi")
        names = dedupe_names(header[LANGUAGE_ROW[lang] if kind == "occurrences" else 0].split("\t"))
        hidden = "_archive" if "archive" in names else "archive"
        fields = split_lines(body.withColumnRenamed("archive", "_in"), names, keep={"_in": hidden})
        if kind == "occurrences":
            df, wkt = type_columns(fields, column_types(lang), keep_raw=(hidden,)), WKT_COLUMN[lang]
        elif kind == "flat":
            df, wkt = type_columns(fields, {}, keep_raw=(hidden,)), FLAT_WKT_COLUMN
        else:
            df, wkt = type_columns(fields.drop(*ROWS_EXCLUDED_COLUMNS), {}, keep_raw=(hidden,)), ROWS_WKT_COLUMN
        if wkt in names:
            out.append(to_layer(df, wkt, geometry_type, crs).withColumnRenamed(hidden, "_archive"))
    return out


def convert_archives(spark: SparkSession, path: str, out_dir: str, lang: str = "tech", geometry_type: str = "footprint",
                     crs: str = "wgs84", glob: str = "*.zip") -> DataFrame:
    """The ZIP job: every archive under ``path`` -> layers under ``out_dir`` (``layer=<n>/status=ok|rejected``).

    Returns one row per archive: ``archive, payload_kind, rows, good, error``. An
    archive without a payload, a damaged one and one without a usable geometry
    have an error and no good rows in the layers; the others are not held up.
    """
    check_params(geometry_type, crs)
    archives = open_archives(spark, path, glob)
    kinds = classify_archives(archives.members)
    read = payload_lines(archives, kinds)
    broken = archives.members.filter("error is not null").select("archive", "error").unionByName(
        read.filter("error is not null").select("archive", "error")).groupBy("archive").agg(F.min("error").alias("error"))
    good = read.filter("error is null").join(broken, "archive", "left_anti").join(
        kinds.select("archive", "payload_kind"), "archive").select("archive", "payload_kind", "line_no", "value")
    counts = None
    for n, layer in enumerate(archive_layers(good, lang, geometry_type, crs)):
        try:
            write_layer(layer, f"{out_dir}/layer={n}")
        except NoGeometry:
            pass
        else:
            done = spark.read.parquet(f"{out_dir}/layer={n}").groupBy(F.col("_archive").alias("archive")).agg(
                F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "ok").alias("good"))
            counts = done if counts is None else counts.unionByName(done)
    if counts is None:
        counts = spark.createDataFrame([], "archive string, rows long, good long")
    error = (F.when(F.col("error").isNotNull(), F.col("error"))
             .when(F.col("payload_kind") == "rejected", F.lit(NO_PAYLOAD_MESSAGE))
             .when(F.coalesce("good", F.lit(0)) == 0, F.lit(NO_GEOMETRY_MESSAGE)))
    return (kinds.join(broken, "archive", "full").join(counts, "archive", "left")
            .select("archive", "payload_kind", F.coalesce("rows", F.lit(0)).alias("rows"),
                    F.coalesce("good", F.lit(0)).alias("good"), error.alias("error")))


def convert_layers(layers: list[DataFrame], csv_path: str) -> dict:
    """The GIS-to-table job: union, WGS84, simplify, WKT last, CSV; returns ``rows`` and ``unparsable`` (written with no WKT).

    One scan: rows and CRS problems are counted during the write, beside
    ``csv_path``; it is published only if there are rows and each has a CRS that
    can be converted, so a failed job leaves an earlier table as it was.
    """
    counts = Observation("table_write")
    issue = F.col("geometry_issue")
    table = to_table(layers).observe(
        counts, F.count(F.lit(1)).alias("rows"),
        *[F.count_if(issue == kind).alias(kind) for kind in ("missing_crs", "unsupported_crs", "unparsable")])
    staging = f"{csv_path.rstrip('/')}-staging-{uuid.uuid4().hex}"
    write_table_csv(table.drop("geometry_issue"), staging)
    seen = counts.get
    message = table_problem(seen)
    publish(table.sparkSession, staging, None if message else csv_path)
    if message:
        raise RuntimeError(message)
    return {"rows": seen["rows"], "unparsable": seen["unparsable"], "path": csv_path}


def convert_vector(spark: SparkSession, sources: list[str | tuple[str, dict]], csv_path: str) -> dict:
    """The path job: vector files (``read_vector``) -> one CSV table; broken sources are logged and left out."""
    return convert_layers(read_vector(spark, sources), csv_path)
