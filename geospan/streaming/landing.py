"""O05 + S01: exports that land in a folder, each converted as its own request says.

A stream of file names (the contents are not read by it) is joined with a table
of requests; each micro-batch reads its files once per kind of output, takes the
header of every file from its own first lines and writes one layer for each
different header. A replayed batch overwrites what it wrote.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from geospan.plans.convert import archive_layers
from geospan.sinks.layers import layer_columns

REQUEST_SCHEMA = "file string, kind string, lang string, geometry_type string, crs string"
OUTCOME_SCHEMA = "path string, rows long, good long, error string"
NO_REQUEST_MESSAGE = "no request names this file"
NO_LAYER_MESSAGE = "the file has no header or no geometry column"
_FILES_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
_BEYOND = 1 << 40


def _plain(uri: Column) -> Column:
    """A file's name as it is spelt on disk: metadata escapes it, and local files have one slash or three."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "file:///")


def export_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``archive, line_no, value`` of text files, where ``line_no`` counts the lines of a file's first block.

    Rows of a block are numbered in order within their task, so the number of a
    line less that of the file's first one tells header lines from others; a
    line of a later block has a number beyond any header.
    """
    exact = [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in paths]  # names, not patterns
    lines = spark.read.text(exact).select(
        _plain(F.col("_metadata.file_path")).alias("archive"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"), "value")
    first = lines.filter("block = 0").groupBy("archive").agg(F.min("n").alias("first"))
    number = F.when(F.col("block") == 0, F.col("n") - F.col("first")).otherwise(F.lit(_BEYOND))
    return lines.join(first, "archive").select("archive", number.alias("line_no"), "value")


def convert_files(spark: SparkSession, files: DataFrame, out_dir: str) -> DataFrame:
    """``files`` (``path`` and the columns of a request) -> layers under ``out_dir``, and one outcome per file.

    One read for each different language, geometry type and CRS; exports of
    several kinds and headers may share it.
    """
    kinds = ["lang", "geometry_type", "crs"]
    known = files.filter("kind is not null")
    groups: dict[tuple, list[tuple[str, str]]] = {}
    for r in known.select("path", "kind", *kinds).collect():
        groups.setdefault(tuple(r[k] for k in kinds), []).append((r["path"], r["kind"]))
    done = spark.createDataFrame([], "path string, rows long, good long")
    for n, (key, members) in enumerate(sorted(groups.items())):
        lines = export_lines(spark, [p for p, _ in members]).join(
            spark.createDataFrame(members, "archive string, payload_kind string"), "archive")
        for k, layer in enumerate(archive_layers(lines, *key)):
            target = f"{out_dir}/request={n}/layer={k}"
            out = layer_columns(layer).withColumn("status", F.when(F.col("reject_reason").isNull(), "ok").otherwise("rejected"))
            out.write.mode("overwrite").partitionBy("status").parquet(target)
            done = done.unionByName(spark.read.schema(out.schema).parquet(target).groupBy(F.col("_archive").alias("path")).agg(
                F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "ok").alias("good")))
    error = (F.when(F.col("kind").isNull(), F.lit(NO_REQUEST_MESSAGE)).when(F.col("rows").isNull(), F.lit(NO_LAYER_MESSAGE)))
    return files.join(done, "path", "left").select("path", F.coalesce("rows", F.lit(0)).alias("rows"),
                                                   F.coalesce("good", F.lit(0)).alias("good"), error.alias("error"))


def convert_requests(spark: SparkSession, landing_dir: str, requests_path: str, out_dir: str, checkpoint: str,
                     files_per_batch: int = 100, available_now: bool = True) -> StreamingQuery:
    """Converts each newly landed file as the table at ``requests_path`` (``REQUEST_SCHEMA``, Parquet) says.

    ``file`` is the file's name without folders; of several requests for one
    name the first in the order of their columns counts. Requests are read anew
    for each batch, so a request must be there before its file. Layers go to
    ``out_dir/layers/batch=<n>``, one outcome row per file to
    ``out_dir/outcomes/batch=<n>``; a file without a request has an error there.
    """
    files = (spark.readStream.format("binaryFile").schema(_FILES_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
             .load(landing_dir).select(_plain(F.col("_metadata.file_path")).alias("path")))

    def convert(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        wanted = session.read.schema(REQUEST_SCHEMA).parquet(requests_path)
        one = wanted.groupBy("file").agg(F.min(F.struct("kind", "lang", "geometry_type", "crs")).alias("r")).select("file", "r.*")
        # A batch may name a file more than once.
        named = batch.distinct().withColumn("file", F.substring_index("path", "/", -1))
        outcome = convert_files(session, named.join(one, "file", "left"), f"{out_dir}/layers/batch={number}")
        outcome.write.mode("overwrite").parquet(f"{out_dir}/outcomes/batch={number}")

    stream = files.writeStream.foreachBatch(convert).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()
