"""Archive member tables: payload classification (S09) and sidecar check.

Both work on a member inventory ``(archive, ord, member)`` — one row per
archive entry, ``ord`` its position — as produced by
:func:`geospan.sources.archives.archive_inventory`. They are grouped
aggregates and an anti-join, so an archive with millions of members is
combined map-side first and never gathered into one task whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Payload names and the shapefile sidecar extensions.
OCCURRENCES_MEMBER = "occurrences.txt"
ROWS_PREFIX = "rows_"
SIDECAR_EXTENSIONS = (".shx", ".dbf")


def basename(member):
    return F.regexp_extract(member, r"([^/]*)$", 1)


def classify_archives(members: DataFrame) -> DataFrame:
    """Per archive, 'occurrences' when a member is exactly occurrences.txt,
    else 'rows' with the first (by ``ord``) member whose base name starts with
    rows_, else 'rejected'."""
    is_rows = basename(F.col("member")).startswith(ROWS_PREFIX)
    agg = members.groupBy("archive").agg(
        F.max((F.col("member") == OCCURRENCES_MEMBER).cast("int")).alias("_occ"),
        F.min_by(F.col("member"), F.when(is_rows, F.col("ord"))).alias("_rows_member"),
        F.min(F.when(is_rows, F.col("ord"))).alias("_rows_ord"),
    )
    kind = (F.when(F.col("_occ") == 1, F.lit("occurrences"))
            .when(F.col("_rows_ord").isNotNull(), F.lit("rows"))
            .otherwise(F.lit("rejected")))
    payload = (F.when(F.col("_occ") == 1, F.lit(OCCURRENCES_MEMBER))
               .when(F.col("_rows_ord").isNotNull(), F.col("_rows_member")))
    return agg.select("archive", kind.alias("payload_kind"), payload.alias("payload_member"))


def missing_sidecars(members: DataFrame) -> DataFrame:
    """Each .shp needs .shx and .dbf with the same stem (case-folded).

    One row per shapefile that lacks a sidecar: ``(archive, shapefile,
    missing)`` with the missing names sorted and comma separated. Archives
    without shapefiles produce nothing. Directory entries are ignored.
    """
    files = (members.filter(~F.col("member").endswith("/"))
             .select("archive", F.lower(F.col("member")).alias("name"))
             .distinct())
    shp = files.filter(F.col("name").endswith(".shp"))
    needed = shp.select(
        "archive", F.col("name").alias("shp"),
        F.explode(F.array(*[F.concat(F.expr("substring(name, 1, length(name) - 4)"), F.lit(e))
                            for e in SIDECAR_EXTENSIONS])).alias("need"))
    lacking = needed.join(files.withColumnRenamed("name", "need"), ["archive", "need"], "left_anti")
    return (lacking.groupBy("archive", "shp")
            .agg(F.array_join(F.array_sort(F.collect_list(basename(F.col("need")))), ", ").alias("missing"))
            .select("archive", basename(F.col("shp")).alias("shapefile"), "missing"))


def sidecar_message(missing: DataFrame) -> DataFrame:
    """Per archive, the user-facing error text (one line listing every shapefile)."""
    return (missing.groupBy("archive")
            .agg(F.array_join(F.array_sort(F.collect_list(
                F.concat(F.lit("'"), F.col("shapefile"), F.lit("' missing "), F.col("missing")))), ", ")
                .alias("_m"))
            .select("archive", F.concat(F.lit("Incomplete shapefile, files are missing: "), F.col("_m"))
                    .alias("message")))
