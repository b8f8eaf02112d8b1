"""Tab-separated export readers.

The exports are read as plain text lines (``spark.read.text``), which splits
across files and within files, and are split on tabs in the JVM. Quoting is
off: quotes stay part of the text. A line with more fields than the header is
skipped, a shorter one is padded with nulls, and blank lines are skipped.
Only the header lines are read on the driver (three lines at most), to name
and type the columns; no schema is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geospan.functions.text import null_tokens, to_boolean, to_number
from geospan.sources.dictionary import LANGUAGE_ROW, column_types

# Geometry text column per header language, and the WKT column
# of the flat and "rows" exports.
WKT_COLUMN = {"fi": "WGS84 geometria", "en": "Footprint WKT", "tech": "footprintWKT"}
FLAT_WKT_COLUMN = "WGS84 WKT"
ROWS_WKT_COLUMN = "Gathering.Conversions.WGS84_WKT"

# Coordinate columns dropped from "rows" exports (the WKT
# column carries the geometry).
ROWS_EXCLUDED_COLUMNS = (
    "Gathering.Conversions.WGS84.LatMin(N)",
    "Gathering.Conversions.WGS84.LatMax(N)",
    "Gathering.Conversions.WGS84.LonMin(E)",
    "Gathering.Conversions.WGS84.LonMax(E)",
    "Gathering.Conversions.WGS84CenterPoint.Lat(N)",
    "Gathering.Conversions.WGS84CenterPoint.Lon(E)",
    "Gathering.Conversions.ETRS-TM35FINCenterPoint.Lat(N)",
    "Gathering.Conversions.ETRS-TM35FINCenterPoint.Lon(E)",
    "Gathering.Conversions.ETRS-TM35FIN.LatMin(N)",
    "Gathering.Conversions.ETRS-TM35FIN.LatMax(N)",
    "Gathering.Conversions.ETRS-TM35FIN.LonMin(E)",
    "Gathering.Conversions.ETRS-TM35FIN.LonMax(E)",
    "Gathering.Conversions.YKJ.LatMin(N)",
    "Gathering.Conversions.YKJ.LatMax(N)",
    "Gathering.Conversions.YKJ.LonMin(E)",
    "Gathering.Conversions.YKJ.LonMax(E)",
    "Gathering.Conversions.YKJ_10KM.Lat(N)",
    "Gathering.Conversions.YKJ_10KM.Lon(E)",
    "Gathering.Conversions.YKJ_1KM.Lat(N)",
    "Gathering.Conversions.YKJ_1KM.Lon(E)",
)


def dedupe_names(names: list[str]) -> list[str]:
    """Repeated header names get '.1', '.2', ... suffixes, in order."""
    seen: dict[str, int] = {}
    out = []
    taken = set(names)
    for n in names:
        if n in seen:
            k = seen[n]
            cand = f"{n}.{k}"
            while cand in taken:
                k += 1
                cand = f"{n}.{k}"
            seen[n] = k + 1
            taken.add(cand)
            out.append(cand)
        else:
            seen[n] = 1
            out.append(n)
    return out


def decode_text(value: Column) -> Column:
    """Keep valid UTF-8 lines; re-read other lines as Latin-1 (accepts every byte)."""
    raw = value.cast("binary")
    return F.when(F.is_valid_utf8(raw), F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))


def split_lines(lines: DataFrame, names: list[str], value_col: str = "value",
                keep: dict[str, str] | None = None) -> DataFrame:
    """Tab-split, drop blank and over-long lines, null-pad short ones.

    ``keep`` names further columns of ``lines`` to carry along, and their new names.
    """
    fields = F.split(F.col(value_col), "\t", -1)
    kept = lines.filter(F.col(value_col).rlike(r"\S") & (F.size(fields) <= len(names)))
    return kept.select(*[F.get(fields, i).alias(n) for i, n in enumerate(names)],
                       *[F.col(c).alias(n) for c, n in (keep or {}).items()])


def typed_column(raw: Column, dtype: str) -> Column:
    """The dictionary's dtype picks the conversion; unknown columns stay text."""
    if dtype == "bool":
        return to_boolean(raw)
    if dtype == "int":
        return to_number(raw)
    return null_tokens(raw)


def type_columns(df: DataFrame, types: dict[str, str], keep_raw: tuple[str, ...] = ()) -> DataFrame:
    """Apply :func:`typed_column` to every column (names as in ``df``) but those of ``keep_raw``."""
    return df.select(*[
        (F.col(f"`{c}`") if c in keep_raw else typed_column(F.col(f"`{c}`"), types.get(c, "object"))).alias(c)
        for c in df.columns
    ])


def _header_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    rows = spark.read.text(path).limit(n).collect()
    if len(rows) < n:
        raise ValueError(f"{path}: expected {n} header line(s), found {len(rows)}")
    return [r.value for r in rows]


def _body(spark: SparkSession, path: str, headers: list[str]) -> DataFrame:
    lines = spark.read.text(path)
    return lines.filter(~F.col("value").isin(*headers))


def read_occurrences(spark: SparkSession, path: str, lang: str = "tech",
                     types: dict[str, str] | None = None) -> DataFrame:
    """S01 + P01 + P02: occurrence export with tech / fi / en header lines."""
    if lang not in LANGUAGE_ROW:
        raise ValueError(f"lang must be one of {sorted(LANGUAGE_ROW)}, got {lang!r}")
    headers = _header_lines(spark, path, 3)
    names = dedupe_names(headers[LANGUAGE_ROW[lang]].split("\t"))
    types = column_types(lang) if types is None else types
    return occurrences_from_lines(_body(spark, path, headers), names, types)


def occurrences_from_lines(lines: DataFrame, names: list[str], types: dict[str, str]) -> DataFrame:
    return type_columns(split_lines(lines, names), types)


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """One header line, every column text."""
    headers = _header_lines(spark, path, 1)
    names = dedupe_names(headers[0].split("\t"))
    return type_columns(split_lines(_body(spark, path, headers), names), {})


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """S03 + P03: one header, all text, minus the excluded coordinate columns."""
    headers = _header_lines(spark, path, 1)
    names = dedupe_names(headers[0].split("\t"))
    df = split_lines(_body(spark, path, headers), names)
    return type_columns(df.drop(*ROWS_EXCLUDED_COLUMNS), {})
