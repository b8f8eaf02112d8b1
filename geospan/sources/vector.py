"""Vector layer files as tables (S11-S13, S15): each reader gives attributes, ``wkt`` and ``srid``.

The geometry is WKT text with its own SRID, ready for
:func:`geospan.operators.union.to_table`.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geospan.sources.geojson import geojson_wkt, read_geojson, srid_from_name
from geospan.sources.markup import read_gml, read_kml

__all__ = ["file_encoding", "geojson_wkt", "read_geojson", "read_gml", "read_kml", "read_layers", "read_vector", "srid_from_name"]

READERS = {"geojson": read_geojson, "json": read_geojson, "kml": read_kml, "gml": read_gml, "parquet": None}


def file_encoding(spark: SparkSession, path: str) -> str:
    """S14: 'UTF-8' when every file under ``path`` is valid UTF-8, else
    'ISO-8859-1' (which accepts every byte, so no later fallback is needed).

    The bytes are checked in the executors; only one boolean per file comes
    back to the driver.
    """
    files = spark.read.format("binaryFile").load(path)
    bad = files.filter(~F.is_valid_utf8(F.col("content"))).select("path").limit(1).collect()
    return "ISO-8859-1" if bad else "UTF-8"


def read_vector(spark: SparkSession, sources: list[str | tuple[str, dict]]) -> list[DataFrame]:
    """S15 + U02: the layers of ``sources``, each a path or ``(path, options)``.

    The reader goes by the extension, or by the option ``format``; the other
    options are the reader's. A source that cannot be read, and a damaged file
    within one, is logged and left out; if none is left that is an error. A
    source without features adds no rows to a union.
    """
    layers = []
    for source in sources:
        path, options = (source, {}) if isinstance(source, str) else (source[0], dict(source[1]))
        kind = options.pop("format", path.rstrip("/").rsplit(".", 1)[-1].lower())
        try:
            if kind not in READERS:
                raise ValueError(f"unknown vector format {kind!r}")
            if kind == "parquet":
                layers.append(spark.read.parquet(path))
            elif READERS[kind] is read_geojson:
                issues: list = []
                layer = read_geojson(spark, path, issues=issues, **options)
                for file, error in issues:
                    logging.warning("Failed to read %r: %s", file, error)
                layers.append(layer)
            else:
                layers.append(READERS[kind](spark, path, **options))
        except Exception as exc:  # one broken source must not stop the others
            logging.warning("Failed to read layer %r: %s", path, exc)
    if not layers:
        raise RuntimeError("None of the layers could be read")
    return layers


def read_layers(paths: dict[str, DataFrame]) -> list[DataFrame]:
    """Keep the non-empty layers, tagging each row with its layer name."""
    return [df.withColumn("layer", F.lit(name)) for name, df in paths.items() if not df.isEmpty()]
