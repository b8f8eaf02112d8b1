"""GeoJSON files of any size as features.

A collection is one JSON text, often on one line, so neither the JSON source
(one task for a file) nor lines divide it. Here a file is scanned as raw chunks
that end just after a ``}`` byte, by as many tasks as it has splits:

1. each chunk measures itself for both cases, that it starts outside a string
   or within one: parity of its quotes, change of the bracket depth;
2. sums over these few numbers, in file order, give each chunk its real state;
3. each chunk cuts out the objects that open at depth 2, which are the features
   of the collection (and the properties of its ``crs`` member). The pieces of
   an object that spans chunks are put together by its number within the file.

The features are written once as JSON lines, with the file they come from, and
read by Spark's JSON source, which infers the types of the properties unless
they are given. Text that is not UTF-8 is taken as Latin-1, feature by feature.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geospan.session import checkpoint_dir
from geospan.sources.archives import file_chunks

DAMAGED_MESSAGE = "not a whole JSON text"
OPEN, MIDDLE, CLOSE, WHOLE = "open", "middle", "close", "whole"
_FEATURE_DEPTH = 2
_MEASURE_SCHEMA = "archive string, file_size long, at long, quotes int, outside long, inside long"
_PIECE_SCHEMA = "archive string, at long, kind string, data binary"


def _brackets(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Positions of brackets, their bytes, whether an even number of quotes stands before each, and the number of quotes."""
    text = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(text == ord('"'))
    if quotes.size and b"\\" in data:
        plain = np.maximum.accumulate(np.where(text == ord("\\"), -1, np.arange(text.size)))
        before = np.maximum(quotes - 1, 0)
        run = np.where(quotes > 0, before - plain[before], 0)  # backslashes just before the quote
        quotes = quotes[run % 2 == 0]
    marks = np.flatnonzero(np.isin(text, np.frombuffer(b"{}[]", np.uint8)))
    even = np.searchsorted(quotes, marks) % 2 == 0
    return marks, text[marks], even, quotes.size


def _steps(marks: np.ndarray) -> np.ndarray:
    return np.where((marks == ord("{")) | (marks == ord("[")), 1, -1)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for data in batch.column("data"):
            _, kinds, even, n = _brackets(data.as_py())
            step = _steps(kinds)
            rows.append((n % 2, int(step[even].sum()), int(step[~even].sum())))
        quotes, outside, inside = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("archive", "file_size", "at")]
            + [pa.array(quotes, pa.int32()), pa.array(outside, pa.int64()), pa.array(inside, pa.int64())],
            ["archive", "file_size", "at", "quotes", "outside", "inside"])


def _single(data: bytes) -> bytes | None:
    """A whole text that is no collection: a feature, or a geometry made one."""
    try:
        root = json.loads(data.decode("utf-8-sig", "replace"))
    except ValueError:
        return None
    if not isinstance(root, dict) or root.get("type") == "FeatureCollection":
        return None
    if root.get("type") == "Feature":
        return json.dumps(root).encode()
    if "coordinates" in root or "geometries" in root:
        return json.dumps({"type": "Feature", "properties": None, "geometry": root}).encode()
    return None


def _pieces(data: bytes, in_string: bool, depth: int) -> list[tuple[str, bytes]]:
    at, kinds, even, _ = _brackets(data)
    real = ~even if in_string else even
    at, kinds = at[real], kinds[real]
    step = _steps(kinds)
    after = depth + np.cumsum(step)
    opens = at[(kinds == ord("{")) & (after - step == _FEATURE_DEPTH)]
    closes = at[(kinds == ord("}")) & (after == _FEATURE_DEPTH)]
    out = []
    if depth > _FEATURE_DEPTH:
        if closes.size and (not opens.size or closes[0] < opens[0]):
            out.append((CLOSE, data[:closes[0] + 1]))
            closes = closes[1:]
        elif not closes.size and not opens.size:
            out.append((MIDDLE, data))
    out += [(WHOLE, data[a:b + 1]) for a, b in zip(opens, closes)]
    if opens.size > closes.size:
        out.append((OPEN, data[opens[-1]:]))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, size, start, data, in_string, depth in zip(*(batch.column(c).to_pylist() for c in (
                "archive", "file_size", "at", "data", "in_string", "depth"))):
            alone = _single(data) if len(data) == size and b'"features"' not in data else None
            found = [(WHOLE, alone)] if alone else _pieces(data, in_string, depth)
            kinds, texts = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array([archive] * len(found), pa.string()), pa.array([start] * len(found), pa.int64()),
                 pa.array(kinds, pa.string()), pa.array(texts, pa.binary())], ["archive", "at", "kind", "data"])


def _assembled(pieces: DataFrame) -> DataFrame:
    """Objects of several chunks: an opening piece and what follows it up to the first closing one."""
    parts = pieces.filter(F.col("kind") != WHOLE)
    # A chunk's closing piece belongs to an object that an earlier chunk opened, so it counts before its opening one.
    order = F.struct("at", (F.col("kind") == OPEN).alias("opens"))
    keys = parts.select("archive", "at", "kind", F.sum((F.col("kind") == OPEN).cast("long")).over(
        Window.partitionBy("archive").orderBy(order)).alias("number"))
    rows = parts.join(keys, ["archive", "at", "kind"]).filter("number > 0").groupBy("archive", "number").agg(
        F.array_sort(F.collect_list(F.struct("at", "kind", "data"))).alias("p"))
    end = F.array_position(F.transform("p", lambda x: x["kind"]), CLOSE).cast("int")
    used = F.slice("p", F.lit(1), end)
    data = F.aggregate(used, F.lit(b""), lambda acc, x: F.concat(acc, x["data"]))
    return rows.filter(end > 0).select("archive", data.alias("data"))


def split_features(spark: SparkSession, path: str, glob: str = "*.*json") -> tuple[str, DataFrame]:
    """The folder of JSON lines ``path, feature`` of all files, and one row per file: ``path, crs, error``.

    A file whose brackets or quotes do not balance has an error and no
    features. A file that is one feature or one geometry, of up to one chunk
    (4 MB), is one feature.
    """
    chunks = file_chunks(spark, path, glob, sep="}")
    measures = chunks.mapInArrow(_measure, _MEASURE_SCHEMA)
    up_to = Window.partitionBy("archive").orderBy("at")
    earlier = up_to.rowsBetween(Window.unboundedPreceding, -1)
    states = (measures.withColumn("in_string", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
              .withColumn("delta", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
              .withColumn("depth", F.coalesce(F.sum("delta").over(earlier), F.lit(0))))
    scratch = f"{checkpoint_dir(spark).rstrip('/')}/geojson-{uuid.uuid4().hex}"
    states.select("archive", "at", "in_string", "depth", "delta", "quotes").write.parquet(f"{scratch}/states")
    states = spark.read.parquet(f"{scratch}/states")
    pieces = chunks.join(states.select("archive", "at", "in_string", "depth"), ["archive", "at"]).mapInArrow(_cut, _PIECE_SCHEMA)
    pieces.write.parquet(f"{scratch}/pieces")
    pieces = spark.read.parquet(f"{scratch}/pieces")
    balanced = (F.sum("delta") == 0) & (F.sum("quotes") % 2 == 0) & (F.min(F.col("depth")) >= 0)
    whole = states.groupBy("archive").agg(balanced.alias("balanced"))
    objects = pieces.filter(F.col("kind") == WHOLE).select("archive", "data").unionByName(_assembled(pieces))
    text = F.when(F.is_valid_utf8(F.col("data")), F.col("data").cast("string")).otherwise(F.decode("data", "ISO-8859-1"))
    objects = objects.select("archive", text.alias("text")).join(whole.filter("balanced").select("archive"), "archive")
    is_feature = F.contains("text", F.lit('"Feature"'))
    head = F.to_json(F.struct(F.col("archive").alias("path")))
    line = F.concat(F.expr("left(h, length(h) - 1)"), F.lit(',"feature":'), F.translate("text", "\r\n", "  "), F.lit("}"))
    objects.filter(is_feature).withColumn("h", head).select(line.alias("value")).write.text(f"{scratch}/features")
    names = (objects.filter(~is_feature).select("archive", F.get_json_object("text", "$.name").alias("crs"))
             .filter(F.regexp_like("crs", F.lit("(?i)EPSG|CRS"))).groupBy("archive").agg(F.max("crs").alias("crs")))
    files = whole.join(names, "archive", "left").select(
        F.col("archive").alias("path"), "crs", F.when(~F.col("balanced"), F.lit(DAMAGED_MESSAGE)).alias("error"))
    return f"{scratch}/features", files


_POSITION = r"\[\s*(-?[0-9.]+(?:[eE][+-]?[0-9]+)?)\s*,\s*(-?[0-9.]+(?:[eE][+-]?[0-9]+)?)(?:\s*,\s*-?[0-9.eE+-]+)*\s*\]"
_MEMBERS = "array<struct<type:string,coordinates:string,geometries:string>>"


def geojson_wkt(gtype: Column, coords: Column, geometries: Column | None = None, depth: int = 2) -> Column:
    """GeoJSON geometry (type, coordinates as JSON text, members of a collection as JSON text) -> WKT.

    Positions keep two numbers; ``[]`` is EMPTY; an unknown type is null.
    Collections within collections are written to ``depth`` levels, deeper ones as EMPTY.
    """
    up = F.upper(gtype)
    tight = F.regexp_replace(F.regexp_replace(coords, _POSITION, "$1 $2"), r"\s*([\[\],])\s*", "$1")
    body = F.translate(F.replace(tight, F.lit(","), F.lit(", ")), "[]", "()")
    point = F.concat(F.lit("POINT ("), body, F.lit(")"))
    plain = (F.when(coords.isNull() | F.regexp_like(coords, F.lit(r"^[\[\]\s]*$")), F.concat(up, F.lit(" EMPTY")))
             .when(up == "POINT", point).otherwise(F.concat(up, F.lit(" "), body)))
    known = F.when(up.isin("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON"), plain)
    if geometries is None:
        return known
    if depth == 0:
        inner = F.lit("GEOMETRYCOLLECTION EMPTY")
    else:
        members = F.transform(F.from_json(geometries, _MEMBERS), lambda m: geojson_wkt(
            m["type"], m["coordinates"], m["geometries"], depth - 1))
        inner = F.when(F.size(members) > 0, F.concat(F.lit("GEOMETRYCOLLECTION ("), F.array_join(members, ", "), F.lit(")"))
                       ).otherwise(F.lit("GEOMETRYCOLLECTION EMPTY"))
    return F.when(up == "GEOMETRYCOLLECTION", inner).otherwise(known)


def srid_from_name(srs: Column) -> Column:
    """'EPSG:3067', 'urn:ogc:def:crs:EPSG::3067', '.../EPSG/0/3067' -> 3067; CRS84 (longitude, latitude) -> 4326."""
    return (F.when(F.regexp_like(srs, F.lit(r"(?i)[:/]CRS84\s*$")), F.lit(4326))
            .otherwise(F.regexp_extract(srs, r"(?i)EPSG[:/A-Z0-9.]*?[:/](\d+)\s*$", 1).try_cast("int")))


def read_geojson(spark: SparkSession, path: str, srid: int = 4326, properties: str | None = None,
                 glob: str = "*.*json", issues: list | None = None) -> DataFrame:
    """One row per feature: its properties, ``wkt`` and ``srid``.

    ``properties`` is their schema as DDL; without it their types are inferred
    in one pass over the features. The CRS is the file's own ``crs`` member, or
    ``srid``; a member that names no EPSG code gives a null. A property named
    ``wkt`` or ``srid`` becomes ``wkt_property`` or ``srid_property``. Files
    that are damaged have no rows: their ``(path, error)`` are added to
    ``issues``; without such a list they are an error.
    """
    lines, files = split_features(spark, path, glob)
    broken = [(r.path, r.error) for r in files.filter("error is not null").select("path", "error").collect()]
    if issues is not None:
        issues += broken
    elif broken:
        raise RuntimeError(f"Damaged files: {', '.join(p for p, _ in broken)}")
    if properties is None:
        inferred = {f.name: f.dataType for f in spark.read.json(lines).schema.fields}
        feature = inferred.get("feature")
        found = {f.name: f.dataType for f in feature.fields} if isinstance(feature, T.StructType) else {}
        props = found.get("properties")
        props = props if isinstance(props, T.StructType) else T.StructType([])
    else:
        props = T.StructType.fromDDL(properties)
    geometry = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "coordinates", "geometries")])
    fields = [T.StructField("geometry", geometry)] + ([T.StructField("properties", props)] if props.fields else [])
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("feature", T.StructType(fields))])
    feats = spark.read.schema(schema).json(lines)
    own = files.select("path", F.col("crs").alias("_crs"))
    g = F.col("feature.geometry")
    kept = [F.col(f"feature.properties.`{f.name}`").alias(f"{f.name}_property" if f.name in ("wkt", "srid") else f.name)
            for f in props.fields]
    return feats.join(own, "path", "left").select(
        *kept, geojson_wkt(g["type"], g["coordinates"], g["geometries"]).alias("wkt"),
        F.when(F.col("_crs").isNull(), F.lit(srid)).otherwise(srid_from_name(F.col("_crs"))).alias("srid"))
