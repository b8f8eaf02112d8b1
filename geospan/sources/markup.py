"""KML placemarks (S12) and GML feature members.

The text source ends a record at each closing tag of the row element, so one
file is read by as many tasks as it has splits, once; what stands before the
opening tag is left out and ``from_xml`` parses the element with an explicit
nested schema. Geometries are put together from that structure (rings, holes,
members), never from text patterns. A record that is not UTF-8 is taken as
Latin-1. The row element must not be nested in itself, and its tags must not
stand in a comment or a CDATA section. An element that is not well formed is a
row of nulls.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geospan.functions.wkt import let
from geospan.session import checkpoint_dir
from geospan.sources.geojson import srid_from_name

_OPTIONS = {"ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_VALUE", "ignoreSurroundingSpaces": "true"}


def elements(spark: SparkSession, path: str, row_tag: str, glob: str = "*") -> DataFrame:
    """The row elements of all files under ``path`` as XML text ``xml``."""
    raw = (spark.read.option("lineSep", f"</{row_tag}>").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
           .text(path).select(F.col("value").cast("binary").alias("b")))
    text = raw.select(F.when(F.is_valid_utf8(F.col("b")), F.col("b").cast("string")).otherwise(F.decode("b", "ISO-8859-1")).alias("t"))
    inner = text.filter(F.contains("t", F.lit(f"<{row_tag}"))).select(F.substring_index("t", f"<{row_tag}", -1).alias("t"))
    return inner.filter(F.regexp_like("t", F.lit(r"^(\s[^>]*[^/>]|\s*)>"))).select(
        F.concat(F.lit(f"<{row_tag}"), F.col("t"), F.lit(f"</{row_tag}>")).alias("xml"))


def _text(kind: str, body: Column) -> Column:
    return F.concat(F.lit(f"{kind} ("), body, F.lit(")"))


def _ring(line: Column) -> Column:
    return F.concat(F.lit("("), line, F.lit(")"))


def _rings(shell: Column, holes: Column) -> Column:
    """Ring texts of a polygon; without a shell it is null."""
    return F.when(shell.isNotNull(), _ring(F.array_join(F.concat(
        F.array(_ring(shell)), F.coalesce(F.transform(holes, _ring), F.array().cast("array<string>"))), ", ")))


_PARTS = "array<struct<kind:string,body:string>>"


def _parts(members: Column, kind: str, body) -> Column:
    """``kind, body`` for each member that has a body; null members are none."""
    made = F.transform(members, lambda m: F.struct(F.lit(kind).alias("kind"), body(m).alias("body")))
    return F.filter(F.coalesce(made, F.array().cast(_PARTS)), lambda m: m["body"].isNotNull())


def _joined(parts: Column, single: bool | Column = True) -> Column:
    """Members -> WKT: one stays single (if ``single``), equal kinds are a multi geometry, others a collection."""
    def wkt(p):
        n, kinds = F.size(p), F.array_distinct(F.transform(p, lambda m: m["kind"]))
        lone = F.concat(p[0]["kind"], F.lit(" "), p[0]["body"])
        multi = F.concat(F.lit("MULTI"), kinds[0], F.lit(" ("), F.array_join(F.transform(p, lambda m: m["body"]), ", "), F.lit(")"))
        mixed = F.concat(F.lit("GEOMETRYCOLLECTION ("), F.array_join(F.transform(
            p, lambda m: F.concat(m["kind"], F.lit(" "), m["body"])), ", "), F.lit(")"))
        return (F.when(n == 0, F.lit(None).cast("string")).when((n == 1) & F.lit(single), lone)
                .when(F.size(kinds) == 1, multi).otherwise(mixed))
    return let(parts, wkt)


# ---------------------------------------------------------------- KML

_COORDINATES = "struct<coordinates:string>"
_BOUNDARY = f"struct<LinearRing:{_COORDINATES}>"
_KML_GEOMETRY = (f"Point:array<{_COORDINATES}>,LineString:array<{_COORDINATES}>,LinearRing:array<{_COORDINATES}>,"
                 f"Polygon:array<struct<outerBoundaryIs:{_BOUNDARY},innerBoundaryIs:array<struct<LinearRing:array<{_COORDINATES}>>>>>")


def _kml_schema(depth: int) -> str:
    fields = _KML_GEOMETRY
    for _ in range(depth):
        fields = f"{_KML_GEOMETRY},MultiGeometry:array<struct<{fields}>>"
    return ("struct<_id:string,name:string,description:string,ExtendedData:struct<Data:array<struct<_name:string,value:string>>,"
            f"SchemaData:array<struct<SimpleData:array<struct<_name:string,_VALUE:string>>>>>,{fields}>")


def _kml_line(element: Column) -> Column:
    """KML 'lon,lat[,alt] lon,lat ...' -> 'lon lat, lon lat'; none is null."""
    c = F.regexp_replace(F.trim(element["coordinates"]), r"\s*,\s*", ",")
    points = F.filter(F.split(c, r"\s+"), lambda p: F.length(p) > 0)
    return F.when(F.size(points) > 0, F.array_join(F.transform(
        points, lambda p: F.concat_ws(" ", F.slice(F.split(p, ","), 1, 2))), ", "))


def _kml_polygon(p: Column) -> Column:
    holes = F.flatten(F.transform(p["innerBoundaryIs"], lambda b: F.transform(b["LinearRing"], _kml_line)))
    return _rings(_kml_line(p["outerBoundaryIs"]["LinearRing"]), F.filter(holes, lambda h: h.isNotNull()))


def _kml_members(g: Column, depth: int) -> Column:
    """All members of a placemark or a MultiGeometry with those of its inner ones: points, lines, polygons, inner."""
    own = [_parts(g["Point"], "POINT", lambda m: _ring(_kml_line(m))), _parts(g["LineString"], "LINESTRING", lambda m: _ring(_kml_line(m))),
           _parts(g["LinearRing"], "LINESTRING", lambda m: _ring(_kml_line(m))), _parts(g["Polygon"], "POLYGON", _kml_polygon)]
    if depth:
        inner = F.flatten(F.transform(g["MultiGeometry"], lambda m: _kml_members(m, depth - 1)))
        own.append(F.coalesce(inner, F.array().cast(_PARTS)))
    return F.concat(*own)


def _has_name(name: str):
    return lambda d: d["name"] == F.lit(name)


def read_kml(spark: SparkSession, path: str, attributes: str | None = None, depth: int = 3, row_tag: str = "Placemark",
             glob: str = "*") -> DataFrame:
    """One row per placemark: name, description, its extended data, ``wkt`` and ``srid`` (WGS84).

    ``attributes`` is the schema (DDL) of the extended data (``Data`` and
    ``SimpleData`` by name; the first of a repeated name counts), one column
    each, null where a value is missing or no such type; without it there are
    none. MultiGeometries are flattened to ``depth`` levels; a placemark
    without a geometry has a null ``wkt``. Altitudes are dropped. A declared
    name that is already taken gets the suffix ``_data``.
    """
    row = elements(spark, path, row_tag, glob).select(F.from_xml("xml", _kml_schema(depth), _OPTIONS).alias("r"))
    simple = F.flatten(F.transform(F.col("r.ExtendedData.SchemaData"), lambda s: F.transform(
        s["SimpleData"], lambda d: F.struct(d["_name"].alias("name"), d["_VALUE"].alias("value")))))
    named = F.transform(F.col("r.ExtendedData.Data"), lambda d: F.struct(d["_name"].alias("name"), d["value"].alias("value")))
    none = F.array().cast("array<struct<name:string,value:string>>")
    columns = []
    for field in (T.StructType.fromDDL(attributes).fields if attributes else []):
        value = F.filter(F.col("_data"), _has_name(field.name))
        alias = f"{field.name}_data" if field.name.lower() in ("name", "description", "wkt", "srid") else field.name
        columns.append(F.get(value, F.lit(0))["value"].try_cast(field.dataType).alias(alias))
    read = row.withColumn("_data", F.concat(F.coalesce(named, none), F.coalesce(simple, none)))
    return read.select(F.col("r.name").alias("name"), F.col("r.description").alias("description"), *columns,
                       _joined(_kml_members(F.col("r"), depth)).alias("wkt"), F.lit(4326).alias("srid"))


# ---------------------------------------------------------------- GML

_SRS = "_srsName:string,_srsDimension:int"
_POSITIONS = "struct<_VALUE:string,_srsDimension:int>"
_POINT = f"struct<pos:{_POSITIONS},coordinates:string,{_SRS}>"
_LINE = f"struct<posList:{_POSITIONS},pos:array<{_POSITIONS}>,coordinates:string,{_SRS}>"
_CURVE = f"struct<segments:struct<LineStringSegment:array<{_LINE}>>,{_SRS}>"
_EDGE = f"struct<LinearRing:{_LINE}>"
_POLYGON = f"struct<exterior:{_EDGE},outerBoundaryIs:{_EDGE},interior:array<{_EDGE}>,innerBoundaryIs:array<{_EDGE}>,{_SRS}>"
#: Fixed names of GML 2 and 3: aggregate, its member elements (one each, then one for all).
_AGGREGATES = {
    "MultiPoint": ("pointMember", "pointMembers"),
    "MultiLineString": ("lineStringMember", None),
    "MultiCurve": ("curveMember", "curveMembers"),
    "MultiPolygon": ("polygonMember", None),
    "MultiSurface": ("surfaceMember", "surfaceMembers"),
    "MultiGeometry": ("geometryMember", "geometryMembers"),
}
_SHAPES = f"Point:array<{_POINT}>,LineString:array<{_LINE}>,Curve:array<{_CURVE}>,Polygon:array<{_POLYGON}>"
_GML_KINDS = ("Point", "LineString", "Curve", "Polygon", *_AGGREGATES)


def _gml_geometry(kinds: list[str]) -> T.StructType:
    """The schema of a geometry element: single shapes, and of the aggregates those of ``kinds``."""
    return T.StructType.fromDDL(",".join([_SHAPES, *(
        f"{kind}:struct<{one}:array<struct<{_SHAPES}>>,{(many or 'no' + one)}:struct<{_SHAPES}>,{_SRS}>"
        for kind, (one, many) in _AGGREGATES.items() if kind in kinds)]))


def latitude_first(srs: Column) -> Column:
    """Whether coordinates of this name stand in the order latitude, longitude.

    The URN and the HTTP form of EPSG:4326 keep the authority's axis order; the
    short form, CRS84 and EPSG:3067 (east, north) do not swap.
    """
    return F.coalesce(F.regexp_like(srs, F.lit(r"(?i)^(urn:(x-)?ogc:def:crs:|https?://www\.opengis\.net/def/crs/)"))
                      & (srid_from_name(srs) == 4326) & ~F.regexp_like(srs, F.lit("(?i)CRS84")), F.lit(False))


def _pairs(numbers: Column, dim: Column, swap: Column) -> Column:
    """'a b c d' -> 'a b, c d' by ``dim`` numbers a point; numbers that do not divide, or none, are null."""
    n = F.filter(F.split(F.trim(numbers), r"\s+"), lambda x: F.length(x) > 0)

    def points(v):
        count = F.floor(F.size(v) / dim).cast("int")
        first = lambda i, k: F.get(v, (i * dim + k).cast("int"))
        body = F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.when(
            swap, F.concat_ws(" ", first(i, 1), first(i, 0))).otherwise(F.concat_ws(" ", first(i, 0), first(i, 1)))), ", ")
        return F.when((F.size(v) > 0) & (F.size(v) % dim == 0), body)
    return let(n, points)


def _gml_line(line: Column, dim: Column, swap: Column) -> Column:
    """``posList``, a run of ``pos`` or GML 2 ``coordinates`` ('x,y x,y') -> 'x y, x y'."""
    listed = line["posList"]
    run = F.transform(line["pos"], lambda p: p["_VALUE"])
    width = F.size(F.split(F.trim(run[0]), r"\s+"))
    old = F.filter(F.split(F.trim(F.regexp_replace(line["coordinates"], r"\s*,\s*", ",")), r"\s+"), lambda x: F.length(x) > 0)
    return F.coalesce(
        _pairs(listed["_VALUE"], F.coalesce(listed["_srsDimension"], line["_srsDimension"], dim, F.lit(2)), swap),
        F.when(F.size(run) > 0, _pairs(F.array_join(run, " "), width, swap)),
        F.when(F.size(old) > 0, _pairs(F.translate(F.array_join(old, " "), ",", " "),
                                       F.size(F.split(old[0], ",")), swap)))


def _gml_point(point: Column, swap: Column) -> Column:
    own = F.coalesce(point["pos"]["_VALUE"], F.translate(point["coordinates"], ",", " "))
    return _pairs(own, F.size(F.split(F.trim(own), r"\s+")), swap)


def _gml_polygon(p: Column, dim: Column, swap: Column) -> Column:
    wide = F.coalesce(p["_srsDimension"], dim)
    none = F.array().cast(f"array<{_EDGE}>")
    holes = F.transform(F.concat(F.coalesce(p["interior"], none), F.coalesce(p["innerBoundaryIs"], none)),
                        lambda h: _gml_line(h["LinearRing"], wide, swap))
    shell = F.coalesce(p["exterior"], p["outerBoundaryIs"])["LinearRing"]
    return _rings(_gml_line(shell, wide, swap), F.filter(holes, lambda h: h.isNotNull()))


def _gml_curve(c: Column, dim: Column, swap: Column) -> Column:
    """A curve's straight segments, one line (each segment starts where the last one ends)."""
    pieces = F.transform(c["segments"]["LineStringSegment"], lambda s: _gml_line(s, F.coalesce(c["_srsDimension"], dim), swap))
    later = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda t: F.regexp_replace(t, r"^[^,]*, ", ""))
    return F.when(F.size(pieces) > 0, F.array_join(F.concat(F.slice(pieces, 1, 1), later), ", "))


def _gml_shapes(g: Column, dim: Column, swap: Column) -> Column:
    return F.concat(_parts(g["Point"], "POINT", lambda m: _ring(_gml_point(m, swap))),
                    _parts(g["LineString"], "LINESTRING", lambda m: _ring(_gml_line(m, dim, swap))),
                    _parts(g["Curve"], "LINESTRING", lambda m: _ring(_gml_curve(m, dim, swap))),
                    _parts(g["Polygon"], "POLYGON", lambda m: _gml_polygon(m, dim, swap)))


def _gml_srs(g: Column, kinds: list[str]) -> Column:
    """The name on the geometry, else on its first member."""
    groups = [k for k in _AGGREGATES if k in kinds]
    found = [F.get(g[k], F.lit(0))["_srsName"] for k in _GML_KINDS[:4]] + [g[k]["_srsName"] for k in groups]
    inner = [F.get(F.get(g[k][_AGGREGATES[k][0]], F.lit(0))[s], F.lit(0))["_srsName"] for k in groups for s in _GML_KINDS[:4]]
    return F.coalesce(*found, *inner)


def _gml_wkt(g: Column, kinds: list[str]) -> Column:
    """WKT of a geometry element; only the aggregates of ``kinds`` are looked at, which keeps the plan small."""
    aggregates = {k: v for k, v in _AGGREGATES.items() if k in kinds}

    holder = f"struct<{_SHAPES}>"
    members = [F.array(F.struct(*[g[k].alias(k) for k in _GML_KINDS[:4]]).cast(holder))]
    for kind, (one, many) in aggregates.items():
        members.append(F.coalesce(g[kind][one], F.array().cast(f"array<{holder}>")))
        if many:
            members.append(F.array(g[kind][many]))
    multi = reduce(lambda x, y: x | y, [g[k].isNotNull() for k in aggregates], F.lit(False))

    def with_order(o):
        shapes = F.transform(F.concat(*members), lambda m: _gml_shapes(m, o["dim"], o["swap"]))
        return _joined(F.flatten(F.filter(shapes, lambda x: x.isNotNull())), ~multi)
    dims = F.coalesce(F.lit(None).cast("int"), *[g[k]["_srsDimension"] for k in aggregates])
    srs = _gml_srs(g, kinds)
    return let(srs, lambda name: let(F.struct(dims.alias("dim"), latitude_first(name).alias("swap")), with_order))


def _without_prefixes(kind: T.DataType) -> T.DataType:
    """Element and attribute names without their namespace prefixes; of equal names the first stays."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_without_prefixes(kind.elementType))
    if not isinstance(kind, T.StructType):
        return kind
    fields: dict[str, T.DataType] = {}
    for f in kind.fields:
        mark = "_" if f.name.startswith("_") and ":" in f.name else ""
        fields.setdefault(mark + f.name.rsplit(":", 1)[-1], _without_prefixes(f.dataType))
    return T.StructType([T.StructField(name, t) for name, t in fields.items()])


def read_gml(spark: SparkSession, path: str, row_tag: str = "featureMember", geometry_field: str | None = None,
             properties: str | None = None, feature: str | None = None, glob: str = "*") -> DataFrame:
    """One row per feature member: its properties, ``wkt`` and ``srid``.

    ``properties`` (DDL, with ``feature``, the element within the member, and
    ``geometry_field``) gives the schema; without it the members are written
    once and Spark's XML source infers it from them in a pass of its own. ``srsName`` gives the SRID and
    the axis order; without one the SRID is null (reason ``missing_crs``).
    Members with different feature elements are unioned by column name.
    """
    rows = elements(spark, path, row_tag, glob)
    if properties is not None:
        if feature is None or geometry_field is None:
            raise ValueError("declared properties need the names of the feature element and of its geometry")
        kinds = {feature: T.StructType.fromDDL(properties).add(geometry_field, T.StringType())}
    else:
        options = {k: v for k, v in _OPTIONS.items() if k != "ignoreNamespace"}  # which finds no fields under a prefixed row tag
        # The elements are written once, so that all tasks infer and a file's name or charset plays no part.
        copy = f"{checkpoint_dir(spark).rstrip('/')}/gml-{uuid.uuid4().hex}"
        rows.select(F.translate("xml", "\r\n", "  ")).write.text(copy)
        inferred = _without_prefixes(spark.read.format("xml").options(**options).option("rowTag", row_tag).option("multiLine", "false").load(copy).schema)
        rows = spark.read.text(copy).select(F.col("value").alias("xml"))
        kinds = {f.name: f.dataType for f in inferred.fields if isinstance(f.dataType, T.StructType)}
    out = None
    for name, fields in kinds.items():
        spot = geometry_field or next((f.name for f in fields.fields if isinstance(f.dataType, T.StructType)
                                       and set(f.dataType.names) & set(_GML_KINDS)), None)
        if spot is None or spot not in fields.names:
            continue
        kept = [f for f in fields.fields if f.name not in (spot, "boundedBy")]
        shape = fields[spot].dataType
        present = shape.names if isinstance(shape, T.StructType) else list(_GML_KINDS)
        schema = T.StructType([T.StructField(name, T.StructType([*kept, T.StructField(spot, _gml_geometry(present))]))])
        read = rows.select(F.from_xml("xml", schema.simpleString(), _OPTIONS)[name].alias("r")).filter("r is not null")
        g = F.col("r")[spot]
        layer = read.select(*[F.col("r")[f.name].alias(f"{f.name}_property" if f.name in ("wkt", "srid") else f.name) for f in kept],
                            _gml_wkt(g, present).alias("wkt"), srid_from_name(_gml_srs(g, present)).alias("srid"))
        out = layer if out is None else out.unionByName(layer, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no feature with a geometry in <{row_tag}> elements")
    return out
