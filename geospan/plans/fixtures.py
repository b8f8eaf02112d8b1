"""Derived input views over the driver's tables.

The driver's tables hold no geometry, so the geometry inputs are derived
from them with plain SQL. Each view is written once, with ``{table}``
placeholders, and run by Spark (``spark.sql`` with DataFrame arguments) and by
DuckDB (the oracle) alike, so both engines see identical text. Coordinates
are multiples of powers of two and numbers are printed through DECIMAL, so
both engines produce the same strings.
"""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# events -> points in WGS84, with null, blank, junk and empty inputs.
OCC_POINTS = """
select event_id, event_type, ts, user_id,
  19 + (user_id % 13) + (event_id % 8) / 8e0 as lon,
  59 + (event_id % 11) + (user_id % 4) / 4e0 as lat,
  case when event_id % 17 = 0 then null when event_id % 17 = 1 then '   '
       when event_id % 17 = 2 then 'INVALID WKT STRING' when event_id % 17 = 3 then 'POINT EMPTY'
       else concat('POINT (',
         cast(cast(19 + (user_id % 13) + (event_id % 8) / 8e0 as decimal(9,4)) as string), ' ',
         cast(cast(59 + (event_id % 11) + (user_id % 4) / 4e0 as decimal(9,4)) as string), ')') end as wkt
from {events}
"""

# lineitem -> right triangles (returnflag R) and rectangles.
_POLY_BASE = """
select l_orderkey, l_linenumber, l_returnflag,
       cast(19 + (l_partkey % 13) as double) as x, cast(59 + (l_suppkey % 11) as double) as y,
       (1 + l_linenumber) / 8e0 as w, l_quantity / 64e0 as h
from {lineitem}
"""

OCC_POLYS = f"""
select l_orderkey, l_linenumber, l_returnflag, x, y, w, h,
  case when l_returnflag = 'R'
    then concat('POLYGON ((', cx0,' ',cy0,', ',cx1,' ',cy0,', ',cx0,' ',cy1,', ',cx0,' ',cy0,'))')
    else concat('POLYGON ((', cx0,' ',cy0,', ',cx1,' ',cy0,', ',cx1,' ',cy1,', ',cx0,' ',cy1,', ',cx0,' ',cy0,'))') end as wkt
from (select *, cast(cast(x as decimal(12,6)) as string) as cx0, cast(cast(y as decimal(12,6)) as string) as cy0,
             cast(cast(x + w as decimal(12,6)) as string) as cx1, cast(cast(y + h as decimal(12,6)) as string) as cy1
      from ({_POLY_BASE}) a) b
"""

# lineitem -> quads by l_linenumber % 4: 0 bow-tie (invalid), 1 rectangle,
# 2 rectangle with a hole inside (valid), 3 rectangle whose hole crosses the
# shell (invalid).
OCC_BOWTIE = f"""
select l_orderkey, l_linenumber, x, y, w, h, l_linenumber % 4 as kind,
  case l_linenumber % 4
    when 0 then concat('POLYGON ((', cx0,' ',cy0,', ',cx1,' ',cy1,', ',cx1,' ',cy0,', ',cx0,' ',cy1,', ',cx0,' ',cy0,'))')
    when 1 then concat('POLYGON ((', cx0,' ',cy0,', ',cx1,' ',cy0,', ',cx1,' ',cy1,', ',cx0,' ',cy1,', ',cx0,' ',cy0,'))')
    when 2 then concat('POLYGON ((', cx0,' ',cy0,', ',cx1,' ',cy0,', ',cx1,' ',cy1,', ',cx0,' ',cy1,', ',cx0,' ',cy0,'), (',
                       hx0,' ',hy0,', ',hx1,' ',hy0,', ',hx1,' ',hy1,', ',hx0,' ',hy1,', ',hx0,' ',hy0,'))')
    else concat('POLYGON ((', cx0,' ',cy0,', ',cx1,' ',cy0,', ',cx1,' ',cy1,', ',cx0,' ',cy1,', ',cx0,' ',cy0,'), (',
                hx0,' ',hy0,', ',ox1,' ',hy0,', ',ox1,' ',hy1,', ',hx0,' ',hy1,', ',hx0,' ',hy0,'))') end as wkt
from (select *, cast(cast(x as decimal(12,6)) as string) as cx0, cast(cast(y as decimal(12,6)) as string) as cy0,
             cast(cast(x + w as decimal(12,6)) as string) as cx1, cast(cast(y + h as decimal(12,6)) as string) as cy1,
             cast(cast(x + w / 4 as decimal(14,8)) as string) as hx0, cast(cast(y + h / 4 as decimal(14,8)) as string) as hy0,
             cast(cast(x + 3 * w / 4 as decimal(14,8)) as string) as hx1, cast(cast(y + 3 * h / 4 as decimal(14,8)) as string) as hy1,
             cast(cast(x + 2 * w as decimal(14,8)) as string) as ox1
      from ({_POLY_BASE}) a) b
"""

# lineitem -> geometry collections by l_linenumber % 5: 0 one point; 1 two
# points; 2 two disjoint rectangles; 3 two multipoints; 4 a point far west of
# a rectangle (mixed: buffered and dissolved).
OCC_COLLECTIONS = f"""
select l_orderkey, l_linenumber, x, y, w, h, l_linenumber % 5 as kind,
  case l_linenumber % 5
    when 0 then concat('GEOMETRYCOLLECTION (POINT (', cx0, ' ', cy0, '))')
    when 1 then concat('GEOMETRYCOLLECTION (POINT (', cx0, ' ', cy0, '), POINT (', cx1, ' ', cy1, '))')
    when 2 then concat('GEOMETRYCOLLECTION (POLYGON ((', cx0,' ',cy0,', ',cx1,' ',cy0,', ',cx1,' ',cy1,', ',cx0,' ',cy1,', ',cx0,' ',cy0,
                       ')), POLYGON ((', sx0,' ',cy0,', ',sx1,' ',cy0,', ',sx1,' ',cy1,', ',sx0,' ',cy1,', ',sx0,' ',cy0,')))')
    when 3 then concat('GEOMETRYCOLLECTION (MULTIPOINT ((', cx0, ' ', cy0, '), (', cx1, ' ', cy0, ')), MULTIPOINT ((', cx0, ' ', cy1, ')))')
    else concat('GEOMETRYCOLLECTION (POINT (', wx, ' ', cy0, '), POLYGON ((', cx0,' ',cy0,', ',cx1,' ',cy0,', ',cx1,' ',cy1,', ',cx0,' ',cy1,', ',cx0,' ',cy0,')))') end as wkt
from (select *, cast(cast(x as decimal(12,6)) as string) as cx0, cast(cast(y as decimal(12,6)) as string) as cy0,
             cast(cast(x + w as decimal(12,6)) as string) as cx1, cast(cast(y + h as decimal(12,6)) as string) as cy1,
             cast(cast(x + 20 as decimal(12,6)) as string) as sx0, cast(cast(x + 20 + w as decimal(12,6)) as string) as sx1,
             cast(cast(x - 5 as decimal(12,6)) as string) as wx
      from ({_POLY_BASE}) a) b
"""

# lineitem -> tab-separated occurrence lines: null tokens, boolean and number
# text in many spellings, short rows (l_linenumber 6), long rows (l_orderkey % 11
# = 5) and blank lines (l_orderkey % 13 = 7).
TSV_LINES = """
select l_orderkey, l_linenumber,
  case when l_orderkey % 13 = 7 then (case when l_linenumber % 2 = 0 then '' else '  ' end)
  else concat_ws(chr(9),
    concat('HR.', cast(l_orderkey as string), '-', cast(l_linenumber as string)),
    case l_partkey % 6 when 0 then 'NA' when 1 then 'null' when 2 then '' else concat('rank_', l_returnflag) end,
    case l_suppkey % 7 when 0 then 'TRUE' when 1 then 'false' when 2 then '1' when 3 then '0'
                       when 4 then 'maybe' when 5 then 'True' else '' end,
    case (l_partkey + l_suppkey) % 8 when 0 then cast(cast(l_quantity as bigint) as string)
                       when 1 then concat(' ', cast(cast(l_quantity as bigint) as string), ' ')
                       when 2 then '1e2' when 3 then 'n/a' when 4 then '1_000' when 5 then '2d'
                       when 6 then concat('-', cast(cast(l_quantity as bigint) as string), '.5') else 'inf' end,
    case when l_linenumber = 6 then null
         else concat('POINT (', cast(cast(19 + (l_partkey % 13) as decimal(9,4)) as string), ' ',
                     cast(cast(59 + (l_suppkey % 11) as decimal(9,4)) as string), ')') end,
    case when l_orderkey % 11 = 5 then 'extra' else null end)
  end as value
from {lineitem}
"""

# lineitem -> squares with diamond holes: apart, touching the shell once or twice, touching each other, in a closed ring.
OCC_TOUCHING = """
select l_orderkey, l_linenumber, l_partkey % 7 as kind, concat('POLYGON ((', a, ' ', b, ', ', a + 12, ' ', b, ', ', a + 12, ' ', b + 12, ', ',
    a, ' ', b + 12, ', ', a, ' ', b, ')', case l_partkey % 7
  when 0 then ''
  when 1 then concat(', (', a + 2, ' ', b + 4, ', ', a + 4, ' ', b + 2, ', ', a + 6, ' ', b + 4, ', ', a + 4, ' ', b + 6, ', ', a + 2, ' ', b + 4, ')')
  when 2 then concat(', (', a, ' ', b + 4, ', ', a + 4, ' ', b + 2, ', ', a + 6, ' ', b + 4, ', ', a + 4, ' ', b + 6, ', ', a, ' ', b + 4, ')')
  when 3 then concat(', (', a, ' ', b + 4, ', ', a + 6, ' ', b + 2, ', ', a + 12, ' ', b + 4, ', ', a + 6, ' ', b + 6, ', ', a, ' ', b + 4, ')')
  when 4 then concat(', (', a + 2, ' ', b + 4, ', ', a + 4, ' ', b + 2, ', ', a + 6, ' ', b + 4, ', ', a + 4, ' ', b + 6, ', ', a + 2, ' ', b + 4, ')',
                     ', (', a + 6, ' ', b + 4, ', ', a + 8, ' ', b + 2, ', ', a + 10, ' ', b + 4, ', ', a + 8, ' ', b + 6, ', ', a + 6, ' ', b + 4, ')')
  when 5 then concat(', (', a, ' ', b + 4, ', ', a + 4, ' ', b + 2, ', ', a + 6, ' ', b + 4, ', ', a + 4, ' ', b + 6, ', ', a, ' ', b + 4, ')',
                     ', (', a + 6, ' ', b + 4, ', ', a + 8, ' ', b + 2, ', ', a + 12, ' ', b + 4, ', ', a + 8, ' ', b + 6, ', ', a + 6, ' ', b + 4, ')')
  else concat(', (', a + 2, ' ', b + 2, ', ', a + 6, ' ', b + 1, ', ', a + 10, ' ', b + 2, ', ', a + 6, ' ', b + 3, ', ', a + 2, ' ', b + 2, ')',
              ', (', a + 10, ' ', b + 2, ', ', a + 11, ' ', b + 5, ', ', a + 6, ' ', b + 10, ', ', a + 9, ' ', b + 5, ', ', a + 10, ' ', b + 2, ')',
              ', (', a + 6, ' ', b + 10, ', ', a + 1, ' ', b + 5, ', ', a + 2, ' ', b + 2, ', ', a + 3, ' ', b + 5, ', ', a + 6, ' ', b + 10, ')')
  end, ')') as wkt
from (select l_orderkey, l_linenumber, l_partkey, l_suppkey % 40 as a, l_orderkey % 50 as b from {lineitem}) s
"""

# lineitem -> mixed collections of members that are contained, share an edge, overlap, fill a hole (in part), touch.
_SQUARE = "concat('(', {x0}, ' ', {y0}, ', ', {x1}, ' ', {y0}, ', ', {x1}, ' ', {y1}, ', ', {x0}, ' ', {y1}, ', ', {x0}, ' ', {y0}, ')')"


def _square(x0: int, y0: int, x1: int, y1: int) -> str:
    return _SQUARE.format(x0=f"a + {x0}", y0=f"b + {y0}", x1=f"a + {x1}", y1=f"b + {y1}")


OCC_MIXED = f"""
select l_orderkey, l_linenumber, kind, concat('GEOMETRYCOLLECTION (POLYGON (', {_square(0, 0, 4, 4)},
    case kind when 4 then concat(', ', {_square(1, 1, 2, 2)}) when 5 then concat(', ', {_square(1, 1, 3, 3)}) else '' end, '), ',
    case kind when 3 then concat('POINT (', a + 2, ' ', b + 2, ')') else concat('MULTIPOLYGON ((', case kind
      when 0 then {_square(1, 1, 2, 2)} when 1 then {_square(4, 0, 6, 4)} when 2 then {_square(2, 2, 6, 6)}
      when 4 then {_square(1, 1, 2, 2)} when 5 then {_square(1, 1, 2, 3)} else {_square(4, 4, 5, 5)} end,
      '), (', {_square(20, 20, 21, 21)}, '))') end, ')') as wkt
from (select l_orderkey, l_linenumber, l_partkey % 7 as kind, l_suppkey % 40 as a, l_orderkey % 50 as b from {{lineitem}}) s
"""

# lineitem -> holes, multis, lines, and spellings of numbers that WKT allows or not.
OCC_SHAPES = f"""
select l_orderkey, l_linenumber, kind, a, b, h, case kind
  when 0 then concat('POLYGON (', {_square(0, 0, 8, 10)}, ', ', {_square(1, 1, 3, 2)}, ', ', {_square(5, 4, 7, 9)}, ')')
  when 1 then concat('MULTIPOLYGON ((', {_square(0, 0, 8, 10)}, ', ', {_square(1, 1, 3, 2)}, '), (', {_square(10, 0, 12, 2)}, '))')
  when 2 then concat('LINESTRING (', a, ' ', b, ', ', a + 8, ' ', b, ', ', a + 8, ' ', b + h, ')')
  when 3 then concat('MultiLineString((', a, ' ', b, ', ', a + 2, ' ', b, '), (', a, ' ', b + h, ', ', a + 6, ' ', b + h, '))')
  when 4 then concat('MULTIPOINT (', a, ' ', b, ', (', a + 3, ' ', b, '), ', a, ' ', b + h, ')')
  when 5 then concat('point z ( +', a, '.5 ', b, '. -7e0 )')
  when 6 then concat('POINT (', a, ' ', b, ') or so')
  else concat('POLYGON ((', a, ' ', b, ', ', a + 8, ' ', b, ', ', a + 8, ' ', b + 8, ', ', a, ' ', b + 8, '))') end as wkt
from (select l_orderkey, l_linenumber, l_partkey % 8 as kind, l_suppkey % 40 as a, l_orderkey % 50 as b, l_linenumber as h
  from {{lineitem}}) s
"""

# orders -> archive members: archive = customer, ord = order key.
MEMBERS = """
select o_custkey as archive, o_orderkey as ord,
  case when o_orderkey % 97 = 0 then 'occurrences.txt'
       when o_orderpriority = '1-URGENT' then concat('sub/rows_', cast(o_orderkey as string), '.tsv')
       when o_orderpriority = '2-HIGH' and o_orderstatus = 'F' then concat('maps/Layer', cast(o_orderkey % 5 as string), '.SHP')
       when o_orderpriority = '2-HIGH' then concat('maps/layer', cast(o_orderkey % 5 as string), '.shp')
       when o_orderpriority = '3-MEDIUM' and o_orderstatus = 'F' then concat('maps/layer', cast(o_orderkey % 5 as string), '.shx')
       when o_orderpriority = '3-MEDIUM' then concat('maps/LAYER', cast(o_orderkey % 5 as string), '.DBF')
       when o_orderpriority = '4-NOT SPECIFIED' then concat('docs/readme_', cast(o_orderkey as string), '.txt')
       else concat('rows_', cast(o_orderkey as string), '/') end as member
from {orders}
"""

# events -> conversion-status updates: id = user, status by event type,
# optional progress and output fields.
CONV_LOG = """
select concat('conv_', cast(user_id as string)) as conversion_id, event_id, ts,
  case event_type when 'purchase' then 'complete' when 'error' then 'failed' else 'processing' end as status,
  case when event_type in ('view', 'click') then cast(event_id % 100 as int) else null end as progress_percent,
  case when event_type = 'purchase' then concat('out/', cast(event_id as string), '.zip') else null end as output,
  case when event_type = 'error' then concat('error ', props) else null end as error
from {events}
"""

# customer -> layer A (points in ETRS-TM35FIN); supplier -> layer B (one-part
# multipoints in WGS84). Their attribute columns differ.
LAYER_A = """
select c_custkey as id, c_name as name, c_mktsegment as segment, 3067 as srid,
  concat('POINT (', cast(200000 + (c_custkey % 500) * 1000 + 500 as string), ' ',
         cast(6650000 + c_nationkey * 20000 + (c_custkey % 7) * 1000 as string), ')') as wkt
from {customer}
"""

LAYER_B = """
select s_suppkey as id, s_name as name, s_acctbal as balance, 4326 as srid,
  concat('MULTIPOINT ((', cast(cast(20 + (s_suppkey % 10) / 4e0 as decimal(9,4)) as string), ' ',
         cast(cast(60 + s_nationkey / 8e0 as decimal(9,4)) as string), '))') as wkt
from {supplier}
"""

VIEWS = {
    "occ_points": OCC_POINTS,
    "occ_polys": OCC_POLYS,
    "occ_bowtie": OCC_BOWTIE,
    "occ_collections": OCC_COLLECTIONS,
    "tsv_lines": TSV_LINES,
    "occ_touching": OCC_TOUCHING,
    "occ_mixed": OCC_MIXED,
    "occ_shapes": OCC_SHAPES,
    "members": MEMBERS,
    "conv_log": CONV_LOG,
    "layer_a": LAYER_A,
    "layer_b": LAYER_B,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy per-row work at least one partition per core.

    For views that only scan: the partitions of any other plan are not known
    without running it, so it is left as it is. The test tables are single
    row groups, which no split size can divide.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        # Hash of a per-row id: even spread whatever the data (identical WKT
        # values do not collide), and no sort, unlike a round-robin exchange.
        # The id is stable on a retried task because the scan order is.
        return df.repartition(cores, F.monotonically_increasing_id())
    return df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a Spark DataFrame over the parquet tables."""
    sql = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    df = spark.sql(sql, **used)
    return spread(df) if "wkt" in df.columns else df


def view_sql(name: str) -> str:
    """The same view as a DuckDB subquery over the pre-registered tables."""
    return "(" + VIEWS[name].format(**{t: t for t in TABLES}) + ")"


EXPORT_NAMES = ["occurrenceID", "taxonRank", "isSensitiveTaxon", "individualCount", "footprintWKT"]


def _zip_exports(table: pa.Table) -> pa.Table:
    """One archive of the lines in ``table``, by its number: two kinds of occurrence export, rows, no payload, cut short."""
    number = table["number"][0].as_py()
    lines = table.sort_by([(c, "ascending") for c in ("l_orderkey", "l_linenumber", "value")])["value"]
    names = [["otherID", *EXPORT_NAMES[1:]], EXPORT_NAMES][number % 5 == 0]
    if number % 5 == 2:
        header, member = ["\t".join([*EXPORT_NAMES[:4], "Gathering.Conversions.WGS84_WKT"])], "sub/rows_1.tsv"
    else:
        header, member = ["\t".join(names), "fi", "en"], "notes.txt" if number % 5 == 3 else "occurrences.txt"
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("readme.txt", "An export.\n")
        z.writestr(member, "\n".join([*header, *lines.to_pylist()]))
    data = packed.getvalue()
    return pa.table({"archive": [number], "zip": [data[:-22] if number % 5 == 4 else data]})


def write_export_archives(spark: SparkSession, sf_dir: str, path: str, orders: int = 1000) -> None:
    """ZIP exports of ``orders`` order numbers each under ``path/archive=<number>``, from the ``tsv_lines`` view."""
    lines = view(spark, sf_dir, "tsv_lines").withColumn("number", F.floor(F.col("l_orderkey") / orders))
    zips = lines.groupBy("number").applyInArrow(_zip_exports, "archive long, zip binary")
    zips.select("archive", F.col("zip").cast("string")).write.partitionBy("archive").option("lineSep", "\n").text(path)


def write_vector_files(spark: SparkSession, sf_dir: str, path: str, size: int = 500) -> None:
    """Vector files of up to ``size`` features each, one row of text a file: customers as GeoJSON (ETRS-TM35FIN, with
    heights and a ``crs`` member), suppliers as GML (latitude first, a hole in each polygon), parts as KML (two points
    each, the brand and size as extended data)."""
    def files(rows, key, item, head, tail, name):
        one = rows.withColumn("_item", item).groupBy(F.floor(F.col(key) / size)).agg(
            F.array_join(F.array_sort(F.collect_list("_item")), "," if name == "geojson" else "").alias("body"))
        one.select(F.concat(F.lit(head), F.col("body"), F.lit(tail)).alias("value")).write.option(
            "maxRecordsPerFile", 1).option("lineSep", "\n").text(f"{path}/{name}")

    a = view(spark, sf_dir, "layer_a").withColumn("xy", F.regexp_extract("wkt", r"\((.*)\)", 1))
    feature = F.format_string(
        '{"type": "Feature", "properties": {"id": %d, "name": "%s {\\"x\\"}", "segment": "%s"}, "geometry": {"type": "Point", "coordinates": [%s, 7.5]}}',
        "id", "name", "segment", F.replace("xy", F.lit(" "), F.lit(", ")))
    files(a, "id", feature, '{"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3067"}}, '
          '"features": [', "]}", "geojson")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", (F.col("s_suppkey") % 10 + 20).alias("x"),
                                                       (F.col("s_nationkey") + 40).alias("y"))
    ring = "<gml:%s><gml:LinearRing><gml:posList>%s</gml:posList></gml:LinearRing></gml:%s>"
    shell = ring % ("exterior", "%2$d %1$d %2$d %3$d %4$d %3$d %4$d %1$d %2$d %1$d", "exterior")
    hole = ring % ("interior", "%2$d.25 %1$d.25 %2$d.25 %1$d.5 %2$d.5 %1$d.5 %2$d.25 %1$d.25", "interior")
    member = F.format_string(
        '<gml:featureMember><f:site><f:id>%5$d</f:id><f:name>%6$s</f:name><f:shape><gml:Polygon srsName="urn:ogc:def:crs:EPSG::4326">'
        + shell + hole + "</gml:Polygon></f:shape></f:site></gml:featureMember>",
        "x", "y", F.col("x") + 1, F.col("y") + 1, "s_suppkey", "s_name")
    files(supplier, "s_suppkey", member, '<f:c xmlns:f="f" xmlns:gml="http://www.opengis.net/gml/3.2">', "</f:c>", "gml")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", (F.col("p_partkey") % 10 + 20).alias("x"))
    mark = F.format_string(
        "<Placemark><name>%3$s</name><ExtendedData><Data name=\"id\"><value>%2$d</value></Data><SchemaData><SimpleData name=\"brand\">%4$s"
        "</SimpleData><SimpleData name=\"size\">%5$d</SimpleData></SchemaData></ExtendedData><MultiGeometry><Point><coordinates>%1$d,60.5,3"
        "</coordinates></Point><Point><coordinates>%1$d.75,61</coordinates></Point></MultiGeometry></Placemark>",
        "x", "p_partkey", "p_name", "p_brand", "p_size")
    files(part, "p_partkey", mark, "<kml><Document>", "</Document></kml>", "kml")
