"""The registered queries: one Spark plan per operator group, plus its oracle.

Each entry is ``(spark_fn, oracle_sql)``: ``spark_fn(spark, sf_dir)`` builds
the DataFrame with this library over the driver's tables; ``oracle_sql`` is
closed-form DuckDB SQL over the same tables (derived through the same view
text), computing the expected answer without any geometry code. Coordinates
are rounded to 6 places for degrees and 3 for metres (2 where the oracle
re-derives a projected polygon's centroid) before comparison.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geospan.functions import crs as C
from geospan.functions import geometry as G
from geospan.functions.wkt import to_wkt
from geospan.operators import archives as A
from geospan.operators import convlog as L
from geospan.operators.layer import good_rows, reject_rollup, to_layer, with_geometry
from geospan.operators.overlay import dissolve_mixed
from geospan.operators.union import to_table
from geospan.operators.validity import invalid_geometries
from geospan.session import checkpoint_dir, stored
from geospan.plans.convert import NO_PAYLOAD_MESSAGE, convert_archives
from geospan.plans.fixtures import EXPORT_NAMES, table, view, view_sql, write_export_archives, write_vector_files
from geospan.sources.dictionary import column_types
from geospan.sources.tsv import occurrences_from_lines
from geospan.sources.vector import read_vector

# ------------------------------------------------------------ SQL helpers


def _fmt(v: str, d: int = 6) -> str:
    """DuckDB text of a number as the WKT writer prints it (half-even, trimmed)."""
    return (f"regexp_replace(cast(cast(round_even({v}, {d}) as decimal(38,{d})) as varchar), "
            r"'\.?0+$|(\.\d*?[1-9])0+$', '\1')")


def _ring_sql(pts: list[tuple[str, str]]) -> str:
    return " || ', ' || ".join(f"{_fmt(x)} || ' ' || {_fmt(y)}" for x, y in pts)


def _fwd(lon: str, lat: str) -> tuple[str, str]:
    return C.tm35fin_forward_sql(lon, lat)


# ------------------------------------------------------------ G01 / G02 / G05

def wkt_points_decode(spark: SparkSession, sf: str) -> DataFrame:
    d = with_geometry(view(spark, sf, "occ_points"), "wkt")
    g = F.col("geometry")
    return d.select("event_id", g["gtype"].alias("gtype"), F.round(G.x_of(g), 6).alias("x"),
                    F.round(G.y_of(g), 6).alias("y"), "reject_reason")


WKT_POINTS_DECODE = f"""
select event_id,
  case when event_id % 17 < 4 then null else 'POINT' end as gtype,
  case when event_id % 17 < 4 then null else round(lon, 6) end as x,
  case when event_id % 17 < 4 then null else round(lat, 6) end as y,
  case event_id % 17 when 0 then 'null_wkt' when 1 then 'blank_wkt' when 2 then 'unparsable'
                     when 3 then 'empty' end as reject_reason
from {view_sql('occ_points')} v
"""


# ------------------------------------------------------------ G13 + F03

def points_tm35fin(spark: SparkSession, sf: str) -> DataFrame:
    lay = to_layer(view(spark, sf, "occ_points"), "wkt", geometry_type="point", crs="euref")
    g = F.col("geometry")
    return (good_rows(lay)
            .select("event_id", "event_type", F.round(G.x_of(g), 3).alias("easting"),
                    F.round(G.y_of(g), 3).alias("northing")))


_E, _N = _fwd("lon", "lat")
POINTS_TM35FIN = f"""
select event_id, event_type, round({_E}, 3) as easting, round({_N}, 3) as northing
from {view_sql('occ_points')} v where event_id % 17 >= 4
"""


# ------------------------------------------------------------ G10 / G11 / G12 / G17 / K04

def poly_centroid(spark: SparkSession, sf: str) -> DataFrame:
    lay = to_layer(view(spark, sf, "occ_polys"), "wkt", geometry_type="point", crs="wgs84")
    g = F.col("geometry")
    return lay.select("l_orderkey", "l_linenumber", F.round(G.x_of(g), 6).alias("cx"),
                      F.round(G.y_of(g), 6).alias("cy"))


POLY_CENTROID = f"""
select l_orderkey, l_linenumber,
  round(case when l_returnflag = 'R' then x + w / 3 else x + w / 2 end, 6) as cx,
  round(case when l_returnflag = 'R' then y + h / 3 else y + h / 2 end, 6) as cy
from {view_sql('occ_polys')} v
"""


def poly_bbox(spark: SparkSession, sf: str) -> DataFrame:
    lay = to_layer(view(spark, sf, "occ_polys"), "wkt", geometry_type="bbox", crs="wgs84")
    b = F.col("b")
    return lay.select("l_orderkey", "l_linenumber", F.col("geometry.gtype").alias("gtype"), G.bounds(F.col("geometry")).alias("b")).select(
                      "l_orderkey", "l_linenumber", "gtype",
                      F.round(b["minx"], 6).alias("minx"), F.round(b["miny"], 6).alias("miny"),
                      F.round(b["maxx"], 6).alias("maxx"), F.round(b["maxy"], 6).alias("maxy"))


POLY_BBOX = f"""
select l_orderkey, l_linenumber, 'POLYGON' as gtype, round(x, 6) as minx, round(y, 6) as miny,
  round(x + w, 6) as maxx, round(y + h, 6) as maxy
from {view_sql('occ_polys')} v
"""


def poly_footprint_wkt(spark: SparkSession, sf: str) -> DataFrame:
    lay = to_layer(view(spark, sf, "occ_polys"), "wkt", geometry_type="footprint", crs="wgs84")
    return lay.select("l_orderkey", "l_linenumber",
                      to_wkt(G.promote_to_multi(F.col("geometry"))).alias("footprint_wkt"))


_TRI = _ring_sql([("x", "y"), ("x + w", "y"), ("x", "y + h"), ("x", "y")])
_RECT = _ring_sql([("x", "y"), ("x + w", "y"), ("x + w", "y + h"), ("x", "y + h"), ("x", "y")])
POLY_FOOTPRINT_WKT = f"""
select l_orderkey, l_linenumber,
  'MULTIPOLYGON (((' || case when l_returnflag = 'R' then {_TRI} else {_RECT} end || ')))' as footprint_wkt
from {view_sql('occ_polys')} v
"""


def poly_centroid_tm35fin(spark: SparkSession, sf: str) -> DataFrame:
    """G01 -> G13 -> G10 (centroid in the target CRS): the headline job."""
    lay = to_layer(view(spark, sf, "occ_polys"), "wkt", geometry_type="point", crs="euref")
    g = F.col("geometry")
    return lay.select("l_orderkey", "l_linenumber", F.round(G.x_of(g), 2).alias("easting"),
                      F.round(G.y_of(g), 2).alias("northing"))


def _poly_centroid_tm35fin_sql() -> str:
    corners = {"a": ("x", "y"), "b": ("x + w", "y"), "c": ("x + w", "y + h"), "d": ("x", "y + h"), "t": ("x", "y + h")}
    cols = []
    for k, (lon, lat) in corners.items():
        e, n = _fwd(lon, lat)
        cols.append(f"{e} as e_{k}, {n} as n_{k}")
    # relative moments exactly as the Spark fold: origin = first vertex
    def ring(keys):
        terms_c2, terms_mx, terms_my = [], [], []
        for p, q in zip(keys, keys[1:] + keys[:1]):
            ax, ay = f"(e_{p} - e_a)", f"(n_{p} - n_a)"
            bx, by = f"(e_{q} - e_a)", f"(n_{q} - n_a)"
            cr = f"({ax} * {by} - {bx} * {ay})"
            terms_c2.append(cr)
            terms_mx.append(f"{cr} * ({ax} + {bx})")
            terms_my.append(f"{cr} * ({ay} + {by})")
        return " + ".join(terms_c2), " + ".join(terms_mx), " + ".join(terms_my)
    rc2, rmx, rmy = ring(["a", "b", "c", "d"])
    tc2, tmx, tmy = ring(["a", "b", "t"])
    return f"""
select l_orderkey, l_linenumber,
  round((abs(c2) / 2 * e_a + sign(c2) * mx / 6) / (abs(c2) / 2), 2) as easting,
  round((abs(c2) / 2 * n_a + sign(c2) * my / 6) / (abs(c2) / 2), 2) as northing
from (
  select *, case when l_returnflag = 'R' then {tc2} else {rc2} end as c2,
            case when l_returnflag = 'R' then {tmx} else {rmx} end as mx,
            case when l_returnflag = 'R' then {tmy} else {rmy} end as my
  from (select l_orderkey, l_linenumber, l_returnflag, {', '.join(cols)} from {view_sql('occ_polys')} v) p
) q
"""


# ------------------------------------------------------------ G03 / G04

def bowtie_validity(spark: SparkSession, sf: str) -> DataFrame:
    d = with_geometry(view(spark, sf, "occ_bowtie"), "wkt")
    valid = F.col("reject_reason").isNull()
    return d.select("l_orderkey", "l_linenumber", "kind", valid.alias("valid"),
                    F.when(valid, F.round(G.area(F.col("geometry")), 9)).alias("area"))


BOWTIE_VALIDITY = f"""
select l_orderkey, l_linenumber, kind, kind in (1, 2) as valid,
  case kind when 1 then round(w * h, 9) when 2 then round(w * h - (w / 2) * (h / 2), 9) end as area
from {view_sql('occ_bowtie')} v
"""


def bowtie_validity_join(spark: SparkSession, sf: str) -> DataFrame:
    """G04 by the distributed edge grid join (the path for very large rings)."""
    d = with_geometry(view(spark, sf, "occ_bowtie").select("l_orderkey", "l_linenumber", "kind", "wkt"), "wkt", topology=False) \
        .withColumn("_gid", F.monotonically_increasing_id())
    d = stored(d)               # ids stay fixed: the table is read twice below
    bad = invalid_geometries(d, "_gid")
    flagged = d.join(bad.withColumnRenamed("gid", "_gid").withColumn("_bad", F.lit(True)), "_gid", "left")
    valid = F.col("reject_reason").isNull() & F.col("_bad").isNull()
    return flagged.select("l_orderkey", "l_linenumber", "kind", valid.alias("valid"))


BOWTIE_VALIDITY_JOIN = f"""
select l_orderkey, l_linenumber, kind, kind in (1, 2) as valid from {view_sql('occ_bowtie')} v
"""


# ------------------------------------------------------------ G06 - G09 + G18

def collections_normalize(spark: SparkSession, sf: str) -> DataFrame:
    d = with_geometry(view(spark, sf, "occ_collections"), "wkt")
    g = F.col("geometry")
    b = F.col("b")
    return d.select("l_orderkey", "l_linenumber", "kind", g["gtype"].alias("gtype"),
                    F.size(g["parts"]).alias("n_parts"), G.bounds(g).alias("b")).select(
                    "l_orderkey", "l_linenumber", "kind", "gtype", "n_parts",
                    F.round(b["minx"], 6).alias("minx"), F.round(b["miny"], 6).alias("miny"),
                    F.round(b["maxx"], 6).alias("maxx"), F.round(b["maxy"], 6).alias("maxy"))


COLLECTIONS_NORMALIZE = f"""
select l_orderkey, l_linenumber, kind,
  case kind when 0 then 'POINT' when 1 then 'MULTIPOINT' when 2 then 'MULTIPOLYGON'
            when 3 then 'MULTIPOINT' else 'MULTIPOLYGON' end as gtype,
  case kind when 0 then 1 when 1 then 2 when 2 then 2 when 3 then 3 else 2 end as n_parts,
  round(case kind when 4 then x - 5 - 1e-5 else x end, 6) as minx,
  round(case kind when 4 then y - 1e-5 else y end, 6) as miny,
  round(case kind when 0 then x when 2 then x + 20 + w else x + w end, 6) as maxx,
  round(case kind when 0 then y when 3 then y + h else y + h end, 6) as maxy
from {view_sql('occ_collections')} v
"""


# ------------------------------------------------------------ A01 / A02

def rejected_rollup(spark: SparkSession, sf: str) -> DataFrame:
    lay = to_layer(view(spark, sf, "occ_points"), "wkt", geometry_type="point", crs="euref")
    return reject_rollup(lay)


REJECTED_ROLLUP = f"""
select case event_id % 17 when 0 then 'null_wkt' when 1 then 'blank_wkt' when 2 then 'unparsable'
                          when 3 then 'empty' else 'ok' end as outcome,
       count(*) as n_rows
from {view_sql('occ_points')} v group by 1
"""


# ------------------------------------------------------------ S05 / S06 / P01 / P02 / C01 / C02

TSV_NAMES = EXPORT_NAMES


def tsv_typed(spark: SparkSession, sf: str) -> DataFrame:
    lines = view(spark, sf, "tsv_lines").select("value")
    return occurrences_from_lines(lines, TSV_NAMES, column_types("tech"))


_TOKENS = "'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', " \
          "'<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'"
_NUM_RE = r"^[ \t\n\r\f\x0b]*[+-]?(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)" \
          r"(?:[eE][+-]?[0-9](?:_?[0-9])*)?[ \t\n\r\f\x0b]*$"


def _txt(e: str) -> str:
    return f"case when {e} in ({_TOKENS}) then null else {e} end"


TSV_TYPED = f"""
select {_txt('f[1]')} as occurrenceID, {_txt('f[2]')} as taxonRank,
  case when lower(f[3]) in ('true', '1') then true when lower(f[3]) in ('false', '0') then false end as isSensitiveTaxon,
  case when regexp_matches(f[4], '{_NUM_RE}')
       then cast(regexp_replace(f[4], '[ \\t\\n\\r\\f\\x0b_]', '', 'g') as double) end as individualCount,
  {_txt('f[5]')} as footprintWKT
from (select value, string_split(value, chr(9)) as f from {view_sql('tsv_lines')} v) s
where regexp_matches(value, '\\S') and len(f) <= 5
"""


def export_layer_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """End to end: export lines -> typed rows -> TM35FIN point layer -> outcome counts."""
    lines = view(spark, sf, "tsv_lines").select("value")
    typed = occurrences_from_lines(lines, TSV_NAMES, column_types("tech"))
    return reject_rollup(to_layer(typed, "footprintWKT", geometry_type="point", crs="euref"))


EXPORT_LAYER_ROLLUP = f"""
select case when f[5] is null or f[5] in ({_TOKENS}) then 'null_wkt'
            when f[5] like 'POINT (%' then 'ok' else 'unparsable' end as outcome,
       count(*) as n_rows
from (select value, string_split(value, chr(9)) as f from {view_sql('tsv_lines')} v) s
where regexp_matches(value, '\\S') and len(f) <= 5
group by 1
"""


# ------------------------------------------------------------ G04: touching rings, by row and by join

def touching_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Validity of polygons whose rings touch: each row's own check and the distributed one."""
    checkpoint_dir(spark)
    rows = with_geometry(view(spark, sf, "occ_touching"), "wkt", drop_wkt=False, geometry=False)
    # Counted before the join and kept: the second check takes its texts from here and does not make them again.
    counts = stored(rows.groupBy("kind", "wkt", F.col("reject_reason").alias("by_row")).agg(F.count(F.lit(1)).alias("n")))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))     # named, so that few bytes of text do not become one task of edges
    shapes = with_geometry(counts.select("wkt").repartition(tasks, "wkt").distinct(), "wkt", drop_wkt=False, topology=False).select("wkt", "geometry")
    shapes = stored(shapes.withColumn("_gid", F.monotonically_increasing_id()))     # edges carry an id, not the text
    bad = invalid_geometries(shapes, "_gid").withColumnRenamed("gid", "_gid")
    texts = shapes.select("wkt", "_gid").join(bad, "_gid").select("wkt", F.lit("invalid").alias("by_join"))
    return counts.join(texts, "wkt", "left").groupBy("kind", "by_row", "by_join").agg(F.sum("n").alias("n_rows"))


TOUCHING_RINGS = f"""
select kind, case when kind in (3, 5, 6) then 'invalid' end as by_row, case when kind in (3, 5, 6) then 'invalid' end as by_join,
  count(*) as n_rows
from {view_sql('occ_touching')} v group by 1
"""


# ------------------------------------------------------------ G01 / G03 / G10 / G18: holes, multis, lines, spellings

def shape_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Type, centroid and bounds of polygons with holes, multis, lines and odd spellings; the reason of unclosed or trailing text."""
    d = with_geometry(view(spark, sf, "occ_shapes"), "wkt")
    g = F.col("geometry")
    c, b = F.col("c"), F.col("b")
    d = d.select("l_orderkey", "l_linenumber", g["gtype"].alias("gtype"), G.centroid(g).alias("c"), G.bounds(g).alias("b"), "reject_reason")
    return d.select("l_orderkey", "l_linenumber", "gtype", F.round(G.x_of(c), 6).alias("cx"),
                    F.round(G.y_of(c), 6).alias("cy"), b["maxx"].alias("maxx"), b["maxy"].alias("maxy"), "reject_reason")


SHAPE_MEASURES = f"""
select l_orderkey, l_linenumber,
  case kind when 0 then 'POLYGON' when 1 then 'MULTIPOLYGON' when 2 then 'LINESTRING' when 3 then 'MULTILINESTRING'
    when 4 then 'MULTIPOINT' when 5 then 'POINT' end as gtype,
  round(a + case kind when 0 then (80 * 4 - 2 * 2 - 10 * 6) / 68e0 when 1 then (80 * 4 - 2 * 2 + 4 * 11) / 82e0
    when 2 then (8 * 4 + h * 8) / (8e0 + h) when 3 then (2 * 1 + 6 * 3) / 8e0 when 4 then 1e0 when 5 then 0.5e0 end, 6) as cx,
  round(b + case kind when 0 then (80 * 5 - 2 * 1.5e0 - 10 * 6.5e0) / 68e0 when 1 then (80 * 5 - 2 * 1.5e0 + 4 * 1) / 82e0
    when 2 then h * h / 2e0 / (8e0 + h) when 3 then 6 * h / 8e0 when 4 then h / 3e0 when 5 then 0e0 end, 6) as cy,
  cast(a + case kind when 0 then 8 when 1 then 12 when 2 then 8 when 3 then 6 when 4 then 3 when 5 then 0.5e0 end as double) as maxx,
  cast(b + case kind when 0 then 10 when 1 then 10 when 2 then h when 3 then h when 4 then h when 5 then 0 end as double) as maxy,
  case when kind >= 6 then 'unparsable' end as reject_reason
from {view_sql('occ_shapes')} v
"""


# ------------------------------------------------------------ G09: mixed collections whose members meet

def mixed_dissolve(spark: SparkSession, sf: str) -> DataFrame:
    """Mixed collections dissolved by the edge arrangement: parts, holes and area of the union."""
    checkpoint_dir(spark)
    rows = with_geometry(view(spark, sf, "occ_mixed"), "wkt", drop_wkt=False).withColumn("_gid", F.monotonically_increasing_id())
    done = dissolve_mixed(stored(rows), "wkt", "_gid")
    parts = F.col("geometry.parts")
    holes = F.aggregate(parts, F.lit(0), lambda n, part: n + F.size(part) - 1)
    return done.groupBy("kind", F.col("geometry.gtype").alias("gtype"), F.size(parts).alias("n_parts"), holes.alias("n_holes"),
                        F.round(G.area(F.col("geometry")), 6).alias("area"), "reject_reason").agg(F.count(F.lit(1)).alias("n_rows"))


MIXED_DISSOLVE = f"""
select kind, 'MULTIPOLYGON' as gtype, case kind when 3 then 1 when 6 then 3 else 2 end as n_parts,
  case kind when 5 then 1 else 0 end as n_holes,
  case kind when 0 then 17e0 when 1 then 25e0 when 2 then 29e0 when 3 then 16e0 when 4 then 17e0 when 5 then 15e0 else 18e0 end as area,
  cast(null as varchar) as reject_reason, count(*) as n_rows
from {view_sql('occ_mixed')} v group by kind
"""


# ------------------------------------------------------------ S08 / S09 / S10 / S01 / S03 / K01: ZIP exports -> layers

def zip_layers(spark: SparkSession, sf: str) -> DataFrame:
    """ZIP exports made from the order lines, converted to layers: the outcome of each archive."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/zip-layers-{uuid.uuid4().hex}"
    write_export_archives(spark, sf, f"{folder}/in")
    done = convert_archives(spark, f"{folder}/in", f"{folder}/out", "tech", "point", "euref", glob="part-*")
    number = F.regexp_extract("archive", r"archive=(\d+)", 1).cast("long")
    return done.select(number.alias("archive"), "payload_kind", "rows", "good", "error")


ZIP_LAYERS = f"""
select number as archive,
  case when number % 5 < 2 then 'occurrences' when number % 5 = 2 then 'rows' else 'rejected' end as payload_kind,
  case when number % 5 < 3 then n else 0 end as rows, case when number % 5 < 3 then good else 0 end as good,
  case number % 5 when 3 then '{NO_PAYLOAD_MESSAGE}' when 4 then 'not a ZIP archive' end as error
from (select l_orderkey // 1000 as number,
    count(*) filter (where regexp_matches(value, '\\S') and len(string_split(value, chr(9))) <= 5) as n,
    count(*) filter (where regexp_matches(value, '\\S') and len(string_split(value, chr(9))) <= 5
      and string_split(value, chr(9))[5] like 'POINT (%') as good
  from {view_sql('tsv_lines')} v group by 1) s
"""


# ------------------------------------------------------------ S09 / A05

def archive_classify(spark: SparkSession, sf: str) -> DataFrame:
    return A.classify_archives(view(spark, sf, "members"))


ARCHIVE_CLASSIFY = f"""
select archive,
  case when bool_or(member = 'occurrences.txt') then 'occurrences'
       when count(*) filter (where starts_with(regexp_extract(member, '([^/]*)$', 1), 'rows_')) > 0 then 'rows'
       else 'rejected' end as payload_kind,
  case when bool_or(member = 'occurrences.txt') then 'occurrences.txt'
       else arg_min(member, ord) filter (where starts_with(regexp_extract(member, '([^/]*)$', 1), 'rows_')) end
    as payload_member
from {view_sql('members')} v group by archive
"""


def sidecar_missing(spark: SparkSession, sf: str) -> DataFrame:
    return A.missing_sidecars(view(spark, sf, "members"))


SIDECAR_MISSING = f"""
with files as (select distinct archive, lower(member) as name from {view_sql('members')} v
               where not ends_with(member, '/')),
shp as (select archive, name from files where ends_with(name, '.shp')),
need as (select s.archive, s.name as shp, substr(s.name, 1, length(s.name) - 4) || e.ext as need
         from shp s, (values ('.shx'), ('.dbf')) e(ext)),
lack as (select * from need n where not exists (select 1 from files f where f.archive = n.archive and f.name = n.need))
select archive, regexp_extract(shp, '([^/]*)$', 1) as shapefile,
  string_agg(regexp_extract(need, '([^/]*)$', 1), ', ' order by regexp_extract(need, '([^/]*)$', 1)) as missing
from lack group by archive, shp
"""


# ------------------------------------------------------------ O01 - O04, A03, A04

def _state(spark, sf):
    return L.latest_status(view(spark, sf, "conv_log"))


def latest_status(spark: SparkSession, sf: str) -> DataFrame:
    return _state(spark, sf).select("conversion_id", "status", "progress_percent", "output", "error")


_LATEST = f"""
select conversion_id, arg_max(status, ts) as status,
  coalesce(arg_max(progress_percent, ts) filter (where progress_percent is not null), 0) as progress_percent,
  arg_max(output, ts) filter (where output is not null) as output,
  arg_max(error, ts) filter (where error is not null) as error,
  max(ts) as updated_at
from {view_sql('conv_log')} v group by conversion_id
"""
LATEST_STATUS = f"select conversion_id, status, progress_percent, output, error from ({_LATEST}) s"


def skip_known(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "customer").select(
        F.concat(F.lit("conv_"), F.col("c_custkey").cast("string")).alias("conversion_id"))
    return L.skip_known(requests, _state(spark, sf))


SKIP_KNOWN = f"""
select 'conv_' || cast(c_custkey as varchar) as conversion_id from customer
where 'conv_' || cast(c_custkey as varchar) not in
  (select conversion_id from ({_LATEST}) s where status in ('processing', 'complete'))
"""


def retention(spark: SparkSession, sf: str) -> DataFrame:
    log = view(spark, sf, "conv_log")
    now = log.select(F.max("ts")).scalar()
    state = L.latest_status(log)
    return (L.expired(state, now)
            .select("conversion_id", "status", (F.col("age_seconds")).alias("age_seconds")))


RETENTION = f"""
select conversion_id, status, date_diff('microsecond', updated_at, (select max(ts) from {view_sql('conv_log')} m)) // 1000000
  as age_seconds
from ({_LATEST}) s
where date_diff('microsecond', updated_at, (select max(ts) from {view_sql('conv_log')} m)) // 1000000 > 86400
"""


def conversion_key(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    lang = F.element_at(F.array(F.lit("tech"), F.lit("fi"), F.lit("en")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    gtype = F.when(F.col("o_orderstatus") == "F", "footprint").when(F.col("o_orderstatus") == "O", "point") \
        .otherwise("bbox")
    crs = F.when(F.col("o_orderkey") % 2 == 0, "wgs84").otherwise("euref")
    name = F.concat(F.lit("HBF."), F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", L.conversion_key(name, lang, gtype, crs).alias("conversion_id"))


CONVERSION_KEY = """
select o_orderkey, concat_ws('_', 'HBF.' || cast(o_orderkey as varchar),
  case o_orderkey % 3 when 0 then 'tech' when 1 then 'fi' else 'en' end,
  case o_orderstatus when 'F' then 'footprint' when 'O' then 'point' else 'bbox' end,
  case when o_orderkey % 2 = 0 then 'wgs84' else 'euref' end) as conversion_id
from orders
"""


def progress_percent(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    parts = li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n_parts"))
    return (li.join(parts, "l_orderkey")
            .select("l_orderkey", "l_linenumber",
                    L.progress_percent(F.col("l_linenumber"), F.col("n_parts")).alias("progress_percent")))


PROGRESS_PERCENT = """
select l.l_orderkey, l.l_linenumber, least(cast(floor(l.l_linenumber / p.n * 100) as integer), 99) as progress_percent
from lineitem l join (select l_orderkey, max(l_linenumber) as n from lineitem group by 1) p using (l_orderkey)
"""


def active_count(spark: SparkSession, sf: str) -> DataFrame:
    return L.active_count(_state(spark, sf))


ACTIVE_COUNT = f"select count(*) filter (where status = 'processing') as processing from ({_LATEST}) s"


# ------------------------------------------------------------ U01 / S15 / G14 / G16 / G17

def layers_to_table(spark: SparkSession, sf: str) -> DataFrame:
    return to_table([view(spark, sf, "layer_a"), view(spark, sf, "layer_b")], wkt_col="wkt", srid_col="srid").drop("geometry_issue")


_LON, _LAT = C.tm35fin_inverse_sql("cast(e as double)", "cast(n as double)")
LAYERS_TO_TABLE = f"""
select id, name, segment, cast(null as double) as balance,
  'POINT (' || {_fmt(_LON)} || ' ' || {_fmt(_LAT)} || ')' as footprintWKT
from (select id, name, segment,
        cast(regexp_extract(wkt, '\\(([0-9.]+) ', 1) as double) as e,
        cast(regexp_extract(wkt, ' ([0-9.]+)\\)', 1) as double) as n
      from {view_sql('layer_a')} a) a
union all
select id, name, null as segment, balance,
  'POINT (' || {_fmt("cast(regexp_extract(wkt, '\\(\\(([0-9.]+) ', 1) as double)")} || ' ' ||
  {_fmt("cast(regexp_extract(wkt, ' ([0-9.]+)\\)', 1) as double)")} || ')' as footprintWKT
from {view_sql('layer_b')} b
"""


# ------------------------------------------------------------ S11 / S12 / S13 / S15 / U01 / U02: vector files -> one table

def vector_table(spark: SparkSession, sf: str) -> DataFrame:
    """GeoJSON, GML and KML files made from three tables, read by path and joined to one table."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/vector-{uuid.uuid4().hex}"
    write_vector_files(spark, sf, folder)
    layers = read_vector(spark, [
        (f"{folder}/geojson", {"format": "geojson", "glob": "part-*", "properties": "id long, name string, segment string"}),
        (f"{folder}/gml", {"format": "gml", "glob": "part-*", "row_tag": "gml:featureMember", "feature": "site", "geometry_field": "shape",
                           "properties": "id long, name string"}),
        (f"{folder}/kml", {"format": "kml", "glob": "part-*", "attributes": "id long, brand string, size int"}),
        f"{folder}/gone.kml"])
    return to_table(layers).drop("description")


VECTOR_TABLE = f"""
with a as (select id, name, segment, cast(regexp_extract(wkt, '\\(([0-9.]+) ', 1) as double) as e,
             cast(regexp_extract(wkt, ' ([0-9.]+)\\)', 1) as double) as n from {view_sql('layer_a')} v),
     b as (select s_suppkey, s_name, s_suppkey % 10 + 20 as x, s_nationkey + 40 as y from supplier),
     c as (select *, p_partkey % 10 + 20 as x from part)
select cast(id as bigint) as id, name || ' {{"x"}}' as name, segment, cast(null as varchar) as brand, cast(null as integer) as size,
  cast(null as varchar) as geometry_issue, 'POINT (' || {_fmt(_LON)} || ' ' || {_fmt(_LAT)} || ')' as "footprintWKT" from a
union all
select cast(s_suppkey as bigint), s_name, null, null, null, null,
  format('POLYGON (({{0}} {{1}}, {{2}} {{1}}, {{2}} {{3}}, {{0}} {{3}}, {{0}} {{1}}), ({{0}}.25 {{1}}.25, {{0}}.5 {{1}}.25, {{0}}.5 {{1}}.5, {{0}}.25 {{1}}.25))',
    x, y, x + 1, y + 1) from b
union all
select cast(p_partkey as bigint), p_name, null, p_brand, cast(p_size as integer), null, format('MULTIPOINT (({{0}} 60.5), ({{0}}.75 61))', x) from c
"""


CATALOG = {
    "wkt_points_decode": (wkt_points_decode, WKT_POINTS_DECODE),
    "points_tm35fin": (points_tm35fin, POINTS_TM35FIN),
    "poly_centroid": (poly_centroid, POLY_CENTROID),
    "poly_bbox": (poly_bbox, POLY_BBOX),
    "poly_footprint_wkt": (poly_footprint_wkt, POLY_FOOTPRINT_WKT),
    "poly_centroid_tm35fin": (poly_centroid_tm35fin, _poly_centroid_tm35fin_sql()),
    "bowtie_validity": (bowtie_validity, BOWTIE_VALIDITY),
    "bowtie_validity_join": (bowtie_validity_join, BOWTIE_VALIDITY_JOIN),
    "shape_measures": (shape_measures, SHAPE_MEASURES),
    "mixed_dissolve": (mixed_dissolve, MIXED_DISSOLVE),
    "touching_rings": (touching_rings, TOUCHING_RINGS),
    "collections_normalize": (collections_normalize, COLLECTIONS_NORMALIZE),
    "rejected_rollup": (rejected_rollup, REJECTED_ROLLUP),
    "tsv_typed": (tsv_typed, TSV_TYPED),
    "export_layer_rollup": (export_layer_rollup, EXPORT_LAYER_ROLLUP),
    "zip_layers": (zip_layers, ZIP_LAYERS),
    "vector_table": (vector_table, VECTOR_TABLE),
    "archive_classify": (archive_classify, ARCHIVE_CLASSIFY),
    "sidecar_missing": (sidecar_missing, SIDECAR_MISSING),
    "latest_status": (latest_status, LATEST_STATUS),
    "skip_known": (skip_known, SKIP_KNOWN),
    "retention": (retention, RETENTION),
    "conversion_key": (conversion_key, CONVERSION_KEY),
    "progress_percent": (progress_percent, PROGRESS_PERCENT),
    "active_count": (active_count, ACTIVE_COUNT),
    "layers_to_table": (layers_to_table, LAYERS_TO_TABLE),
}
