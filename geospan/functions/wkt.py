"""WKT text <-> geometry column, as native Spark expressions.

A geometry is ``struct<gtype, srid, parts>`` where ``parts`` is
``array<array<array<array<double>>>>`` = parts -> rings -> points -> [x, y].
Points and line strings use one part with one ring; a polygon is one part
whose first ring is the shell; a multi-geometry has one entry per member.

Decoding never raises: text that does not parse becomes a null geometry and
a ``reason`` string, so a bad row is reported instead of failing the job.
The parse is regex + ``from_json``: the coordinate text is rewritten into
JSON arrays and handed to Spark's JSON reader, which keeps everything in the
JVM (no Python round trip per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable."""
    return F.transform(F.array(value), body)[0]


GEOM_DDL = "struct<gtype:string,srid:int,parts:array<array<array<array<double>>>>>"
# Types as objects: casting to a DataType object avoids a SQL-parser round
# trip per cast while the (large) expressions are built.
_D2 = T.ArrayType(T.ArrayType(T.DoubleType()))
_D3 = T.ArrayType(_D2)
PARTS_DDL = T.ArrayType(_D3)
MEMBER_DDL = T.ArrayType(T.StructType([T.StructField("gtype", T.StringType()),
                                       T.StructField("parts", PARTS_DDL)]))
GEOM_TYPE = T.StructType([T.StructField("gtype", T.StringType()), T.StructField("srid", T.IntegerType()),
                          T.StructField("parts", PARTS_DDL)])

SIMPLE_TYPES = ("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON")

# A coordinate number as both WKT and JSON accept it; a third number (Z) is dropped.
_NUM = r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
_PAIR = rf"({_NUM})\s++({_NUM})(?:\s++{_NUM})?+"
_QUAD = rf"{_NUM}\s+{_NUM}\s+{_NUM}\s+{_NUM}"
# Numbers that WKT accepts and JSON does not ('+25', '.5', '60.').
_LOOSE = r"(?<![eE])\+|(?<!\d)\.|\.(?!\d)"
# What no coordinate list holds: another character, or a number on its own.
_SUSPECT = r"[^\d\s.,()eE+-]|[(,]\s*+[-+.\deE]++\s*+[,)]"
# What makes a text worth these two looks; each alternative starts with a literal, so that one quick scan tells.
_UNUSUAL = r"[^\d\s.,()-]|\.(?!\d)|\.(?<!\d\.)|[(,]\s*+[-.\d]++\s*+[,)]"
# Tag and optional dimension; the body is "EMPTY" or a parenthesised list.
_PREFIX = r"(?i)^\s*([a-z]+)\s*(?:(zm|z|m)(?![a-z])\s*)?"
_TRAILING_WS = " \t\n\r\f\u000b"
# Members of a GEOMETRYCOLLECTION: a tagged item with at most three levels of
# parentheses (enough for MULTIPOLYGON). Possessive quantifiers keep the Java
# regex engine from recursing once per character on long member texts.
_L3 = r"\([^()]*+\)"
_L2 = rf"\((?:[^()]++|{_L3})*+\)"
_L1 = rf"\((?:[^()]++|{_L2})*+\)"
_MEMBER = rf"(?i)((?:multi)?(?:point|linestring|polygon)\s*+(?:(?:zm|z|m)\s*+)?(?:empty|{_L1}))"
_MEMBER_LEFTOVER = r"^\(\s*(?:,\s*)*\)$"

_D4 = PARTS_DDL
_JSON_OPTS = {"allowNumericLeadingZeros": "true"}

# Rejection reasons, in the order the checks run (fixed values of this engine).
REASONS = (
    "null_wkt",
    "blank_wkt",
    "unparsable",
    "unsupported_dimension",
    "nested_collection",
    "empty",
    "non_finite",
    "needs_overlay",
    "invalid",
)


def _json(text: Column, kind: T.DataType) -> Column:
    """The JSON value ``text``, null when anything is left over after it.

    The reader stops after the first value, so the text is one field of an
    object whose last field shows that all of it was read.
    """
    schema = T.StructType([T.StructField("g", kind), T.StructField("e", T.IntegerType())])
    whole = F.concat(F.lit('{"g":'), text, F.lit(',"e":1}'))
    return let(F.from_json(whole, schema, _JSON_OPTS), lambda v: F.when(v["e"] == 1, v["g"]))


def _numbers(body: Column) -> Column:
    """``body`` with its numbers as JSON writes them, null if it holds anything but coordinates."""
    plain = F.regexp_replace(body, r"(?<![\w.])\+(?=[\d.])", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?<!\d)\.(?=\d)", "0."), r"(?<=\d)\.(?!\d)", ".0")
    return F.when(~body.rlike(_UNUSUAL), body).when(
        ~body.rlike(_SUSPECT), F.when(body.rlike(_LOOSE), plain).otherwise(body))


def _wrap(value: Column) -> Column:
    """``array(value)`` that stays null when ``value`` is null (value evaluated once)."""
    return let(value, lambda v: F.when(v.isNotNull(), F.array(v)))


def _coord_json(body: Column) -> Column:
    """'(1 2, 3 4)' -> '[[1,2],[3,4]]': pairs become arrays, parens brackets."""
    return F.translate(F.regexp_replace(_numbers(body), _PAIR, "[$1,$2]"), "()", "[]")


def _point_list_json(tag: Column, body: Column) -> Column:
    """Both MULTIPOINT spellings ('((1 2),(3 4))' and '(1 2,3 4)') -> '[[1,2],[3,4]]'.

    Parentheses that remain (a POINT has none inside) make the JSON malformed.
    """
    inner = F.substring(_numbers(body), F.lit(2), F.length(body) * 2)
    flat = F.regexp_replace(F.regexp_replace(inner, r"\)\s*$", ""), _PAIR, "[$1,$2]")
    bare = F.when(tag == "POINT", flat).otherwise(F.regexp_replace(flat, r"\(\s*(\[[^\[\]]*\])\s*\)", "$1"))
    return F.concat(F.lit("["), bare, F.lit("]"))


def _parts_of(tag: Column, body: Column) -> Column:
    """Nested coordinate arrays for one simple geometry, null if malformed."""
    return (
        F.when(F.upper(body) == "EMPTY", F.array().cast(_D4))
        .when(tag.isin("POINT", "MULTIPOINT"),
              F.transform(_json(_point_list_json(tag, body), _D2), lambda p: F.array(F.array(p))))
        .when(tag == "LINESTRING", let(_json(_coord_json(body), _D2),
                                       lambda v: F.when(v.isNotNull(), F.array(F.array(v)))))
        .when(tag == "POLYGON", _wrap(_json(_coord_json(body), _D3)))
        .when(tag == "MULTILINESTRING", F.transform(_json(_coord_json(body), _D3), lambda ln: F.array(ln)))
        .when(tag == "MULTIPOLYGON", _json(_coord_json(body), _D4))
    )


def _well_formed(tag: Column, parts: Column, is_empty: Column) -> Column:
    """Structure the WKT reader insists on: xy pairs, point counts, closed rings."""
    xy = F.forall(parts, lambda pa: F.forall(pa, lambda r: F.forall(
        r, lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull())))
    lines = F.forall(parts, lambda pa: F.forall(pa, lambda r: F.size(r) >= 2))
    rings = F.forall(
        parts,
        lambda pa: (F.size(pa) >= 1)
        & F.forall(pa, lambda r: (F.size(r) >= 4) & (r[0] == F.element_at(r, -1))),
    )
    shape = (
        F.when(tag == "POINT", F.size(parts) == 1)
        .when(tag.isin("LINESTRING", "MULTILINESTRING"), lines)
        .when(tag.isin("POLYGON", "MULTIPOLYGON"), rings)
        .otherwise(F.lit(True))
    )
    return is_empty | F.coalesce((F.size(parts) >= 1) & xy & shape, F.lit(False))


def _split(text: Column) -> Column:
    """``struct<tag, dim, body>`` of a WKT text (body '' when it is not
    'EMPTY' or a parenthesised list). Only the short prefix is matched by a
    regex; the body is cut off by position, so long coordinate lists are not
    scanned by the regex engine."""
    def from_prefix(prefix):
        rest = F.rtrim(F.substring(text, F.length(prefix) + 1, 1 << 30), F.lit(_TRAILING_WS))
        ok = (F.upper(rest) == "EMPTY") | (rest.startswith("(") & rest.endswith(")"))
        return F.struct(
            F.upper(F.regexp_extract(prefix, _PREFIX, 1)).alias("tag"),
            F.regexp_extract(prefix, _PREFIX, 2).alias("dim"),
            F.when(ok, rest).otherwise(F.lit("")).alias("body"),
        )
    return let(F.regexp_extract(text, _PREFIX, 0), from_prefix)


def _member(text: Column) -> Column:
    def from_split(s):
        return let(_parts_of(s["tag"], s["body"]), lambda parts: F.struct(
            s["tag"].alias("gtype"),
            F.when(F.upper(s["dim"]).isin("", "Z") & parts.isNotNull()
                   & _well_formed(s["tag"], parts, F.upper(s["body"]) == "EMPTY"), parts).alias("parts")))
    return let(_split(text), from_split)


def parse_wkt(wkt: Column) -> Column:
    """WKT text -> ``struct<gtype, parts, members, reason>`` (no normalisation).

    ``members`` is filled only for GEOMETRYCOLLECTION; ``reason`` is null when
    the text parsed. Null and blank input get ``null_wkt`` / ``blank_wkt``.
    Intermediate values are bound once (:func:`let`), so the parse runs once
    per row and the expression stays small.
    """
    def from_split(s):
        tag, dim, body = s["tag"], s["dim"], s["body"]
        is_empty = F.upper(body) == "EMPTY"
        simple = tag.isin(*SIMPLE_TYPES)
        is_coll = tag == "GEOMETRYCOLLECTION"

        def with_parts(parts):
            def with_members(members):
                leftover_ok = F.regexp_replace(body, _MEMBER, "").rlike(_MEMBER_LEFTOVER)
                reason = (
                    F.when(wkt.isNull(), F.lit("null_wkt"))
                    .when(~wkt.rlike(r"(?U)\S"), F.lit("blank_wkt"))
                    .when(F.upper(dim).isin("M", "ZM"), F.lit("unsupported_dimension"))
                    .when(simple & parts.isNull() & body.rlike(_QUAD), F.lit("unsupported_dimension"))
                    .when(simple & (parts.isNull() | ~_well_formed(tag, parts, is_empty)), F.lit("unparsable"))
                    .when(is_coll & body.rlike("(?i)geometrycollection"), F.lit("nested_collection"))
                    .when(is_coll & is_empty, F.lit("empty"))
                    .when(is_coll & ((F.size(members) == 0) | ~leftover_ok
                                     | F.exists(members, lambda m: m["parts"].isNull())), F.lit("unparsable"))
                    .when(~(simple | is_coll), F.lit("unparsable"))
                )
                return F.struct(tag.alias("gtype"), parts.alias("parts"), members.alias("members"),
                                reason.alias("reason"))

            member_txt = F.regexp_extract_all(body, F.lit(_MEMBER), 1)
            return let(F.when(is_coll & ~is_empty, F.transform(member_txt, _member)).cast(MEMBER_DDL),
                       with_members)

        return let(F.when(simple, _parts_of(tag, body)), with_parts)

    return let(_split(wkt), from_split)


# --------------------------------------------------------------------------
# Encoding
# --------------------------------------------------------------------------

def format_number(v: Column, decimals: int = 6) -> Column:
    """Fixed decimals, trailing zeros trimmed, half-even: '19.125', '60', '-0.5'."""
    text = F.bround(v, decimals).cast(T.DecimalType(38, decimals)).cast(T.StringType())
    return F.regexp_replace(text, r"\.?0+$|(\.\d*?[1-9])0+$", "$1")


def _coords_text(ring: Column, decimals: int) -> Column:
    return F.array_join(
        F.transform(ring, lambda p: F.concat(format_number(p[0], decimals), F.lit(" "),
                                              format_number(p[1], decimals))),
        ", ",
    )


def _rings_text(rings: Column, decimals: int) -> Column:
    return F.array_join(
        F.transform(rings, lambda r: F.concat(F.lit("("), _coords_text(r, decimals), F.lit(")"))), ", "
    )


def to_wkt(geom: Column, decimals: int = 6) -> Column:
    """Geometry -> WKT with ``decimals`` places, trimmed (the writer's default style)."""
    return let(geom, lambda g: _to_wkt(g, decimals))


def _to_wkt(g: Column, decimals: int) -> Column:
    geom = g
    parts = g["parts"]
    gtype = g["gtype"]
    body = (
        F.when(F.size(parts) == 0, F.lit("EMPTY"))
        .when(gtype.isin("POINT", "LINESTRING"),
              F.concat(F.lit("("), _coords_text(parts[0][0], decimals), F.lit(")")))
        .when(gtype == "POLYGON", F.concat(F.lit("("), _rings_text(parts[0], decimals), F.lit(")")))
        .when(gtype == "MULTIPOINT",
              F.concat(F.lit("("), F.array_join(F.transform(parts, lambda pa: F.concat(
                  F.lit("("), _coords_text(pa[0], decimals), F.lit(")"))), ", "), F.lit(")")))
        .when(gtype == "MULTILINESTRING",
              F.concat(F.lit("("), F.array_join(F.transform(parts, lambda pa: F.concat(
                  F.lit("("), _coords_text(pa[0], decimals), F.lit(")"))), ", "), F.lit(")")))
        .when(gtype == "MULTIPOLYGON",
              F.concat(F.lit("("), F.array_join(F.transform(parts, lambda pa: F.concat(
                  F.lit("("), _rings_text(pa, decimals), F.lit(")"))), ", "), F.lit(")")))
    )
    return F.when(geom.isNotNull(), F.concat(gtype, F.lit(" "), body))
