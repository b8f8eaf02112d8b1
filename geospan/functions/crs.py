"""Re-projection between WGS84 (EPSG:4326) and ETRS-TM35FIN (EPSG:3067).

ETRS-TM35FIN is a transverse Mercator on the GRS80 ellipsoid (central
meridian 27 E, scale 0.9996, false easting 500 000 m). The mapping uses the
Krueger n-series to fourth order (Karney 2011, "Transverse Mercator with an
accuracy of a few nanometers"), written with native Spark math functions so
every vertex is projected inside the JVM. ETRS89 and WGS84 are treated as the
same datum.

The formulas are written once against a tiny ``ops`` namespace so the same
series can be emitted as a Spark ``Column`` and as SQL text (the latter feeds
the DuckDB oracle queries).
"""

from __future__ import annotations

import math
from types import SimpleNamespace

from pyspark.sql import Column
from pyspark.sql import functions as F

from geospan.functions.geometry import bind_geometry, make_geom

WGS84 = 4326
TM35FIN = 3067

# GRS80 ellipsoid and the TM35FIN projection parameters.
_A_AXIS = 6378137.0
_F = 1 / 298.257222101
_K0 = 0.9996
_LON0_DEG = 27.0
_FALSE_EASTING = 500000.0
_FALSE_NORTHING = 0.0

_N = _F / (2 - _F)
_E = math.sqrt(_F * (2 - _F))
_RECT_A = _A_AXIS / (1 + _N) * (1 + _N ** 2 / 4 + _N ** 4 / 64)
_KA = _K0 * _RECT_A
_ALPHA = (
    _N / 2 - 2 * _N ** 2 / 3 + 5 * _N ** 3 / 16 + 41 * _N ** 4 / 180,
    13 * _N ** 2 / 48 - 3 * _N ** 3 / 5 + 557 * _N ** 4 / 1440,
    61 * _N ** 3 / 240 - 103 * _N ** 4 / 140,
    49561 * _N ** 4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N ** 2 / 3 + 37 * _N ** 3 / 96 - _N ** 4 / 360,
    _N ** 2 / 48 + _N ** 3 / 15 - 437 * _N ** 4 / 1440,
    17 * _N ** 3 / 480 - 37 * _N ** 4 / 840,
    4397 * _N ** 4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N ** 2 / 3 - 2 * _N ** 3 + 116 * _N ** 4 / 45,
    7 * _N ** 2 / 3 - 8 * _N ** 3 / 5 - 227 * _N ** 4 / 45,
    56 * _N ** 3 / 15 - 136 * _N ** 4 / 35,
    4279 * _N ** 4 / 630,
)


class _Sql:
    """SQL text with arithmetic operators (only for emitting oracle SQL)."""

    def __init__(self, text: str):
        self.text = text

    @staticmethod
    def _t(v) -> str:
        if isinstance(v, _Sql):
            return v.text
        return f"{float(v):.17e}"

    def _bin(self, op, other, rev=False):
        a, b = (self._t(other), self.text) if rev else (self.text, self._t(other))
        return _Sql(f"({a} {op} {b})")

    def __add__(self, o): return self._bin("+", o)
    def __radd__(self, o): return self._bin("+", o, True)
    def __sub__(self, o): return self._bin("-", o)
    def __rsub__(self, o): return self._bin("-", o, True)
    def __mul__(self, o): return self._bin("*", o)
    def __rmul__(self, o): return self._bin("*", o, True)
    def __truediv__(self, o): return self._bin("/", o)
    def __neg__(self): return _Sql(f"(-{self.text})")


def _sqlfn(name):
    return lambda *args: _Sql(f"{name}({', '.join(_Sql._t(a) for a in args)})")


_SPARK = SimpleNamespace(sin=F.sin, cos=F.cos, sinh=F.sinh, cosh=F.cosh, atanh=F.atanh,
                         asin=F.asin, atan2=F.atan2, sqrt=F.sqrt)
_SQL = SimpleNamespace(**{k: _sqlfn(k) for k in ("sin", "cos", "sinh", "cosh", "atanh", "asin", "atan2", "sqrt")})

_DEG = math.pi / 180


def _conformal_lat(ops, lon, lat):
    """(tan of the conformal latitude, longitude from the central meridian in radians)."""
    s = ops.sin(lat * _DEG)
    t = ops.sinh(ops.atanh(s) - ops.atanh(s * _E) * _E)
    return t, (lon - _LON0_DEG) * _DEG


def _sphere_tm(ops, t, dlam):
    """(xi', eta') of the spherical transverse Mercator of the conformal sphere."""
    xi_p = ops.atan2(t, ops.cos(dlam))
    eta_p = ops.atanh(ops.sin(dlam) / ops.sqrt(t * t + 1.0))
    return xi_p, eta_p


def _conformal(ops, lon, lat):
    return _sphere_tm(ops, *_conformal_lat(ops, lon, lat))


def _forward_from_conformal(ops, xi_p, eta_p):
    xi = xi_p
    eta = eta_p
    for j, a in enumerate(_ALPHA, start=1):
        xi = xi + ops.sin(xi_p * (2.0 * j)) * ops.cosh(eta_p * (2.0 * j)) * a
        eta = eta + ops.cos(xi_p * (2.0 * j)) * ops.sinh(eta_p * (2.0 * j)) * a
    easting = eta * _KA + _FALSE_EASTING
    northing = xi * _KA + _FALSE_NORTHING
    return easting, northing


def _inverse_sphere(ops, easting, northing):
    xi = (northing - _FALSE_NORTHING) / _KA
    eta = (easting - _FALSE_EASTING) / _KA
    xi_p = xi
    eta_p = eta
    for j, b in enumerate(_BETA, start=1):
        xi_p = xi_p - ops.sin(xi * (2.0 * j)) * ops.cosh(eta * (2.0 * j)) * b
        eta_p = eta_p - ops.cos(xi * (2.0 * j)) * ops.sinh(eta * (2.0 * j)) * b
    return xi_p, eta_p


def _inverse_conformal(ops, xi_p, eta_p):
    chi = ops.asin(ops.sin(xi_p) / ops.cosh(eta_p))
    lam = ops.atan2(ops.sinh(eta_p), ops.cos(xi_p))
    return chi, lam


def _inverse_geodetic(ops, chi, lam):
    phi = chi
    for j, d in enumerate(_DELTA, start=1):
        phi = phi + ops.sin(chi * (2.0 * j)) * d
    return lam / _DEG + _LON0_DEG, phi / _DEG


def _inverse(ops, easting, northing):
    return _inverse_geodetic(ops, *_inverse_conformal(ops, *_inverse_sphere(ops, easting, northing)))


# ---------------------------------------------------------------- Spark side

def tm35fin_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(lon, lat) degrees -> (easting, northing) metres."""
    xi_p, eta_p = _conformal(_SPARK, lon, lat)
    return _forward_from_conformal(_SPARK, xi_p, eta_p)


def tm35fin_inverse(easting: Column, northing: Column) -> tuple[Column, Column]:
    """(easting, northing) metres -> (lon, lat) degrees."""
    return _inverse(_SPARK, easting, northing)


def _map_vertices(geom: Column, fn) -> Column:
    return F.transform(geom["parts"], lambda pa: F.transform(pa, lambda r: fn(r)))


def _passes(ring: Column, steps) -> Column:
    """Apply per-vertex steps in sequence; each step sees the previous pair,
    so every intermediate term is computed once per vertex."""
    def vertex_fn(step):
        return lambda p: F.array(*step(_SPARK, p[0], p[1]))

    for step in steps:
        ring = F.transform(ring, vertex_fn(step))
    return ring


def _forward_ring(ring: Column) -> Column:
    return _passes(ring, (_conformal_lat, _sphere_tm, _forward_from_conformal))


def _inverse_ring(ring: Column) -> Column:
    return _passes(ring, (_inverse_sphere, _inverse_conformal, _inverse_geodetic))


@bind_geometry
def moves(geom: Column, target: int) -> Column:
    """Whether a geometry has to be re-projected to reach ``target``."""
    return geom["srid"] != target


def to_srid(geom: Column, target: int) -> Column:
    """Re-project a geometry column to ``target`` (4326 or 3067).

    Rows already in the target stay as they are; rows in any other CRS come
    back null (the caller gives them the reason ``unsupported_crs``).
    """
    if target not in (WGS84, TM35FIN):
        raise ValueError(f"unsupported target CRS EPSG:{target}")
    src = geom["srid"]
    if target == TM35FIN:
        moved = make_geom(geom["gtype"], _map_vertices(geom, _forward_ring), TM35FIN)
        other = WGS84
    else:
        moved = make_geom(geom["gtype"], _map_vertices(geom, _inverse_ring), WGS84)
        other = TM35FIN
    return F.when(src == target, geom).when(src == other, moved)


def supported_srid(srid: Column) -> Column:
    return srid.isin(WGS84, TM35FIN)


# ----------------------------------------------------------------- SQL side

def tm35fin_forward_sql(lon_sql: str, lat_sql: str) -> tuple[str, str]:
    """SQL text (Spark and DuckDB) of the forward series for the oracle."""
    xi_p, eta_p = _conformal(_SQL, _Sql(f"({lon_sql})"), _Sql(f"({lat_sql})"))
    e, n = _forward_from_conformal(_SQL, xi_p, eta_p)
    return e.text, n.text


def tm35fin_inverse_sql(e_sql: str, n_sql: str) -> tuple[str, str]:
    lon, lat = _inverse(_SQL, _Sql(f"({e_sql})"), _Sql(f"({n_sql})"))
    return lon.text, lat.text
