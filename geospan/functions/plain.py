"""Geometry text decoded a batch of rows at a time: the quick path of the layer job.

The column expressions of :mod:`geospan.functions.wkt` and
:mod:`geospan.functions.validity` walk each row's nested arrays through
interpreted lambdas, a few hundred microseconds a row. Here the same rules run
as array operations over an Arrow batch: a regular expression (RE2) says that a
text has the common grammar, its numbers are cut out of the batch's bytes, and
rings, parts and rows are offsets into one array of points.

A row is either decided as the expressions would decide it, or left to them
(a null result): text beyond ``LONGEST`` characters, other spellings, lines in
mixed collections, numbers that are not finite, minus zero.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from geospan.functions.collections import _FULL, _STEP, BUFFER_DISTANCE

#: Longer texts are left to the expressions (and the distributed check), so that a batch stays small.
LONGEST = 4096
#: Pairs of edges that are held against each other at once.
PAIRS = 1 << 18
RESULT_DDL = "struct<gtype:string,parts:array<array<array<array<double>>>>,reason:string>"

TYPES = ("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON")
_POINT, _LINE, _POLYGON, _MULTI = 0, 1, 2, 3
_S = r"[ \t\n\r]"
_N = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_P = rf"{_S}*{_N}{_S}+{_N}(?:{_S}+{_N})?{_S}*"


def _list(item: str) -> str:
    return rf"{_S}*\((?:{item})(?:,(?:{item}))*\){_S}*"


_RINGS = _list(_list(_P))
_BODIES = (rf"{_S}*\({_P}\){_S}*", _list(_P), _RINGS, _list(rf"{_P}|{_S}*\({_P}\){_S}*"), _RINGS, _list(_RINGS))
_SHAPES = "|".join(rf"{tag}(?:{_S}+z)?{body}" for tag, body in zip(TYPES, _BODIES))
_PLAIN = rf"(?i)^{_S}*(?:(?:{_SHAPES})|geometrycollection{_S}*\({_S}*(?:{_SHAPES})(?:,{_S}*(?:{_SHAPES}))*\){_S}*)$"
# A simple type whose list does not end the text.
_UNENDED = rf"(?is)^{_S}*(?:{'|'.join(TYPES)}){_S}*\(.*[^) \t\n\r\f\v][ \t\n\r\f\v]*$"
_ANGLES = [-(k % _FULL) * _STEP for k in range(_FULL + 1)]
_COS = np.array([math.cos(a) for a in _ANGLES])
_SIN = np.array([math.sin(a) for a in _ANGLES])


def _starts(counts):
    return np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


def _within_run(counts):
    """0, 1, ... within each of runs of these lengths."""
    return np.arange(int(counts.sum())) - np.repeat(_starts(counts)[:-1], counts)


def _any_by(rows, flags, n):
    return np.bincount(rows[flags], minlength=n) > 0


class Shapes:
    """Points of a batch with the offsets of rings in points, parts in rings, rows in parts; ``tag`` of each part's member."""

    def __init__(self, x, y, points, rings, parts):
        self.x, self.y = x, y
        self.points, self.rings, self.parts = points, rings, parts     # counts by ring, by part, by row

    def row_of_ring(self):
        return np.repeat(np.repeat(np.arange(len(self.parts)), self.parts), self.rings)

    def take(self, rows):
        """The shapes of the rows with a true flag."""
        part = np.repeat(rows, self.parts)
        ring = np.repeat(part, self.rings)
        point = np.repeat(ring, self.points)
        return Shapes(self.x[point], self.y[point], self.points[ring], self.rings[part], self.parts[rows])

    def between(self, first, last):
        """The shapes of the rows from ``first`` up to ``last``, which is left out."""
        part, ring, point = (_starts(c) for c in (self.parts, self.rings, self.points))
        p, q = part[first], part[last]
        r, t = ring[p], ring[q]
        v, w = point[r], point[t]
        return Shapes(self.x[v:w], self.y[v:w], self.points[r:t], self.rings[p:q], self.parts[first:last])


def parse(text: pa.Array):
    """``x, y, row, ring start, part start, member start, type of the member`` by point, ``members`` by row, ``odd`` rows; of plain texts."""
    n = len(text)
    at = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset:text.offset + n + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    low = data | 32
    letter = (low >= 97) & (low <= 122)
    digit = (data >= 48) & (data <= 57)
    e = low == 101
    before = np.concatenate(([32], data[:-1])).astype(np.uint8)
    after_number = ((before >= 48) & (before <= 57)) | (before == 46)
    exponent = e & after_number
    sign = (data == 43) | (data == 45)
    exponent_sign = sign & ((before | 32) == 101)
    numeric = digit | (data == 46) | exponent | exponent_sign | (data == 45)
    starts = numeric & ~np.concatenate(([False], numeric[:-1]))
    starts[at[:-1]] = numeric[at[:-1]]
    word = letter & ~exponent & (low != 122) & ~np.concatenate(([False], letter[:-1]))
    word[at[:-1]] = letter[at[:-1]]
    opening, other = data == 40, (data == 41) | (data == 44)
    where = np.flatnonzero(starts | word | opening | other)
    kind = np.where(starts[where], 0, np.where(opening[where], 1, np.where(other[where] & (data[where] == 44), 2, np.where(word[where], 4, 3))))
    one, two = (np.concatenate((np.full(k, 3), kind[:-k])) for k in (1, 2))
    numbers = kind == 0
    ends = numeric & ~np.concatenate((numeric[1:], [False]))
    row_ends = at[1:][at[1:] > at[:-1]] - 1
    ends[row_ends] = numeric[row_ends]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    offsets = _starts(last - first + 1).astype(np.int32)
    values = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[numeric].tobytes())]).cast(
        pa.float64()).to_numpy(zero_copy_only=False)
    lead = np.flatnonzero((one[numbers] == 1) | (one[numbers] == 2))
    event = np.flatnonzero(numbers)[lead]
    row = np.searchsorted(at, where[event], side="right") - 1
    odd = _any_by(np.searchsorted(at, first, side="right") - 1, ~np.isfinite(values) | ((values == 0) & (data[first] == 45)), n)
    # Members: words but for the collection's own.
    words = np.flatnonzero(kind == 4)
    words = words[low[where[words]] != 103]
    begin = where[words]

    def char(k):
        return low[np.minimum(begin + k, len(low) - 1)]
    multi = char(0) == 109
    p, third, sixth, eighth = char(0), char(2), char(5), char(7)
    of_member = np.where(multi, _MULTI + np.where(sixth == 108, _LINE, np.where(eighth == 105, _POINT, _POLYGON)),
                         np.where(p == 108, _LINE, np.where(third == 105, _POINT, _POLYGON)))
    member = np.searchsorted(words, event, side="right") - 1
    tag = of_member[member]
    members = np.bincount(np.searchsorted(at, begin, side="right") - 1, minlength=n)
    fresh = np.concatenate(([True], member[1:] != member[:-1])) if len(member) else np.zeros(0, bool)
    ring = (one[event] == 1) | (tag == _MULTI + _POINT)
    part = ring & ((two[event] == 1) | (tag % 3 != _POLYGON) | fresh)
    return values[np.flatnonzero(numbers[numbers])[lead]], values[lead + 1], row, ring, part, tag, of_member, members, odd


def shapes_of(x, y, row, ring, part, n):
    """The shapes of parsed points, and the first point of each ring."""
    ring_at, part_at = np.flatnonzero(ring), np.flatnonzero(part)
    rings = np.diff(np.append(np.searchsorted(ring_at, part_at), len(ring_at)))
    return Shapes(x, y, np.diff(np.append(ring_at, len(x))), rings, np.bincount(row[part_at], minlength=n)), ring_at


def _edges(s: Shapes):
    """Edges without length left out: ``ring, i, m, x1, y1, x2, y2`` with their number in the ring."""
    first = _starts(s.points)
    tail = np.ones(len(s.x), bool)
    tail[first[1:] - 1] = False
    a = np.flatnonzero(tail)
    a = a[(s.x[a] != s.x[a + 1]) | (s.y[a] != s.y[a + 1])]
    ring = np.repeat(np.arange(len(s.points)), s.points)[a]
    m = np.bincount(ring, minlength=len(s.points))
    return ring, _within_run(m), m, s.x[a], s.y[a], s.x[a + 1], s.y[a + 1]


def _orient(ax, ay, bx, by, cx, cy):
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _between(v, a, b):
    return (v >= np.minimum(a, b)) & (v <= np.maximum(a, b))


def convex_rings(edges, n):
    """By ring: every turn of one sign and directions that go round once (``validity._convex_simple``)."""
    ring, i, m, x1, y1, x2, y2 = edges
    last = i == m[ring] - 1
    follow = np.arange(len(ring)) + 1
    follow[last] = _starts(m)[:-1][ring[last]]
    dx, dy = x2 - x1, y2 - y1
    turn = np.sign(dx * dy[follow] - dy * dx[follow])
    lefts, rights = (np.bincount(ring, turn == s, n) for s in (1, -1))
    convex = (m >= 3) & ((lefts == m) | (rights == m))
    for d in (dx, dy):
        sign = np.sign(d)
        held = np.flatnonzero(sign)
        r = ring[held]
        k = np.bincount(r, minlength=n)
        begin = _starts(k)[:-1]
        nxt = np.arange(len(held)) + 1
        closing = nxt == begin[r] + k[r]
        nxt[closing] = begin[r[closing]]
        convex &= np.bincount(r, sign[held] != sign[held][nxt], n) <= 2
    return convex


def _pair_blocks(counts):
    """Rows in blocks of about ``PAIRS`` pairs."""
    block = (np.cumsum(counts.astype(np.int64) ** 2) // PAIRS)
    return np.split(np.arange(len(counts)), np.flatnonzero(np.diff(block)) + 1)


def invalid_rows(s: Shapes):
    """Rows of polygons that break a topological rule of :mod:`geospan.functions.validity` (``interior_cut`` included)."""
    n, row = len(s.parts), s.row_of_ring()
    edges = _edges(s)
    convex = convex_rings(edges, len(s.points))
    # Convex polygons without holes whose boxes are apart need no more.
    open_ = _any_by(row, ~convex, n) | (np.bincount(row, minlength=n) > s.parts)
    several = ~open_ & (s.parts > 1)
    if several.any():
        open_[several] = ~_apart(s.take(several))
    bad = np.zeros(n, bool)
    whole = np.flatnonzero(open_)
    if len(whole):
        few = s.take(open_)
        counts = np.bincount(few.row_of_ring(), few.points, len(whole)).astype(np.int64)
        for block in _pair_blocks(counts):
            bad[whole[block]] = _broken(few.between(block[0], block[-1] + 1))
    return bad


def _pairs_of(counts):
    """Every pair of items of the same run, of runs of these lengths."""
    later = np.repeat(counts, counts) - 1 - _within_run(counts)
    a = np.repeat(np.arange(len(later)), later)
    return a, a + 1 + _within_run(later)


def _row_pairs(mine, n, *_):
    """Every pair of edges of a row."""
    return _pairs_of(np.bincount(mine, minlength=n))


def _broken(s: Shapes, pairs=_row_pairs):
    """Rows that break a rule; ``pairs`` names the edges that are held against each other."""
    n, row = len(s.parts), s.row_of_ring()
    part = np.repeat(np.arange(len(s.rings)), s.rings)
    number = _within_run(s.rings)
    ring, i, m, x1, y1, x2, y2 = _edges(s)
    bad = np.zeros(n, bool)
    left, right, low, high = np.minimum(x1, x2), np.maximum(x1, x2), np.minimum(y1, y2), np.maximum(y1, y2)
    mine = row[ring]
    a, b = pairs(mine, n, x1, y1, x2, y2)
    for least, most in ((left, right), (low, high)):
        near = (least[a] <= most[b]) & (least[b] <= most[a])
        a, b = a[near], b[near]
    bad |= _any_by(mine[a], _conflict(ring, i, m, x1, y1, x2, y2, a, b), n)
    # Every vertex against the edges of the other rings of its row.
    rings = np.bincount(row, minlength=n)
    of_point = np.repeat(np.arange(len(s.points)), s.points)
    probes = np.flatnonzero(rings[row[of_point]] > 1)
    if not len(probes):
        return bad
    # One entry for each vertex and other ring; edges count only where they reach the vertex's y.
    k = rings[row[of_point[probes]]]
    v = np.repeat(probes, k)
    t = np.repeat(_starts(rings)[row[of_point[probes]]], k) + _within_run(k)
    other = t != of_point[v]
    v, t = v[other], t[other]
    first = _starts(s.points)[:-1]
    reached = np.flatnonzero((np.minimum.reduceat(s.y, first)[t] <= s.y[v]) & (s.y[v] <= np.maximum.reduceat(s.y, first)[t]))
    k = m[t[reached]]
    entry = np.repeat(reached, k)
    e = np.repeat(_starts(m)[t[reached]], k) + _within_run(k)
    py = s.y[v[entry]]
    near = (low[e] <= py) & (py <= high[e])
    entry, e, py = entry[near], e[near], py[near]
    px = s.x[v[entry]]
    on = (_orient(x1[e], y1[e], x2[e], y2[e], px, py) == 0) & (left[e] <= px) & (px <= right[e])
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = ((y1[e] > py) != (y2[e] > py)) & (px < (x2[e] - x1[e]) * (py - y1[e]) / (y2[e] - y1[e]) + x1[e])
    on, inside = _any_by(entry, on, len(v)), np.bincount(entry[cross], minlength=len(v)) % 2 == 1
    mine, r = of_point[v], row[of_point[v]]
    same = part[mine] == part[t]
    hole, of_shell = number[mine] > 0, number[t] == 0
    bad |= _any_by(r, same & hole & of_shell & ~on & ~inside, n)
    bad |= _any_by(r, same & hole & ~of_shell & ~on & inside, n)
    # A shell's vertex in another part: in its shell and in none of its holes.
    far = ~same & ~hole
    if far.any():
        key = v[far] * len(s.rings) + part[t[far]]
        well = np.unique(key[of_shell[far] & ~on[far] & inside[far]])
        spared = np.unique(key[~of_shell[far] & (on[far] | inside[far])])
        bad[row[of_point[np.setdiff1d(well, spared) // len(s.rings)]]] = True
    touch = np.flatnonzero(same & on & ~bad[r])
    if len(touch):
        point = _places(part[mine[touch]], s.x[v[touch]], s.y[v[touch]])
        bad[row[_in_cycles(np.concatenate((mine[touch], t[touch])), np.tile(point, 2))]] = True
    return bad


def _conflict(ring, i, m, x1, y1, x2, y2, a, b):
    """``validity.edge_conflict`` of the edges ``a`` and ``b``."""
    ax1, ay1, ax2, ay2, bx1, by1, bx2, by2 = x1[a], y1[a], x2[a], y2[a], x1[b], y1[b], x2[b], y2[b]
    d1, d2 = _orient(bx1, by1, bx2, by2, ax1, ay1), _orient(bx1, by1, bx2, by2, ax2, ay2)
    d3, d4 = _orient(ax1, ay1, ax2, ay2, bx1, by1), _orient(ax1, ay1, ax2, ay2, bx2, by2)
    proper = (d1 * d2 < 0) & (d3 * d4 < 0)

    def on(d, px, py, qx1, qy1, qx2, qy2):
        return (d == 0) & _between(px, qx1, qx2) & _between(py, qy1, qy2)
    touch = (on(d1, ax1, ay1, bx1, by1, bx2, by2) | on(d2, ax2, ay2, bx1, by1, bx2, by2)
             | on(d3, bx1, by1, ax1, ay1, ax2, ay2) | on(d4, bx2, by2, ax1, ay1, ax2, ay2))
    by_x = np.abs(ax2 - ax1) >= np.abs(ay2 - ay1)
    wide = np.maximum(np.minimum(ax1, ax2), np.minimum(bx1, bx2)) < np.minimum(np.maximum(ax1, ax2), np.maximum(bx1, bx2))
    high = np.maximum(np.minimum(ay1, ay2), np.minimum(by1, by2)) < np.minimum(np.maximum(ay1, ay2), np.maximum(by1, by2))
    overlap = (d1 == 0) & (d2 == 0) & np.where(by_x, wide, high)
    same = ring[a] == ring[b]
    gap = np.abs(i[a] - i[b])
    adjacent = same & ((gap == 1) | (gap == m[ring[a]] - 1))
    return np.where(adjacent, overlap, np.where(same, proper | touch | overlap, proper | overlap))


def _places(part, x, y):
    """Numbers from 0 for the distinct points of each part."""
    order = np.lexsort((y, x, part))
    new = np.concatenate(([False], np.any([np.diff(c[order]) != 0 for c in (part, x, y)], axis=0)))
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new)
    return place


def _in_cycles(ring, point):
    """The rings that hang together, by the points at which they touch, with a cycle: as many ties as rings and points, or more."""
    n = point.max() + 1
    ties = np.unique(ring * n + point)
    a, b = ties % n, n + ties // n
    root = np.arange(b.max() + 1)
    while True:
        p, q = root[a], root[b]
        if (p == q).all():
            break
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root != root[root]).any():
            root = root[root]
    held = np.bincount(p, minlength=len(root)) >= np.bincount(root[np.unique(np.concatenate((a, b)))], minlength=len(root))
    return b[held[p]] - n


def _buffered(s: Shapes, buffer):
    """The shapes with the rings of one point in ``buffer`` as circles (``collections.circle_ring``)."""
    counts = np.where(buffer, _FULL + 1, s.points)
    src = _starts(s.points)[:-1]
    k, wide = _within_run(counts), np.repeat(buffer, counts)
    take = np.repeat(src, counts) + np.where(wide, 0, k)
    turn = np.where(wide, k, 0)
    x = np.where(wide, s.x[take] + _COS[turn] * BUFFER_DISTANCE, s.x[take])
    y = np.where(wide, s.y[take] + _SIN[turn] * BUFFER_DISTANCE, s.y[take])
    return Shapes(x, y, counts, s.rings, s.parts)


def _apart(s: Shapes):
    """By row: the boxes of its parts are pairwise apart."""
    first = _starts(np.add.reduceat(s.points, _starts(s.rings)[:-1]))[:-1]
    x0, x1, y0, y1 = (f.reduceat(c, first) for c in (s.x, s.y) for f in (np.minimum, np.maximum))
    k = np.repeat(s.parts, s.parts) - 1 - _within_run(s.parts)
    a = np.repeat(np.arange(len(s.rings)), k)
    b = a + 1 + _within_run(k)
    meet = ~((x1[a] < x0[b]) | (x1[b] < x0[a]) | (y1[a] < y0[b]) | (y1[b] < y0[a]))
    return ~_any_by(np.repeat(np.arange(len(s.parts)), s.parts)[a], meet, len(s.parts))


def decode_plain(text: pa.Array, topology: bool, rules: bool = True):
    """Plain texts -> ``types, shapes, reason, decided`` by row (type number, reason text or None).

    Without ``rules`` a geometry is whatever can be read: no rule of validity applies.
    """
    n = len(text)
    x, y, row, ring, part, tag, of_member, members, odd = parse(text)
    s, ring_at = shapes_of(x, y, row, ring, part, n)
    points = s.points
    kind_of_ring, row_of_ring = tag[ring_at], row[ring_at]
    area, line = kind_of_ring % 3 == _POLYGON, kind_of_ring % 3 == _LINE
    end = ring_at + points - 1
    loose = (area & ((points < 4) | (x[ring_at] != x[end]) | (y[ring_at] != y[end]))) | (line & (points < 2))
    unparsable = _any_by(row_of_ring, loose, n)
    member_row = np.repeat(np.arange(n), members)
    first = of_member[_starts(members)[:-1]]
    mixed = _any_by(member_row, of_member != first[member_row], n)
    collection = pc.match_substring_regex(text, r"(?i)^\s*g").to_numpy(zero_copy_only=False)
    kinds = np.where(mixed, _MULTI + _POLYGON, np.where(collection & (members > 1) & (first < _MULTI), first + _MULTI, first))
    decided = ~odd & ~(mixed & _any_by(row_of_ring, line, n))
    reason = np.full(n, None, dtype=object)
    reason[unparsable] = "unparsable"
    going = decided & ~unparsable
    if (mixed & going).any():
        s = _buffered(s, (kind_of_ring % 3 == _POINT) & (mixed & going)[row_of_ring])
        loose = np.zeros(n, bool)
        loose[mixed & going] = ~_apart(s.take(mixed & going))
        reason[loose] = "needs_overlay"
        going &= ~loose
    edges = _edges(s)
    row_of_ring = s.row_of_ring()
    # Rings keep four points without repeats; lines two distinct ones.
    thin = np.where(np.repeat(np.repeat(kinds, s.parts), s.rings) % 3 == _POLYGON, edges[2] < 3, (edges[2] < 1) & line)
    invalid = _any_by(row_of_ring, thin, n) & going
    if not rules:  # but collections refuse lines of one place
        return kinds, s, reason, decided & ~(collection & invalid)
    polygons = going & ~invalid & (kinds % 3 == _POLYGON)
    if topology and polygons.any():
        invalid[polygons] = invalid_rows(s.take(polygons))
    reason[invalid] = "invalid"
    return kinds, s, reason, decided


def _result(text: pa.Array, topology: bool, rules: bool, geometry: bool = True) -> pa.Array:
    n = len(text)
    plain = pc.fill_null(pc.match_substring_regex(text, _PLAIN), False)
    unended = pc.fill_null(pc.match_substring_regex(text, _UNENDED), False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
    kinds, reasons, decided = np.zeros(n, np.int64), np.full(n, None, dtype=object), np.zeros(n, bool)
    reasons[unended], decided[unended] = "unparsable", True
    parts = np.zeros(n, np.int64)
    s = Shapes(np.zeros(0), np.zeros(0), *(np.zeros(0, np.int64) for _ in range(3)))
    if len(at):
        k, s, reason, known = decode_plain(text.filter(plain).cast(pa.string()), topology, rules)
        kinds[at], reasons[at], decided[at] = k, reason, known
        if geometry:
            good = known & (reason == None)  # noqa: E711
            s = s.take(good)
            parts[at[good]] = s.parts
    reason = pa.array(reasons, pa.string())
    if not geometry:
        return pa.StructArray.from_arrays([reason], ["reason"], mask=pa.array(~decided))
    empty = ~(decided & (reasons == None))  # noqa: E711

    def lists(counts, values, mask=None):
        return pa.ListArray.from_arrays(pa.array(_starts(counts), pa.int32()), values, mask=None if mask is None else pa.array(mask))
    xy = np.empty(2 * len(s.x))
    xy[0::2], xy[1::2] = s.x, s.y
    nested = lists(parts, lists(s.rings, lists(s.points, lists(np.full(len(s.x), 2), pa.array(xy)))), empty)
    names = pc.if_else(pa.array(empty), None, pa.array(TYPES).take(pa.array(kinds)))
    return pa.StructArray.from_arrays([names, nested, reason], ["gtype", "parts", "reason"], mask=pa.array(~decided))


def plain_geometry(wkt: Column, topology: bool = True, rules: bool = True, geometry: bool = True) -> Column:
    """``struct<gtype, parts, reason>`` of plain texts, the rules of validity included if asked; null where the row is not decided here.

    Without ``geometry`` it is ``struct<reason>``: the same decode and rules, but no shape leaves the batch.
    """
    def decode(text: pa.Array) -> pa.Array:
        return _result(text, topology, rules, geometry)
    # Annotations are text in this module, which Spark would take for another kind of function.
    decode.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(decode, RESULT_DDL if geometry else "struct<reason:string>")(F.when(F.length(wkt) <= LONGEST, wkt))


def cyclic_touches(touches: Column) -> Column:
    """Whether the rings of a polygon and the points at which they touch, an array of ``struct<r, x, y>``, make a cycle."""
    def decide(held: pa.Array) -> pa.Array:
        cyclic = np.zeros(len(held), bool)
        r, x, y = (c.to_numpy(zero_copy_only=False) for c in held.flatten().flatten())
        if len(r):
            part = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy(zero_copy_only=False))
            rings, ring = np.unique(part * (int(r.max()) + 1) + r, return_inverse=True)
            cyclic[rings[_in_cycles(ring, _places(part, x, y))] // (int(r.max()) + 1)] = True
        return pa.array(cyclic)
    decide.__annotations__ = {"held": pa.Array, "return": pa.Array}
    return F.arrow_udf(decide, "boolean")(touches)


# Workers need no copy of the package: the functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
