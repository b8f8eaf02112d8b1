"""The union of small geometries' pieces, a batch of rows at a time.

The steps are those of :mod:`geospan.operators.overlay` (turned edges, cuts,
sub-edges of one place, the boundary, rings), as array operations over the
edges of many rows; edges of different rows never meet. Left to the joins (a
null result): texts that :mod:`geospan.functions.plain` does not read, lines,
more than ``EDGES`` edges, boundaries that do not close.
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

from geospan.functions import plain as P

#: More edges than this in a row are cut and traced by the joins.
EDGES = 256
#: Pairs of edges that are held against each other at once.
PAIRS = 1 << 18
PARTS_TEXT = "array<array<array<array<double>>>>"
_DEEP = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))


def _area(ring) -> float:
    x0, y0 = ring[0]
    return sum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(ring, ring[1:])) / 2


def _inside(point, ring) -> bool:
    x, y = point
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:])) % 2 == 1


def trace_rings(edges: list[tuple]) -> list | None:
    """Polygons (shell, then holes) bounded by directed edges with the interior on their left; None if they do not close."""
    out: dict = {}
    for x1, y1, x2, y2 in edges:
        out.setdefault((x1, y1), []).append((x2, y2))
    rings = []
    while out:
        start = min(out)
        path, here, seen = [start], start, {start: 0}
        while True:
            ways = out.get(here)
            if not ways:
                return None
            if len(ways) > 1 and len(path) > 1:  # of several ways the first clockwise from where it came
                back = math.atan2(path[-2][1] - here[1], path[-2][0] - here[0])
                ways.sort(key=lambda w: (back - math.atan2(w[1] - here[1], w[0] - here[0])) % (2 * math.pi) or 2 * math.pi, reverse=True)
            there = ways.pop()
            if not ways:
                del out[here]
            if there in seen:  # a loop closes, be it at the start or where the ring touches itself
                at = seen[there]
                rings.append(path[at:] + [there])
                for p in path[at + 1:]:
                    del seen[p]
                del path[at + 1:]
                here = there
                if at == 0:
                    break
            else:
                seen[there] = len(path)
                path.append(there)
                here = there
    shells = sorted((r for r in rings if _area(r) > 0), key=_area)
    polygons = [[r] for r in shells]
    for hole in (r for r in rings if _area(r) < 0):
        middle = ((hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2)
        home = next((p for p in polygons if _inside(middle, p[0])), None)
        if home is None:
            return None
        home.append(hole)
    return [[[list(p) for p in ring] for ring in polygon] for polygon in sorted(polygons)] or None


class Edges:
    """Edges of a batch in the order of rows and pieces, the interior on their left."""

    def __init__(self, s: P.Shapes):
        ring, _, _, x1, y1, x2, y2 = P._edges(s)
        first = P._starts(s.points)[:-1]
        x0, y0 = s.x[first][ring], s.y[first][ring]
        area = np.bincount(ring, (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0), len(s.points))
        turn = ((area > 0) != (P._within_run(s.rings) == 0))[ring]
        self.x1, self.x2, self.y1, self.y2 = (np.where(turn, q, p) for p, q in ((x1, x2), (x2, x1), (y1, y2), (y2, y1)))
        self.piece = np.repeat(np.arange(len(s.rings)), s.rings)[ring]
        self.row_of_piece = np.repeat(np.arange(len(s.parts)), s.parts)
        self.row = self.row_of_piece[self.piece]
        self.pieces, self.rows = len(s.rings), len(s.parts)

    def boxes(self):
        """By edge: least and greatest x and y."""
        return np.minimum(self.x1, self.x2), np.maximum(self.x1, self.x2), np.minimum(self.y1, self.y2), np.maximum(self.y1, self.y2)


def _meeting(first, counts, boxes):
    """Pairs of an edge and each of the ``counts`` edges from ``first`` on, whose boxes meet."""
    x0, x1, y0, y1 = boxes
    a = np.repeat(np.arange(len(first)), counts)
    b = np.repeat(first, counts) + P._within_run(counts)
    near = (x0[a] <= x1[b]) & (x0[b] <= x1[a]) & (y0[a] <= y1[b]) & (y0[b] <= y1[a])
    return a[near], b[near]


def _cuts(e: Edges):
    """``edge, x, y``: where edges of different pieces of a row meet, the same point for both."""
    own = np.searchsorted(e.piece, e.piece, side="right")
    a, b = _meeting(own, np.searchsorted(e.row, e.row, side="right") - own, e.boxes())
    ax1, ay1, ax2, ay2, bx1, by1, bx2, by2 = (c[i] for i in (a, b) for c in (e.x1, e.y1, e.x2, e.y2))
    d1, d2 = P._orient(bx1, by1, bx2, by2, ax1, ay1), P._orient(bx1, by1, bx2, by2, ax2, ay2)
    d3, d4 = P._orient(ax1, ay1, ax2, ay2, bx1, by1), P._orient(ax1, ay1, ax2, ay2, bx2, by2)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = d1 / (d1 - d2)
    found = [((d1 * d2 < 0) & (d3 * d4 < 0), ax1 + share * (ax2 - ax1), ay1 + share * (ay2 - ay1))]
    for d, x, y, p1, q1, p2, q2 in ((d1, ax1, ay1, bx1, by1, bx2, by2), (d2, ax2, ay2, bx1, by1, bx2, by2),
                                    (d3, bx1, by1, ax1, ay1, ax2, ay2), (d4, bx2, by2, ax1, ay1, ax2, ay2)):
        found.append(((d == 0) & P._between(x, p1, p2) & P._between(y, q1, q2), x, y))
    edge = np.concatenate([i[hit] for hit, _, _ in found for i in (a, b)])
    x, y = (np.concatenate([c[k][c[0]] for c in found for _ in (a, b)]) for k in (1, 2))
    # The ends of an edge are its stops anyway.
    new = ((x != e.x1[edge]) | (y != e.y1[edge])) & ((x != e.x2[edge]) | (y != e.y2[edge]))
    return edge[new], x[new], y[new]


def _sub_edges(e: Edges):
    """Edges cut at their stops: ``edge, x1, y1, x2, y2``."""
    edge, x, y = _cuts(e)
    along = (x - e.x1[edge]) * (e.x2[edge] - e.x1[edge]) + (y - e.y1[edge]) * (e.y2[edge] - e.y1[edge])
    order = np.lexsort((y, x, along, edge))
    edge, x, y = edge[order], x[order], y[order]
    new = np.ones(len(edge), bool)
    new[1:] = (edge[1:] != edge[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    edge, x, y = edge[new], x[new], y[new]
    stops = np.bincount(edge, minlength=len(e.x1)) + 2
    at = P._starts(stops)
    px, py = np.empty(at[-1]), np.empty(at[-1])
    px[at[:-1]], py[at[:-1]], px[at[1:] - 1], py[at[1:] - 1] = e.x1, e.y1, e.x2, e.y2
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    px[inner], py[inner] = x, y
    a = np.ones(at[-1], bool)
    a[at[1:] - 1] = False
    a = np.flatnonzero(a)
    return np.repeat(np.arange(len(stops)), stops)[a], px[a], py[a], px[a + 1], py[a + 1]


def _boundary(e: Edges):
    """Sub-edges, one a place, with the interior on one side only and inside no other piece: ``row, x1, y1, x2, y2``."""
    edge, ax, ay, bx, by = _sub_edges(e)
    ahead = (ax < bx) | ((ax == bx) & (ay < by))
    lx, ly, hx, hy = np.where(ahead, ax, bx), np.where(ahead, ay, by), np.where(ahead, bx, ax), np.where(ahead, by, ay)
    row, piece = e.row[edge], e.piece[edge]
    order = np.lexsort((hy, hx, ly, lx, row))
    row, piece, ahead, lx, ly, hx, hy = (c[order] for c in (row, piece, ahead, lx, ly, hx, hy))
    new = np.ones(len(row), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in (row, lx, ly, hx, hy)], axis=0)
    place, at = np.cumsum(new) - 1, np.flatnonzero(new)
    forth, back = np.logical_or.reduceat(ahead, at), np.logical_or.reduceat(~ahead, at)
    one = forth != back
    row, forth, lx, ly, hx, hy = (c[one] for c in (row[at], forth, lx[at], ly[at], hx[at], hy[at]))
    number = np.cumsum(one) - 1
    owned = one[place]
    owners = np.sort(number[place[owned]] * e.pieces + piece[owned])
    mx, my = (np.where(forth, lx, hx) + np.where(forth, hx, lx)) / 2, (np.where(forth, ly, hy) + np.where(forth, hy, ly)) / 2
    keep = ~_inside_others(e, row, mx, my, owners)
    return tuple(c[keep] for c in (row, np.where(forth, lx, hx), np.where(forth, ly, hy), np.where(forth, hx, lx), np.where(forth, hy, ly)))


def _inside_others(e: Edges, row, mx, my, owners):
    """Whether points lie inside a piece of their row; ``owners`` (point * pieces + piece, sorted) are not asked."""
    held, first = np.unique(e.piece, return_index=True)
    x0, x1, y0, y1 = (f.reduceat(c, first) for f, c in zip((np.minimum, np.maximum) * 2, e.boxes()))
    n_edges = np.diff(np.append(first, len(e.piece)))
    at = np.searchsorted(e.row_of_piece[held], np.arange(e.rows + 1))
    k = np.diff(at)[row]
    point = np.repeat(np.arange(len(row)), k)
    box = np.repeat(at[row], k) + P._within_run(k)
    px, py = mx[point], my[point]
    near = (px >= x0[box]) & (px <= x1[box]) & (py >= y0[box]) & (py <= y1[box])
    point, box = point[near], box[near]
    key = point * e.pieces + held[box]
    asked = np.searchsorted(owners, key, side="right") == np.searchsorted(owners, key)
    point, box = point[asked], box[asked]
    inside = np.zeros(len(row), bool)
    if len(point):
        probe = np.repeat(np.arange(len(point)), n_edges[box])
        line = np.repeat(first[box], n_edges[box]) + P._within_run(n_edges[box])
        px, py, lx1, ly1, lx2, ly2 = mx[point[probe]], my[point[probe]], e.x1[line], e.y1[line], e.x2[line], e.y2[line]
        with np.errstate(divide="ignore", invalid="ignore"):
            crossed = ((ly1 > py) != (ly2 > py)) & (px < (lx2 - lx1) * (py - ly1) / (ly2 - ly1) + lx1)
        inside[point[np.bincount(probe[crossed], minlength=len(point)) % 2 == 1]] = True
    return inside


def _linked(row, order, x1, y1, x2, y2, rows):
    """``follow`` (the edge after each), ``vertex`` of its start, rows that are not linked one to one.

    The edges come in the order of their starts, ``order`` is that of their ends. Where
    several edges leave a vertex, it is the first clockwise from where an edge came.
    """
    n = len(row)
    follow = np.empty(n, np.int64)
    follow[order] = np.arange(n)
    fresh = np.ones(n, bool)
    fresh[1:] = (row[1:] != row[:-1]) | (x1[1:] != x1[:-1]) | (y1[1:] != y1[:-1])
    vertex = np.cumsum(fresh) - 1
    size = np.bincount(vertex)[vertex] if n else np.zeros(0, np.int64)
    at = np.flatnonzero(size > 1)
    if not len(at):
        return follow, vertex, np.zeros(rows, bool)
    came = np.repeat(order[at], size[at])
    way = np.repeat(np.flatnonzero(fresh)[vertex[at]], size[at]) + P._within_run(size[at])
    turn = (np.arctan2(y1[came] - y2[came], x1[came] - x2[came]) - np.arctan2(y2[way] - y1[way], x2[way] - x1[way])) % (2 * np.pi)
    turn[turn == 0] = 2 * np.pi
    best = np.lexsort((turn, came))
    best = best[np.concatenate(([True], came[best][1:] != came[best][:-1]))]
    odd = P._any_by(row[at], np.bincount(way[best], minlength=n)[at] != 1, rows)
    best = best[~odd[row[came[best]]]]
    follow[came[best]] = way[best]
    return follow, vertex, odd


def _homes(x, y, after, start, size, area, ring_row):
    """The shell of each hole: the least of its row around the middle of the hole's first edge, or -1; shells are their own."""
    home = np.arange(len(start))
    holes, shells = np.flatnonzero(area < 0), np.flatnonzero(area > 0)
    low, high = (np.searchsorted(ring_row[shells], ring_row[holes], side=s) for s in ("left", "right"))
    hole = np.repeat(holes, high - low)
    shell = shells[np.repeat(low, high - low) + P._within_run(high - low)]
    ask = np.repeat(np.arange(len(hole)), size[shell])
    a = np.repeat(start[shell], size[shell]) + P._within_run(size[shell])
    b = after[a]
    first = start[hole]
    px, py = ((c[first] + c[after[first]]) / 2 for c in (x, y))
    px, py = px[ask], py[ask]
    with np.errstate(divide="ignore", invalid="ignore"):
        crossed = ((y[a] > py) != (y[b] > py)) & (px < (x[b] - x[a]) * (py - y[a]) / (y[b] - y[a]) + x[a])
    inside = np.bincount(ask[crossed], minlength=len(hole)) % 2 == 1
    hole, shell = hole[inside], shell[inside]
    order = np.lexsort((shell, area[shell], hole))
    hole, shell = hole[order], shell[order]
    one = np.ones(len(hole), bool)
    one[1:] = hole[1:] != hole[:-1]
    home[holes] = -1
    home[hole[one]] = shell[one]
    return home


def _simple_rings(row, x1, y1, x2, y2, rows):
    """Rings of rows whose rings pass none of their vertices twice, as :func:`trace_rings` finds them: ``shapes, known`` rows.

    The edges come in the order of their starts and ends; an edge's ring is the
    least edge of its cycle, its place the steps left to it, found by doubling.
    """
    order = np.lexsort((y2, x2, row))
    paired = (row == row[order]) & (x1 == x2[order]) & (y1 == y2[order])
    known = (np.bincount(row, minlength=rows) > 0) & ~P._any_by(row, ~paired, rows)
    kept = known[row]
    number = np.cumsum(kept) - 1
    order = number[order[kept]]
    row, x1, y1, x2, y2 = (c[kept] for c in (row, x1, y1, x2, y2))
    n = len(row)
    follow, vertex, odd = _linked(row, order, x1, y1, x2, y2, rows)
    known &= ~odd
    longest = int(np.bincount(row, minlength=1).max())
    lead, to = np.arange(n), follow.copy()
    for _ in range(longest.bit_length()):
        lead, to = np.minimum(lead, lead[to]), to[to]
    to = np.where(follow == lead, np.arange(n), follow)
    left = (follow != lead).astype(np.int64)
    for _ in range(longest.bit_length()):
        left, to = left + left[to], to[to]
    if n and vertex[-1] + 1 < n:    # a ring that comes to a vertex again is taken apart by trace_rings
        key = np.sort(lead * n + vertex)
        known &= ~P._any_by(row[key[1:] // n], key[1:] == key[:-1], rows)
    order = np.lexsort((-left, lead))
    row, x1, y1 = row[order], x1[order], y1[order]
    start = np.flatnonzero(lead[order] == order)
    size = np.diff(np.append(start, n))
    x0, y0 = np.repeat(x1[start], size), np.repeat(y1[start], size)
    after = np.arange(n) + 1
    after[start + size - 1] = start
    area = np.bincount(np.repeat(np.arange(len(start)), size), (x1 - x0) * (y1[after] - y0) - (x1[after] - x0) * (y1 - y0), len(start))
    ring_row = row[start]
    home = _homes(x1, y1, after, start, size, area, ring_row)
    known &= ~P._any_by(ring_row, (area == 0) | (home < 0), rows)
    good = np.flatnonzero(known[ring_row])
    good = good[np.lexsort((good, area[good] < 0, home[good]))]     # each shell, then its holes
    start, size, shell, ring_row = start[good], size[good], area[good] > 0, ring_row[good]
    closed = np.repeat(start, size + 1) + P._within_run(size + 1)
    closed[np.cumsum(size + 1) - 1] = start
    rings = np.diff(np.append(np.flatnonzero(shell), len(good)))
    return P.Shapes(x1[closed], y1[closed], size + 1, rings, np.bincount(ring_row[shell], minlength=rows)), known


def _lists(s: P.Shapes) -> pa.Array:
    xy = np.empty(2 * len(s.x))
    xy[0::2], xy[1::2] = s.x, s.y
    values = pa.array(xy)
    for counts in (np.full(len(s.x), 2), s.points, s.rings, s.parts):
        values = pa.ListArray.from_arrays(pa.array(P._starts(counts), pa.int32()), values)
    return values


def union_of(s: P.Shapes) -> pa.Array:
    """Parts of the union of each row's polygons; null where its boundary does not close."""
    e = Edges(s)
    if not len(e.row):
        return pa.nulls(e.rows, _DEEP)
    row, x1, y1, x2, y2 = _boundary(e)
    order = np.lexsort((y2, x2, y1, x1, row))
    row, x1, y1, x2, y2 = (c[order] for c in (row, x1, y1, x2, y2))
    shapes, known = _simple_rings(row, x1, y1, x2, y2, e.rows)
    others = np.flatnonzero(~known)
    at = np.searchsorted(row, others), np.searchsorted(row, others, side="right")
    traced = [trace_rings(list(zip(*(c[i:j].tolist() for c in (x1, y1, x2, y2))))) for i, j in zip(*at)]
    place = np.empty(e.rows, np.int64)
    place[known], place[others] = np.arange(known.sum()), known.sum() + np.arange(len(others))
    return pa.concat_arrays([_lists(shapes.take(known)), pa.array(traced, _DEEP)]).take(pa.array(place))


def _pieces(text: pa.Array):
    """Polygons of plain collections, points buffered: ``shapes`` of the rows with a true flag, ``flags``."""
    n = len(text)
    x, y, row, ring, part, tag, _, _, odd = P.parse(text)
    s, ring_at = P.shapes_of(x, y, row, ring, part, n)
    row_of_ring, kind = s.row_of_ring(), tag[ring_at] % 3
    point = kind == P._POINT
    size = np.bincount(row_of_ring, np.where(point, P._FULL, s.points), n)
    ready = ~odd & ~P._any_by(row_of_ring, kind == P._LINE, n) & (size <= EDGES)
    s, point = s.take(ready), point[ready[row_of_ring]]
    if len(s.points):
        wide = P._buffered(s, point)
        # Rounded like the circles of the joins; doubles beyond have no 13 decimals.
        round_ = np.repeat(point, wide.points)
        wide.x, wide.y = (np.where(round_ & (np.abs(c) < 512), np.round(c, 13), c) for c in (wide.x, wide.y))
        s = wide
    return s, ready


def _blocks(s: P.Shapes):
    """The shapes in runs of rows of about ``PAIRS`` pairs of points."""
    sizes = np.bincount(s.row_of_ring(), s.points, len(s.parts)).astype(np.int64)
    block = np.cumsum(sizes ** 2) // PAIRS
    row = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)]))
    part = P._starts(s.parts)[row]
    ring = P._starts(s.rings)[part]
    point = P._starts(s.points)[ring]
    for k in range(len(row) - 1):
        q, r, p, n = (slice(c[k], c[k + 1]) for c in (point, ring, part, row))
        if n.start < n.stop:
            yield P.Shapes(s.x[q], s.y[q], s.points[r], s.rings[p], s.parts[n])


def _union(text: pa.Array) -> pa.Array:
    place = np.full(len(text), -1)
    plain = pc.fill_null(pc.match_substring_regex(text, P._PLAIN), False).to_numpy(zero_copy_only=False)
    found = []
    if plain.any():
        s, ready = _pieces(text.filter(pa.array(plain)).cast(pa.string()))
        place[np.flatnonzero(plain)[ready]] = np.arange(ready.sum())
        found += [union_of(block) for block in _blocks(s)]
    found.append(pa.nulls(0, _DEEP))
    return pa.concat_arrays(found).take(pa.array(place, mask=place < 0))


def union_plain(wkt: Column) -> Column:
    """Parts of the union of a collection's members (points buffered); null where it is left to the joins."""
    def union(text: pa.Array) -> pa.Array:
        return _union(text)
    union.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(union, PARTS_TEXT)(F.when(F.length(wkt) <= P.LONGEST, wkt))


# Workers need no copy of the package: the functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
