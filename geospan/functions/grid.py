"""The grid join of edges (:mod:`geospan.operators.validity`) for small geometries, where their rows lie.

All edges of a geometry come out of one row, so those of a small one meet
within its batch: the same cells along an edge, the same join of edges that
share a cell, the same rays and touching points, as array operations over the
edges of many rows, and nothing is shuffled. Left to the joins:
more than ``EDGES`` points, rings that are empty, open or of fewer than three
edges, points that are not two finite numbers.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geospan.functions import plain as P

#: Geometries with more points than this are exploded and joined by many tasks.
EDGES = 256
#: Greater coordinates are left to the joins: products of four would not be finite.
FAR = 1e75
#: Copies of an edge in the grid: at most about this many on average, and two more.
COPIES = 8
#: A geometry of up to so many edges is one cell: its few pairs cost less than copies of its edges.
FEW = 24


def _cell_sizes(width, height, n, travel, reach):
    """``operators.validity._cell_size`` of each row."""
    span = np.maximum(width, height)
    size = np.maximum(np.maximum(span / np.ceil(np.sqrt(np.maximum(n, 1))), travel / (np.maximum(n, 1) * COPIES)), reach * 1e-11)
    return np.where(span <= 0, 1.0, np.where(n <= FEW, span * 2, size))


def cell_pairs(mine, n, x1, y1, x2, y2):
    """Pairs of edges of a row that share a cell of its grid (``operators.validity.grid_cells``); ``mine`` is the row of each edge."""
    counts = np.bincount(mine, minlength=n)
    if not len(mine) or counts.max() <= FEW:
        return P._pairs_of(counts)      # one cell each
    held = counts > 0
    first = P._starts(counts)[:-1][held]
    left, right, low, high = np.minimum(x1, x2), np.maximum(x1, x2), np.minimum(y1, y2), np.maximum(y1, y2)
    x0, y0, width, height, travel, reach = (np.zeros(n) for _ in range(6))
    x0[held], y0[held] = np.minimum.reduceat(left, first), np.minimum.reduceat(low, first)
    gx1, gy1 = np.maximum.reduceat(right, first), np.maximum.reduceat(high, first)
    width[held], height[held] = gx1 - x0[held], gy1 - y0[held]
    reach[held] = np.max(np.abs([x0[held], gx1, y0[held], gy1]), axis=0)
    travel[held] = np.add.reduceat(np.abs(x2 - x1) + np.abs(y2 - y1), first)
    size = _cell_sizes(width, height, counts, travel, reach)

    # The columns of cells that an edge passes, and in each the rows of its part there.
    def cell_of(v, v0, at):
        return np.floor((v - v0[mine[at]]) / size[mine[at]]).astype(np.int64)
    every = np.arange(len(mine))
    begin = cell_of(left, x0, every)
    columns = cell_of(right, x0, every) - begin + 1
    e = np.repeat(every, columns)
    cx = np.repeat(begin, columns) + P._within_run(columns)
    cell = size[mine[e]]
    from_x = x0[mine[e]] + cx * cell - cell * 1e-3
    dx = x2[e] - x1[e]
    with np.errstate(divide="ignore", invalid="ignore"):
        ends = [np.where(dx == 0, y, y1[e] + np.clip((x - x1[e]) / dx, 0.0, 1.0) * (y2[e] - y1[e])) for x, y in (
            (np.maximum(from_x, left[e]), y1[e]), (np.minimum(from_x + cell * 1.002, right[e]), y2[e]))]
    least, most = cell_of(low[e], y0, e), cell_of(high[e], y0, e)
    bottom = np.minimum(np.maximum(cell_of(np.minimum(*ends) - cell * 1e-3, y0, e), least), most)
    top = np.maximum(np.minimum(cell_of(np.maximum(*ends) + cell * 1e-3, y0, e), most), least)
    rows = top - bottom + 1
    copy = np.repeat(np.arange(len(e)), rows)
    cy = bottom[copy] + P._within_run(rows)
    e, cx = e[copy], cx[copy]
    # The join: edges in the order of their cells, pairs within each.
    order = np.lexsort((e, cy, cx, mine[e]))
    e, cx, cy = e[order], cx[order], cy[order]
    new = np.flatnonzero(np.concatenate(([True], (mine[e[1:]] != mine[e[:-1]]) | (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1]))))
    a, b = P._pairs_of(np.diff(np.append(new, len(e))))
    return e[a], e[b]


def _nested(parts: pa.ListArray):
    """The shapes of the rows that are decided here, and the flags of these rows."""
    n = len(parts)
    counts, values, nulls = [], parts, 0
    for _ in range(4):
        counts.append(values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        values = values.flatten()
        nulls += values.null_count
    by_row, by_part, by_ring, by_point = counts
    if nulls or (by_point != 2).any():
        return P.Shapes(np.zeros(0), np.zeros(0), *(np.zeros(0, np.int64) for _ in range(3))), np.zeros(n, bool)
    xy = values.to_numpy(zero_copy_only=False)
    s = P.Shapes(xy[0::2], xy[1::2], by_ring, by_part, by_row)
    ready = parts.is_valid().to_numpy(zero_copy_only=False) & (by_row > 0)
    ready[np.repeat(np.arange(n), by_row)[by_part == 0]] = False
    row = s.row_of_ring()
    ready[row[by_ring < 4]] = False
    far = ~((np.abs(s.x) < FAR) & (np.abs(s.y) < FAR))
    ready[np.repeat(row, by_ring)[far]] = False
    s = s.take(ready)
    if len(s.points):
        # A closed ring of three edges or more.
        at = P._starts(s.points)
        begin, end = at[:-1], at[1:] - 1
        odd = (s.x[begin] != s.x[end]) | (s.y[begin] != s.y[end]) | (P._edges(s)[2] < 3)
        if odd.any():
            keep = ~P._any_by(s.row_of_ring(), odd, len(s.parts))
            s = s.take(keep)
            ready[np.flatnonzero(ready)[~keep]] = False
    return s, ready


def _invalid(parts: pa.ListArray) -> pa.Array:
    s, ready = _nested(parts)
    bad = np.zeros(len(parts), bool)
    if len(s.parts):
        at = np.flatnonzero(ready)
        for block in P._pair_blocks(np.bincount(s.row_of_ring(), s.points, len(s.parts)).astype(np.int64)):
            bad[at[block]] = P._broken(s.between(block[0], block[-1] + 1), cell_pairs)
    return pa.array(bad, mask=~ready)


def points_in(parts: Column) -> Column:
    """The number of points of a geometry."""
    return F.aggregate(parts, F.lit(0), lambda n, rings: n + F.aggregate(rings, F.lit(0), lambda k, ring: k + F.size(ring)))


def invalid_small(df: DataFrame) -> DataFrame:
    """``gid, bad, parts`` of the small polygons (``gid, parts``) that break a rule of G04; ``bad`` is null, and ``parts`` kept, where that is left to the joins."""
    def decide(batches):
        for batch in batches:
            bad = _invalid(batch["parts"])
            keep = pc.fill_null(bad, True)
            parts = pc.if_else(bad.is_null(), batch["parts"], pa.scalar(None, batch["parts"].type))
            yield pa.RecordBatch.from_arrays([batch["gid"].filter(keep), bad.filter(keep), parts.filter(keep)], ["gid", "bad", "parts"])
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.filter(points_in(F.col("parts")) <= EDGES).mapInArrow(decide, f"gid {kinds['gid']}, bad boolean, parts {kinds['parts']}")


# Workers need no copy of the package: the functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
