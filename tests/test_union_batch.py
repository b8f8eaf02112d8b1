"""The union of small collections: rings by the batch as they are traced, and no text parsed again but for those left."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from frames import rows_of
from geospan.functions import geometry as G
from geospan.functions import union as U
from geospan.operators import overlay
from geospan.operators.layer import with_geometry
from geospan.session import stored


def _polygon(rng):
    x, y, w, h = rng.randint(0, 8), rng.randint(0, 8), rng.randint(1, 5), rng.randint(1, 5)
    ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)] if rng.random() < 0.7 else [(x, y), (x + w, y + 1), (x + 1, y + h + 1)]
    rings = [ring] + ([[(x + 0.25, y + 0.25), (x + 0.5, y + 0.25), (x + 0.5, y + 0.5)]] if rng.random() < 0.5 and len(ring) == 4 else [])
    return "(" + ", ".join("(" + ", ".join(f"{a} {b}" for a, b in [*r, r[0]]) + ")" for r in rings) + ")"


def _collections(n):
    rng = random.Random(12)
    return [f"GEOMETRYCOLLECTION (POLYGON {_polygon(rng)}, POINT ({rng.randint(0, 9)} {rng.randint(0, 9)}), MULTIPOLYGON ("
            + ", ".join(_polygon(rng) for _ in range(rng.randint(1, 4))) + "))" for _ in range(n)]


def test_holes_and_touching_corners_are_traced_by_the_batch(monkeypatch):
    """Before, each geometry with a hole or a vertex of two rings was traced edge by edge in a Python loop."""
    text, traced, trace, simple = pa.array(_collections(800)), [], U.trace_rings, U._simple_rings
    monkeypatch.setattr(U, "trace_rings", lambda edges: traced.append(edges) or trace(edges))
    got = U._union(text)
    few = len(traced)

    def none_known(*boundary):
        shapes, known = simple(*boundary)
        return shapes, known & False
    monkeypatch.setattr(U, "_simple_rings", none_known)
    assert got.equals(U._union(text)) and len(traced) == few + len(text)
    assert few < 80 and sum(len(part) > 1 for parts in got.to_pylist() if parts for part in parts) > 200


def test_only_collections_left_to_the_joins_are_parsed_again(spark, monkeypatch):
    """Before, a filter derived from the explode of the pieces parsed the text of every row, decided or not."""
    square, seen, dissolve = "POLYGON ((3 3, 5 3, 5 5, 3 5, 3 3))", [], overlay.dissolve
    monkeypatch.setattr(overlay, "dissolve", lambda pieces: seen.append(pieces) or dissolve(pieces))
    texts = [f"GEOMETRYCOLLECTION ({square}, POINT ({k} {k}))" for k in (3, 4, 5)] + [f"GEOMETRYCOLLECTION ({square}, LINESTRING (2 2, 4 4))"]
    rows = with_geometry(rows_of(spark, texts).coalesce(1), "wkt", drop_wkt=False).withColumn("key", F.monotonically_increasing_id())
    done = overlay.dissolve_mixed(stored(rows), "wkt", "key").select("key", "reject_reason", G.area(F.col("geometry")).alias("area")).collect()
    assert [r.reject_reason for r in done] == [None] * 4 and all(4 <= r.area < 4.001 for r in done)
    assert [r.key for r in spark.read.parquet(*seen[0].inputFiles()).select("key").collect()] == [3]
