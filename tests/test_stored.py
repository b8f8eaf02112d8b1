"""Intermediate tables are fixed files, smaller than checkpointed rows."""

import os

from pyspark.sql import functions as F

from frames import rows_of
from geospan.functions.plain import plain_geometry
from geospan.plans import catalog
from geospan.session import checkpoint_dir, stored


def _size(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_stored_rows_are_the_same_and_smaller_than_a_checkpoint(spark):
    folder = checkpoint_dir(spark).removeprefix("file:")
    df = rows_of(spark, [f"POLYGON (({k} 0, {k + 1} 0, {k + 1} 1, {k} 1, {k} 0))" for k in range(2000)]).coalesce(1).select(
        plain_geometry(F.col("wkt")).alias("g")).withColumn("_gid", F.monotonically_increasing_id())
    sizes = [_size(folder)]
    fixed = df.checkpoint()
    sizes.append(_size(folder))
    kept = stored(df)
    sizes.append(_size(folder))
    assert sizes[2] - sizes[1] < sizes[1] - sizes[0]
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, fixed.collect()))
    assert kept.schema.simpleString() == df.schema.simpleString()


def test_validity_join_keeps_its_rows_as_parquet(spark, monkeypatch):
    """Before, whole decoded rows lay in the checkpoint folder, at 2.5 times the bytes."""
    seen = []
    monkeypatch.setattr(catalog, "stored", lambda df: seen.append(df) or stored(df))
    out = catalog.bowtie_validity_join(spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and out.columns == ["l_orderkey", "l_linenumber", "kind", "valid"]


def test_small_geometries_are_one_cell(spark):
    """Before, an edge of a rectangle was copied to the three or four cells along it."""
    from geospan.operators.validity import edges_of, grid_cells, invalid_by_edges
    df = rows_of(spark, ["POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((0 0, 4 4, 4 0, 0 4, 0 0))"]).coalesce(1).select(
        "wkt", plain_geometry(F.col("wkt"), topology=False).alias("geometry"))
    edges = edges_of(df, "wkt")
    assert grid_cells(edges, ["gid"]).count() == edges.count() == 8
    assert [r.gid for r in invalid_by_edges(edges).collect()] == ["POLYGON ((0 0, 4 4, 4 0, 0 4, 0 0))"]
