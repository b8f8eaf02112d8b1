"""Exact dedup by a heavy-hitter split, in DataFrame functions only.

Texts are equal when identical after lower-casing A-Z. Frequent digests are
found by Spark's frequent-items sketch (``approx_top_k``, a mergeable
Misra-Gries summary with a fixed number of counters); their exact sizes and
winners are then verified by a map-side combined aggregate, and that table,
bounded by ``heavy_groups`` rows, is broadcast, so rows of a hot group never
meet in one task. The remaining digests are shuffled the ordinary way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geospan.llm.common import fold_ascii, stored

SKETCH_GROUPS = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 8192,
                heavy_groups: int = 1000, heavy_rows: int = 100) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Null text counts as empty. Of equal texts the largest id stays; rows that
    repeat id and text are one document and stay together; a null id stays
    only where its whole group has none. An empty table gives an empty one.
    ``counters`` bounds each sketch, ``heavy_groups`` the broadcast table and
    ``heavy_rows`` is the least size of a group that is taken as heavy: any
    group outside the broadcast table has at most rows / (0.75 * counters)
    rows, or is not among the ``heavy_groups`` largest.
    """
    digests = stored(docs.select(F.col(id_col).alias("id"),
                                 F.unhex(F.sha2(fold_ascii(F.col(text_col)), 256)).alias("digest")))
    winners = stored(_heavy(digests, counters, heavy_groups, heavy_rows))
    tagged = digests.join(F.broadcast(winners), "digest", "left")
    heavy = tagged.filter("group_size is not null")
    same = Window.partitionBy("digest")
    light = (tagged.filter("group_size is null").select("digest", "id")
             .withColumn("keep_id", F.max("id").over(same))
             .withColumn("group_size", F.count(F.lit(1)).over(same)))
    return heavy.select("digest", "id", "keep_id", "group_size").unionByName(light).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def _heavy(digests: DataFrame, counters: int, heavy_groups: int, heavy_rows: int) -> DataFrame:
    """Verified heavy digests: ``digest, keep_id, group_size``, at most ``heavy_groups`` rows."""
    key = F.xxhash64("digest").alias("key")
    found = (digests.select(key, (F.spark_partition_id() % SKETCH_GROUPS).alias("part"))
             .groupBy("part").agg(F.expr(f"approx_top_k_accumulate(key, {counters})").alias("sketch"))
             .groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {counters})").alias("sketch"))
             .select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {heavy_groups})")).alias("hit"))
             .filter(F.col("hit.count") >= heavy_rows).select(F.col("hit.item").alias("key")))
    return (digests.withColumn("key", F.xxhash64("digest")).join(F.broadcast(found), "key", "left_semi")
            .groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .filter(F.col("group_size") >= heavy_rows))
