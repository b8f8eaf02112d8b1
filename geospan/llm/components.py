"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geospan.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``id, root``: the least id of the component of every id in ``edges(a, b)``.

    Each round is a map-side combined minimum and an equi-join, whose hot keys
    adaptive execution can split; nothing passes through the driver but a
    checksum of the edges, which tells when a round has changed nothing.
    """
    links = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
                   .distinct())
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.filter("v <> u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        links = stored(small.filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
                       .unionByName(small.select("v", F.col("m").alias("u"))).distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return links.select(F.col("v").alias("id"), F.col("u").alias("root")).unionByName(
        links.select(F.col("u").alias("id"), F.col("u").alias("root"))).distinct()
