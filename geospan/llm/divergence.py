"""Divergence of sources by a sparse merge for each pair of groups.

Texts are counted once: each task adds up, per language and source, how often
a term occurs and in how many documents. Terms that enough documents of their
language hold are kept and dealt by hash into buckets of bounded size, where
they get their ids; a group's counts become, bucket by bucket, an array of
(term id, count) sorted by id.

A pair task co-groups the arrays of the two groups of an unordered pair in one
bucket. A galloping intersection finds the terms of both; these, the terms of
one side and, by their number alone, the terms of neither are priced, each in
the one group and in the other, so that a pair is merged once and its value
serves both ways.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geospan.llm.common import as_bytes, map_rows_with, stored

SCALE, SMOOTH = 1_000_000_000, 5
#: Bytes of a term stay (A-Z lower-cased), all others become a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Most (group, term) entries that a task holds before it hands them on; bytes of a text that are split at once.
HELD, STRETCH = 400_000, 1 << 20


def term_counts(text: bytes) -> Counter:
    """Terms of a whole UTF-8 text and how often they occur, split stretch by stretch."""
    text = text.translate(TERM_BYTES)
    if len(text) <= STRETCH:
        return Counter(text.split())
    out, start = Counter(), 0
    while start < len(text):
        end = text.find(b" ", start + STRETCH)
        end = len(text) if end < 0 else end
        out.update(text[start:end].split())
        start = end
    return out


class _GroupCounts:
    """Adds up documents and occurrences of terms by group within a task; hands on what exceeds ``HELD``."""

    def __init__(self):
        self.held, self.size = {}, 0

    def __call__(self, rows):
        for lang, source, text in rows:
            group = self.held.setdefault((lang, source), {})
            before = len(group)
            for term, n in term_counts(text).items():
                if (at := group.get(term)) is None:
                    group[term] = [1, n]
                else:
                    at[0] += 1
                    at[1] += n
            self.size += len(group) - before
        return self.finish() if self.size > HELD else []

    def finish(self):
        rows = []
        for (lang, source), group in self.held.items():
            rows.append((lang, source, "", 0, 0))
            rows.extend((lang, source, term.decode("utf-8", "replace"), d, n) for term, (d, n) in group.items())
        self.held, self.size = {}, 0
        return rows


def group_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, term, docs, n``; the empty term of each group, with zeros, says that the group occurs."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), as_bytes(text_col).alias("text"))
    parts = map_rows_with(texts, _GroupCounts, "lang string, source string, term string, docs long, n long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def price(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + 5) / (total + 5 terms)), exact while counts fit 19 digits."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)")
    return F.call_function("div", whole, (total + SMOOTH * terms).cast("decimal(20,0)")) + 1


def prices(counts: np.ndarray, weight: int) -> np.ndarray:
    """The same for arrays of counts, ``weight`` being the group's total + 5 terms."""
    if len(counts) and int(counts.max()) + SMOOTH > (2**63 - 1) // SCALE:
        return np.array([1 + SCALE * (int(c) + SMOOTH) // weight for c in counts], np.int64)
    return 1 + SCALE * (counts.astype(np.int64) + SMOOTH) // weight


def gallop(needles: np.ndarray, hay: np.ndarray) -> np.ndarray:
    """First position in sorted ``hay`` not below each of the sorted ``needles``, by galloping.

    Every 32nd needle is placed by bisection; from the place of its
    forerunner each other needle doubles its step until it has passed its
    place, then bisects the last step. All needles of an array go together.
    """
    low = np.repeat(np.searchsorted(hay, needles[::32]), 32)[:len(needles)]
    step, high = 1, low.copy()
    ahead = np.flatnonzero(high < len(hay))
    ahead = ahead[hay[high[ahead]] < needles[ahead]]
    while len(ahead):
        low[ahead] = high[ahead] + 1
        high[ahead] = np.minimum(high[ahead] + step, len(hay))
        step *= 2
        ahead = ahead[high[ahead] < len(hay)]
        ahead = ahead[hay[high[ahead]] < needles[ahead]]
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_]) >> 1
        below = hay[mid] < needles[open_]
        low[open_[below]] = mid[below] + 1
        high[open_[~below]] = mid[~below]
    return low


def merge_pair(ids_a: np.ndarray, counts_a: np.ndarray, weight_a: int,
               ids_b: np.ndarray, counts_b: np.ndarray, weight_b: int) -> tuple[int, int]:
    """Sum of |p - q| over the terms that either group has, and the number of these terms."""
    if len(ids_a) > len(ids_b):
        ids_a, counts_a, weight_a, ids_b, counts_b, weight_b = ids_b, counts_b, weight_b, ids_a, counts_a, weight_a
    none_a, none_b = 1 + SCALE * SMOOTH // weight_a, 1 + SCALE * SMOOTH // weight_b
    at = gallop(ids_a, ids_b)
    found = at < len(ids_b)
    found[found] = ids_b[at[found]] == ids_a[found]
    p, q = prices(counts_a, weight_a), prices(counts_b, weight_b)
    only_b = np.ones(len(ids_b), bool)
    only_b[at[found]] = False
    value = (int(np.abs(p[found] - q[at[found]]).sum()) + int(np.abs(p[~found] - none_b).sum())
             + int(np.abs(q[only_b] - none_a).sum()))
    return value, len(ids_a) + len(ids_b) - int(found.sum())


def audit_sources(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
                  least_docs: int = 30, top_terms: int = 50, bucket_terms: int = 16_384) -> DataFrame:
    """``lang, source, part, item, value, rank``: see the module and the two parts.

    ``pair``: every other source of the language with the summed distance of the
    two groups over all kept terms (0 where the language keeps none).
    ``term``: the group's terms that it uses more than its language, the
    ``top_terms`` of the greatest distance. Ranks go by value, then by the
    item's UTF-8 bytes; no two items of a group are equal, so there are no ties.

    Null lang, source and text count as empty. Each repeated row is a document of
    its own. A very long text is split stretch by stretch, whole. An empty table
    gives an empty result. Further columns are not read, so none can clash.
    """
    counts = stored(group_terms(docs, lang_col, source_col, text_col))
    terms = (counts.filter("term <> ''").groupBy("lang", "term")
             .agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= least_docs))
    totals = stored(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total")))
    widest = totals.agg(F.max("terms")).first()[0] or 0
    buckets = max(1, math.ceil(widest / bucket_terms))
    ranked = Window.partitionBy("lang", "bucket").orderBy("term")
    terms = terms.withColumn("bucket", (F.pmod(F.xxhash64("term"), F.lit(buckets))).cast("int")).withColumn(
        "id", F.row_number().over(ranked)).select("lang", "term", "lang_n", "bucket", "id")
    held = stored(counts.filter("term <> ''").drop("docs").join(terms, ["lang", "term"]))
    groups = stored(counts.select("lang", "source").distinct().join(totals, "lang", "left").join(
        held.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .select("lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"),
                F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("lang_total", F.lit(0)).alias("lang_total")))
    return _pairs(held, groups).unionByName(_terms(held, groups, top_terms))


def _terms(held: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    value = price(F.col("n"), F.col("total"), F.col("terms")) - price(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (held.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"),
                                                         F.col("term").alias("item"), value.alias("value"))
            .filter("value > 0").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top))


def _pairs(held: DataFrame, groups: DataFrame) -> DataFrame:
    a, b = (groups.select("lang", F.col("source").alias(s), "terms", (F.col("total") + SMOOTH * F.col("terms")).alias(f"weight_{s}"))
            for s in "ab")
    pairs = stored(a.join(b.drop("terms"), "lang").filter("a < b"))
    vectors = (held.groupBy("lang", "source", "bucket")
               .agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("v"))
               .select("lang", "source", "bucket", F.col("v.id").alias("ids"), F.col("v.n").alias("counts")))
    vectors = stored(vectors)
    sides = [pairs.filter("terms > 0").join(vectors.withColumnRenamed("source", s), ["lang", s])
             .select(*(F.col(c).alias(c) for c in ("lang", "a", "b", "bucket", "weight_a", "weight_b", "ids", "counts")))
             .groupBy("lang", "a", "b", "bucket")
             for s in "ab"]

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        some = left if left.num_rows else right
        lang, first, second, weight_a, weight_b = (some[c][0].as_py() for c in ("lang", "a", "b", "weight_a", "weight_b"))
        arrays = [t[c][0].values.to_numpy() if t.num_rows else np.zeros(0, np.int64)
                  for t in (left, right) for c in ("ids", "counts")]
        value, seen = merge_pair(arrays[0], arrays[1], weight_a, arrays[2], arrays[3], weight_b)
        return pa.table({"lang": [lang], "a": [first], "b": [second], "value": [value], "seen": [seen]},
                        schema=pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()),
                                          ("value", pa.int64()), ("seen", pa.int64())]))

    merged = (sides[0].cogroup(sides[1]).applyInArrow(merge, "lang string, a string, b string, value long, seen long")
              .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen")))
    zero = F.lit(0)
    nil = F.lit(SCALE * SMOOTH)
    absent = F.abs(F.call_function("div", nil, F.col("weight_a")) - F.call_function("div", nil, F.col("weight_b")))
    value = F.when(F.col("terms") > 0, F.coalesce("value", zero) + (F.col("terms") - F.coalesce("seen", zero)) * absent)
    both = stored(pairs.join(merged, ["lang", "a", "b"], "left").select("lang", "a", "b", F.coalesce(value, zero).alias("value")))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ways = [both.select("lang", F.col(s).alias("source"), F.lit("pair").alias("part"), F.col(t).alias("item"), "value")
            for s, t in ("ab", "ba")]
    return ways[0].unionByName(ways[1]).withColumn("rank", F.row_number().over(best))
