"""Substring dedup with prefix-partitioned suffix trees.

Every window of ``window`` words contains the ``anchor`` consecutive words
whose hash is least in it, wherever that window stands. Suffixes are therefore
partitioned by such anchors, their prefix: equal windows always meet in one
group. Anchors that occur in one document only cannot be part of a repeat and
go first. What remains carries its surrounding words into memory-sized groups
of prefixes, in each of which the suffixes are sorted; neighbours that agree on
``window`` words or more form the deep internal nodes of that subtree, whose
smallest document keeps its copy. Prefixes too frequent for one group are
lengthened to the whole window and combined on the map side instead.

Subtrees are cut off at a depth of ``window`` words: which documents share a
window is known there, and longer maximal repeats are unions of such windows.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geospan.llm.common import as_bytes, map_rows, stored

MULT = np.uint64(0x9E3779B97F4A7C15)


def word_codes(words: list[bytes]) -> np.ndarray:
    """A 64-bit code for each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchor_hashes(codes: np.ndarray, anchor: int) -> np.ndarray:
    """Hash of the ``anchor`` words from each position on."""
    n = max(len(codes) - anchor + 1, 0)
    g = np.zeros(n, np.uint64)
    for j in range(anchor):
        g = (g ^ codes[j:j + n]) * MULT
        g ^= g >> np.uint64(29)
    return g


def anchor_runs(hashes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor position, first and last window start it leads; ``span`` anchors start in a window.

    The leftmost least hash of a window leads it.
    """
    n = len(hashes) - span + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    best = np.arange(n)
    for j in range(1, span):
        other = np.arange(j, j + n)
        best = np.where(hashes[other] < hashes[best], other, best)
    first = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
    return best[first], first, np.r_[first[1:] - 1, n - 1]


def suffix_bytes(codes: np.ndarray) -> np.ndarray:
    """32-bit big-endian words: their byte order is the order of the codes."""
    return (codes >> np.uint64(32)).astype(">u4")


def deep_nodes(suffixes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix (a row of words) its node at full depth and that node's least document.

    Suffixes are sorted; a neighbour that shares all words (a common prefix as
    long as the rows) lies below the same internal node.
    """
    key = np.ascontiguousarray(suffixes).view(f"S{suffixes.shape[1] * 4}").ravel()
    order = np.argsort(key, kind="stable")
    ranked = suffixes[order]
    fresh = np.r_[True, (ranked[1:] != ranked[:-1]).any(axis=1)]
    least = np.minimum.reduceat(doc[order], np.flatnonzero(fresh))
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(fresh) - 1
    return node, least[node]


def _spread(rows: DataFrame, key: str, heavy_rows: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose key has at most ``heavy_rows`` rows, and the others."""
    heavy = (rows.groupBy(F.spark_partition_id().alias("part"))
             .agg(F.expr(f"approx_top_k_accumulate({key}, 16384)").alias("s")).groupBy(F.lit(0).alias("all"))
             .agg(F.expr("approx_top_k_combine(s, 16384)").alias("s"))
             .select(F.explode(F.expr("approx_top_k_estimate(s, 2000)")).alias("hit"))
             .filter(F.col("hit.count") > heavy_rows).select(F.col("hit.item").alias(key)))
    heavy = F.broadcast(stored(heavy))  # 2,000 keys at most
    return rows.join(heavy, key, "left_anti"), rows.join(heavy, key, "left_semi")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13,
                   anchor: int = 6, group_rows: int = 40_000, heavy_rows: int = 20_000) -> DataFrame:
    """``id, spans``: the words (start, stop) covered by windows that a document with a smaller id has too.

    Words are split at ASCII white space, unchanged. Documents without such
    words have no row; so have null ids, null, empty and short texts. Repeats
    inside one document alone don't count; rows that share an id are one
    document in this respect. Spans are maximal and sorted.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), as_bytes(text_col).alias("text"))
    span = window - anchor + 1

    def anchors(rows):
        out = []
        for key, text in rows:
            hashes = anchor_hashes(word_codes(text.split()), anchor)
            out.append((key, hashes[anchor_runs(hashes, span)[0]].view(np.int64).tolist()))
        return out

    # 1. Anchors that two documents share.
    rows = stored(map_rows(texts, anchors, f"id {id_type}, anchors array<long>")
                  .select("id", F.explode(F.array_distinct("anchors")).alias("a")))
    light, heavy = _spread(rows, "a", heavy_rows)
    parted = light.repartition("a")  # one exchange for the grouping and the join
    shared = parted.groupBy("a").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("a")
    wide = heavy.groupBy("a").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("a")
    keep = parted.join(shared, "a", "left_semi").unionByName(heavy.join(F.broadcast(wide), "a", "left_semi"))
    per_doc = stored(keep.groupBy("id").agg(F.collect_set("a").alias("anchors")))

    # 2. The words around those anchors.
    def contexts(rows):
        out = []
        for key, text, chosen in rows:
            codes = word_codes(text.split())
            hashes = anchor_hashes(codes, anchor)
            pos, first, last = anchor_runs(hashes, span)
            of = hashes[pos].view(np.int64)
            hit = np.flatnonzero(np.isin(of, np.array(chosen, np.int64)))
            words = suffix_bytes(codes)
            for i in hit.tolist():
                a, b = int(first[i]), int(last[i])
                out.append((int(of[i]), key, a, int(pos[i]) - a, words[a:b + window].tobytes()))
        return out

    around = map_rows(texts.join(per_doc, "id"), contexts,
                      f"a long, id {id_type}, start int, lead int, words binary", rows_per_step=128)
    around = stored(around)
    n = around.count()
    few, many = _spread(around.select("a", "id", "start", "words"), "a", heavy_rows)

    # 3. Memory-sized groups of prefixes, one subtree each.
    groups = max(1, -(-n // group_rows))

    def subtree(table):
        import pyarrow as pa
        ids, starts = table["id"].to_numpy(), table["start"].to_numpy().astype(np.int64)
        words = [np.frombuffer(w, ">u4") for w in table["words"].to_pylist()]
        count = np.array([len(w) - window + 1 for w in words])
        row = np.repeat(np.arange(len(words)), count)
        off = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        base = np.cumsum([0] + [len(w) for w in words[:-1]])
        flat = np.concatenate(words)
        suffixes = flat[(base[row] + off)[:, None] + np.arange(window)]
        _, least = deep_nodes(suffixes, ids[row])
        hit = least < ids[row]
        return pa.table({"id": pa.array(ids[row][hit], type=table.schema.field("id").type),
                         "at": pa.array((starts[row] + off)[hit].astype(np.int32))})

    light_hits = (few.withColumn("group", F.pmod(F.xxhash64("a"), F.lit(groups))).groupBy("group")
                  .applyInArrow(subtree, f"id {id_type}, at int"))

    # 4. Too frequent prefixes: the prefix becomes the whole window.
    def windows(rows):
        return [(key, start + i, w[4 * i:4 * (i + window)]) for _, key, start, w in rows
                for i in range(len(w) // 4 - window + 1)]
    whole = map_rows(many, windows, f"id {id_type}, at int, suffix binary")
    least = whole.groupBy("suffix").agg(F.min("id").alias("least"))
    heavy_hits = whole.join(least, "suffix").filter("least < id").select("id", "at")

    covered = light_hits.unionByName(heavy_hits).groupBy("id").agg(F.sort_array(F.collect_set("at")).alias("at"))

    def merge(rows):
        out = []
        for key, at in rows:
            at = np.array(at)
            cut = np.flatnonzero(np.diff(at) > window)
            out.append((key, [{"start": int(a), "stop": int(b) + window}
                              for a, b in zip(at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]])]))
        return out
    return map_rows(covered, merge, f"id {id_type}, spans array<struct<start:int,stop:int>>")


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_removed, kept_text`` of every document, its spans of words cut out.

    Words that stay are joined by one space. ``spans``: ``id, spans``.
    """
    def cut(rows):
        out = []
        for key, text, found in rows:
            words = text.split()
            keep, at = [], 0
            for s in found or ():
                keep += words[at:s["start"]]
                at = s["stop"]
            keep += words[at:]
            out.append((key, len(words), len(words) - len(keep), b" ".join(keep).decode("utf-8", "replace")))
        return out
    texts = docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("text"))
    return map_rows(texts.join(stored(spans), "id", "left"), cut,
                    f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept_text string")
