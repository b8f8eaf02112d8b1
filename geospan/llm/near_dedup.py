"""Near-dedup by order min-hashing.

Each document's shingles of ``k`` words are labelled with their occurrence
number; each of ``sketches`` hash functions picks the ``least`` smallest and
keeps them in the order of the text. Documents that agree in one such tuple
are candidates, which a banded alignment of their shingle sequences verifies:
similarity is the number of aligned shingles over that of all shingles of
both, so that moved text does not count as shared.

Exact copies (equal words) are folded into one representative first. In a
bucket every member meets the least member. Members outside its class then
become leaders, some at first and many times as many in each further round,
and meet all members of other classes; classes are merged after each round, so
that a bucket is left as soon as it is one class, and what the links of a dense
group would repeat is never formed. A pair of one class needs no link, every
other pair of a bucket meets when one of the two leads, so no link is lost.
Pairs are formed only where bitmaps of the two shingle sets allow the
similarity: each bit is the parity of the shingles hashed to it, so bits that
differ are never more than shingles that differ, and the test drops no true
pair. Members of a large bucket are dealt over several tasks, to each of which
its leaders are copied.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geospan.llm.common import as_bytes, map_rows, stored
from geospan.llm.components import components
from geospan.llm.substring_dedup import MULT, anchor_hashes, word_codes

BITS = 1024
#: Longest texts, in shingles, whose candidates are found by keys of all but one shingle too.
SHORT = 9
#: Rows of a bucket that one task holds against its leaders; growth of the number of leaders by round.
DEALT, GROWTH = 1024, 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, k: int) -> np.ndarray:
    """Codes of the ``k``-word shingles; a shorter text is one shingle, a wordless text has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return anchor_hashes(word_codes(words), min(k, len(words)))


def labelled(codes: np.ndarray) -> np.ndarray:
    """Codes mixed with the number of equal codes before them."""
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    start = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(codes) else np.zeros(0, int)
    size = np.diff(np.r_[start, len(codes)])
    nth = np.empty(len(codes), np.uint64)
    nth[order] = np.arange(len(codes)) - np.repeat(start, size)
    return mix(codes + nth * MULT)


def order_sketch(codes: np.ndarray, seeds: np.ndarray, least: int) -> np.ndarray:
    """One hash per seed of its ``least`` smallest labelled shingles in text order."""
    tagged = labelled(codes)
    if len(tagged) <= least:
        picked = np.broadcast_to(np.arange(len(tagged)), (len(seeds), len(tagged)))
    else:
        picked = np.sort(np.argpartition(mix(tagged[None, :] ^ seeds[:, None]), least - 1, axis=1)[:, :least], axis=1)
    out = seeds.copy()
    for j in range(picked.shape[1]):
        out = mix(out * MULT ^ tagged[picked[:, j]])
    return out


def short_keys(codes: np.ndarray) -> np.ndarray:
    """Keys that two similar texts of at most ``SHORT`` shingles are sure to share.

    At these lengths a similarity of 0.8 or more leaves out one shingle of a text
    at most: the keys are those of the whole sequence and of all but one shingle.
    """
    if not 4 <= len(codes) <= SHORT:
        return np.zeros(0, np.uint64)
    out = np.full(len(codes) + 1, MULT, np.uint64)
    for i, code in enumerate(codes):
        stays = np.arange(len(out)) != i
        out[stays] = mix(out[stays] * MULT ^ code)
    return out


def parity_bitmap(codes: np.ndarray) -> np.ndarray:
    """``BITS`` bits as 64-bit integers: how often, modulo 2, a labelled shingle falls on each."""
    odd = np.bincount((labelled(codes) >> np.uint64(20)) % np.uint64(BITS), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def aligned_within(x: np.ndarray, y: np.ndarray, slack: int) -> int:
    """Longest common subsequence of alignments that stay within ``slack`` of the diagonal.

    Bit-parallel: a column is one integer, in which only the band's cells may match.
    """
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    a = int(differ[0]) if len(differ) else n
    x, y = x[a:], y[a:]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[::-1][:n] != y[::-1][:n])
    b = int(differ[0]) if len(differ) else n
    x, y = x[:len(x) - b], y[:len(y) - b]
    at: dict[int, int] = {}
    for i, c in enumerate(x.tolist()):
        at[c] = at.get(c, 0) | 1 << i
    free = full = (1 << len(x)) - 1
    band = (1 << 2 * slack + 1) - 1
    for i, c in enumerate(y.tolist()):
        if c in at:
            match = at[c] & (band << i - slack if i > slack else band >> slack - i) & free
            free = (free + match | free - match) & full
    return a + b + len(x) - free.bit_count()


def needed(n: int, m: int, similarity: float) -> int:
    """The least number of shared shingles at which sequences of these lengths are similar."""
    return math.ceil(similarity * (n + m) / (1 + similarity) - 1e-9)


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Aligned shingles over all shingles >= ``similarity``."""
    need = needed(len(x), len(y), similarity)
    if not len(x) or not len(y) or min(len(x), len(y)) < need:
        return False
    if len(np.intersect1d(labelled(x), labelled(y), assume_unique=True)) < need:
        return False
    return aligned_within(x, y, len(x) + len(y) - 2 * need) >= need


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                 similarity: float = 0.8, sketches: int = 24, least: int = 4) -> DataFrame:
    """One row per input row: id, ``copy_of`` (least id of equal words), ``class_id``, ``kept``.

    Words are split at ASCII white space, A-Z lower-cased. ``class_id`` is the
    least id of all documents linked, directly or through others; one document
    of each class, ``class_id``, is kept. Texts without words (null, empty,
    blank) are copies of each other and link to nothing else. A very long text
    is compared whole. Repeated rows are copies; rows that share an id but not
    the text have the class of their own text, and links of either text are
    links of the id. Rows with a null id form a class each (class null, kept).
    Ties are settled by the least id. An empty table gives an empty one. Only id
    and text are read, so further columns cannot clash.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("text"))
    seeds = mix(np.arange(1, sketches + 1, dtype=np.uint64) * MULT)

    def sketch(rows):
        out = []
        for key, text in rows:
            codes = shingles(text, k)
            digest = xxhash.xxh3_128_digest(b" ".join(text.lower().split()))
            tuples = np.r_[order_sketch(codes, seeds, least), short_keys(codes)].view(np.int64).tolist() if len(codes) else []
            out.append((key, digest, len(codes), parity_bitmap(codes).tolist(), tuples))
        return out

    base = stored(map_rows(texts, sketch, f"id {kind}, digest binary, n int, bits array<long>, tuples array<long>"))
    known = base.filter("id is not null").select("id", "digest")
    reps = stored(known.groupBy("digest").agg(F.min("id").alias("rep")))
    of = known.join(reps, "digest").select("id", "rep")
    alone = base.join(reps, (base.id == reps.rep) & (base.digest == reps.digest), "left_semi").dropDuplicates(["id", "digest"])
    buckets = stored(alone.select("id", F.explode(F.array_distinct("tuples")).alias("bucket")).distinct())
    shared = buckets.groupBy("bucket").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    shape = alone.select("id", "n", "bits", "tuples")
    members = stored(buckets.join(shared, "bucket").join(shape, "id").withColumn(
        "deal", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / DEALT)).cast("int")))

    roots = stored(members.select("id", F.col("id").alias("root")).distinct())
    leads, many = members.filter("id = lead"), 1
    done = None
    while True:
        edges = stored(_links(texts, leads, members, roots, kind, k, similarity))
        merged = stored(components(edges))
        roots = stored(roots.join(merged.select(F.col("id").alias("root"), F.col("root").alias("now")), "root", "left")
                       .select("id", F.coalesce("now", "root").alias("root")))
        heads = members.filter("id = lead").join(roots, "id").select("bucket", F.col("root").alias("lead_root"))
        apart = members.join(roots, "id").join(heads, "bucket").filter("root <> lead_root").drop("root", "lead_root")
        if done is not None:
            apart = apart.join(done, ["bucket", "id"], "left_anti")
        many *= GROWTH
        turn = F.row_number().over(Window.partitionBy("bucket").orderBy("id"))
        leads = stored(apart.withColumn("turn", turn).filter(F.col("turn") <= many).drop("turn"))
        if leads.isEmpty():
            break
        led = leads.select("bucket", "id")
        done = led if done is None else done.unionByName(led)
        members = stored(members.join(led.select("bucket").distinct(), "bucket", "left_semi"))
    out = of.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select(
        "id", F.col("rep").alias("copy_of"), F.coalesce("root", "rep").alias("class_id"))
    nameless = base.filter("id is null").select("id", F.col("id").alias("copy_of"), F.col("id").alias("class_id"))
    return out.unionByName(nameless).select(F.col("id").alias(id_col), "copy_of", "class_id",
                                            F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def _links(texts: DataFrame, leads: DataFrame, members: DataFrame, roots: DataFrame, kind: str, k: int,
           similarity: float) -> DataFrame:
    """Links between classes: the roots ``a, b`` of leaders and members of their buckets that are similar."""
    # A leader's row goes to each task that holds members of its bucket.
    first = leads.join(roots, "id").withColumn("deal", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / DEALT) - 1).cast("int"))))
    rest = members.join(roots, "id").select("bucket", "deal", *(F.col(c).alias(f"{c}2") for c in ("id", "n", "bits", "tuples", "root")))
    # But for the first round, a pair that shares several buckets is formed in the least of them only: there too
    # one of the two leads in the end, or they are of one class.
    once = (F.col("id") == F.col("lead")) | (F.array_min(F.array_intersect("tuples", "tuples2")) == F.col("bucket"))
    pairs = (first.join(rest, ["bucket", "deal"]).filter((F.col("root") != F.col("root2")) & _may_match(similarity) & once)
             .select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct())
    found = _verified(texts, pairs, kind, k, similarity)
    ends = [roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
    return found.join(ends[0], "a").join(ends[1], "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()


def _may_match(similarity: float):
    """Whether ``n, bits`` and ``n2, bits2`` leave room for enough shared shingles (never drops a true pair)."""
    differ = F.aggregate(F.zip_with("bits", "bits2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0),
                         lambda total, x: total + x)
    total = F.col("n") + F.col("n2")
    most = total - 2 * F.ceil(similarity * total / (1 + similarity) - 1e-9)
    return (F.abs(F.col("n") - F.col("n2")) <= most) & (differ <= most)


def _verified(texts: DataFrame, pairs: DataFrame, kind: str, k: int, similarity: float) -> DataFrame:
    """The pairs ``a, b`` that the alignment accepts."""
    pairs = stored(pairs)
    wanted = stored(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    texts = stored(texts.join(wanted, "id", "left_semi"))
    left, right = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")

    def align(rows):
        out, held = [], (None, None)
        for a, b, x, y in rows:
            if held[0] != a:
                held = a, shingles(x, k)
            if similar(held[1], shingles(y, k), similarity):
                out.append((a, b))
        return out
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return map_rows(both, align, f"a {kind}, b {kind}", rows_per_step=32)
