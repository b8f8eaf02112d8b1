"""Benchmark decontamination by a distributed positional inverted index.

Test items are cut into windows of consecutive words. Training frequencies of
the test terms are counted over all documents; each window is then looked up
by its two rarest terms: their postings (document, position) are stored, and
the two offset-adjusted lists are intersected by an equi-join. The few
documents that remain are compared word by word, which gives exact matches.

Test terms are handled in blocks of at most ``block_windows`` windows, so what
is sent to every task is bounded however large the test set is.
"""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geospan.llm.common import as_bytes, map_rows_with, stored

#: A-Z become a-z; other ASCII bytes outside 0-9 and a-z become a space; UTF-8 bytes from 0x80 stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters."""
    return text.translate(WORD_BYTES).split()


def term_counts(docs: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """Occurrences of each of ``terms`` (a bounded set) in all documents ``(id, text)``."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(terms)

    def make():
        count: Counter = Counter()
        keep = wanted.value

        def step(rows):
            for (text,) in rows:
                count.update(w for w in words_of(text) if w in keep)
            return []
        step.finish = lambda: list(count.items())
        return step
    found = map_rows_with(docs.select("text"), make, "term binary, n long")
    return {bytes(r.term): r.n for r in found.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}


def forward_index(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """``id, n_words, terms, positions`` of every document: its positions of the numbered ``terms``."""
    numbered = docs.sparkSession.sparkContext.broadcast(terms)

    def make():
        number = numbered.value

        def step(rows):
            out = []
            for key, text in rows:
                words = words_of(text)
                at = [i for i, w in enumerate(words) if w in number]
                out.append((key, len(words), [number[words[i]] for i in at], at))
            return out
        return step
    return map_rows_with(docs.select("id", "text"), make,
                         f"id {docs.schema['id'].dataType.simpleString()}, n_words long, "
                         "terms array<int>, positions array<int>")


def postings(index: DataFrame) -> DataFrame:
    """``term, id, pos``: the inverted index, one row per occurrence."""
    return index.select("id", F.explode(F.arrays_zip("terms", "positions")).alias("p")).select(
        F.col("p.terms").alias("term"), "id", F.col("p.positions").alias("pos"))


def phrase_candidates(inverted: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id, pair, pos`` where ``first`` occurs at pos and ``second`` at pos + gap (null: one term only).

    ``pairs``: ``pair, first, second, gap``, of bounded size.
    """
    led = inverted.join(F.broadcast(pairs), F.col("term") == F.col("first")).select(
        "id", "pair", "pos", "second", (F.col("pos") + F.col("gap")).alias("at"))
    other = inverted.select(F.col("id").alias("id2"), F.col("term").alias("term2"), F.col("pos").alias("pos2"))
    both = led.filter("second is not null").join(
        other, (F.col("id") == F.col("id2")) & (F.col("second") == F.col("term2")) & (F.col("at") == F.col("pos2")),
        "left_semi")
    return both.unionByName(led.filter("second is null")).select("id", "pair", "pos")


def proximity_matches(inverted: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """``id, pair, pos, other``: ``first`` at pos with ``second`` at most ``slop`` words away, on either side.

    Positions meet by an equi-join on blocks of ``slop`` words and their neighbours.
    """
    block = F.floor(F.col("pos") / F.lit(max(slop, 1)))
    led = (inverted.join(F.broadcast(pairs.filter("second is not null")), F.col("term") == F.col("first"))
           .select("id", "pair", "pos", "second", F.explode(F.array(block - 1, block, block + 1)).alias("block")))
    other = inverted.select("id", F.col("term").alias("second"), F.col("pos").alias("other"), block.alias("block"))
    return (led.join(other, ["id", "second", "block"])
            .filter((F.abs(F.col("pos") - F.col("other")) <= slop) & (F.col("pos") != F.col("other")))
            .select("id", "pair", "pos", "other"))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """``words, items``: every distinct window with the sorted ids (as text) of the items that hold it."""
    def make():
        def step(rows):
            out = []
            for key, text in rows:
                words = words_of(text)
                for i in range(max(1, len(words) - window + 1) if words else 0):
                    out.append((words[i:i + window], key))
            return out
        return step
    return (map_rows_with(items.select("id", "text"), make, "words array<binary>, item string")
            .groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = 13,
                  block_windows: int = 200_000, share: int = 20) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted ids as text), ``contaminated``.

    An item of fewer words than ``window`` is one window; null or wordless
    texts have none, so an empty item matches nothing and an empty document is
    clean. ``contaminated``: some word is hit and ``share * n_hit >= n_words``.
    Items with a null id hit words and are listed as ''. Repeated items count
    once; documents that share an id are judged as copies of one document; a
    document with a null id is returned as clean. Empty tables give no rows or
    no hits.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("text"))
    items = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"),
                         as_bytes(item_text).alias("text"))
    windows = stored(item_windows(items, window))
    blocks = max(1, -(-windows.count() // block_windows))
    base, hits = None, []
    for block in range(blocks):
        known = [([bytes(w) for w in r["words"]], list(r["items"])) for r in windows.filter(
            F.pmod(F.xxhash64("words"), F.lit(blocks)) == block).toLocalIterator()]
        index, found = _block(spark, docs, known)
        base = base if base is not None else index.select("id", "n_words")
        hits.append(found)
    merged = hits[0]
    for more in hits[1:]:
        merged = merged.unionByName(more)
    merged = merged.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
                                      F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    n_hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
                        lambda a, s: F.struct(
                            (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["end"]))).alias("n"),
                            F.greatest(a["end"], s["stop"]).alias("end")), lambda a: a["n"])
    merged = merged.select("id", n_hit.alias("n_hit"), "items")
    out = base.join(merged, "id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"),
                      F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def _block(spark, docs: DataFrame, known: list) -> tuple[DataFrame, DataFrame]:
    """The forward index for one block of windows, and its hits ``id, spans, items``."""
    n = term_counts(docs, {w for words, _ in known for w in words})
    pairs: dict[tuple, int] = {}
    of_pair: dict[int, list] = defaultdict(list)
    for words, ids in known:
        first_at: dict[bytes, int] = {}
        for i, w in enumerate(words):
            first_at.setdefault(w, i)
        rare = sorted(first_at, key=lambda w: (n.get(w, 0), first_at[w]))[:2]
        if any(w not in n for w in first_at):
            continue  # a term that no document has
        key = (rare[0], rare[1] if len(rare) > 1 else None, first_at[rare[-1]] - first_at[rare[0]])
        of_pair[pairs.setdefault(key, len(pairs))].append((first_at[rare[0]], words, ids))
    numbers = {w: i for i, w in enumerate(sorted({w for a, b, _ in pairs for w in (a, b) if w is not None}))}
    index = stored(forward_index(docs, numbers))
    table = spark.createDataFrame([(i, numbers[a], None if b is None else numbers[b], gap)
                                   for (a, b, gap), i in pairs.items()],
                                  "pair int, first int, second int, gap int")
    at = stored(phrase_candidates(postings(index), table).groupBy("id").agg(
        F.collect_list(F.struct("pair", "pos")).alias("at")))
    lookup = spark.sparkContext.broadcast(dict(of_pair))

    def make():
        of = lookup.value

        def step(rows):
            out = []
            for key, text, candidates in rows:
                words, spans, ids = words_of(text), set(), set()
                for c in candidates:
                    for off, phrase, named in of[c["pair"]]:
                        start = c["pos"] - off
                        if start >= 0 and words[start:start + len(phrase)] == phrase:
                            spans.add((start, start + len(phrase)))
                            ids.update(named)
                if spans:
                    merged = []
                    for a, b in sorted(spans):
                        if merged and a <= merged[-1][1]:
                            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                        else:
                            merged.append((a, b))
                    out.append((key, [{"start": a, "stop": b} for a, b in merged], sorted(ids)))
            return out
        return step
    found = map_rows_with(docs.join(at, "id").select("id", "text", "at"), make,
                          f"id {docs.schema['id'].dataType.simpleString()}, "
                          "spans array<struct<start:int,stop:int>>, items array<string>", rows_per_step=64)
    return index, found.groupBy("id").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
