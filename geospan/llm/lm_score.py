"""LM scoring with a hashed maximum-entropy model.

A word is predicted in two steps, its class and the word in its class. The
class softmax has weights for the word before (bigram), the word before that
(skip) and both together (trigram), all by hashed word buckets; the second
factor is the word's add-one share of its class. Frequent words have a class
or bucket of their own, others share theirs by their ending.

The corpus is gathered as counts: of all words, and of classes by context.
Both are combined on the map side and shuffled; the weights are then trained
by gradient steps, each a Spark job over the context counts whose partial
gradients are summed by blocks of weights. Texts are scored in batches: the
softmax of each distinct context of a batch is computed once.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geospan.llm.common import as_bytes, map_rows_with, stored


@dataclass
class Shape:
    """Sizes that bound the model."""

    head: int = 200_000  # words whose counts every task knows
    exact: int = 160  # words with a context bucket of their own
    shared: int = 96  # context buckets by ending
    single: int = 16  # words with a class of their own
    endings: int = 47  # classes by ending
    hashed: int = 4096  # weights rows for pairs of buckets
    steps: int = 16

    @property
    def buckets(self) -> int:
        return self.exact + self.shared + 1  # the last: before the text

    @property
    def classes(self) -> int:
        return 1 + self.single + self.endings  # the first: the end

    @property
    def rows(self) -> int:
        return 1 + 2 * self.buckets + self.hashed


def features(contexts: np.ndarray, s: Shape) -> np.ndarray:
    """Rows of weights that are active in each context: bias, bigram, skip, trigram."""
    one, two = contexts % s.buckets, contexts // s.buckets
    pair = (contexts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(s.hashed)
    return np.stack([np.zeros_like(one), 1 + one, 1 + s.buckets + two, 1 + 2 * s.buckets + pair.astype(np.int64)])


def class_logs(weights: np.ndarray, contexts: np.ndarray, s: Shape) -> np.ndarray:
    """Natural log of the class probabilities in each context."""
    f = features(contexts, s)
    z = weights[f[0]] + weights[f[1]] + weights[f[2]] + weights[f[3]]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


class Words:
    """Bucket, class and count of words; unknown to the head, by their ending."""

    def __init__(self, head: list[tuple[bytes, int]], shape: Shape):
        self.shape = shape
        self.number = {w: i for i, (w, _) in enumerate(head)}
        self.count = np.array([n for _, n in head] or [0], float)
        kinds = [self.ending(w) for w, _ in head] or [(0, 0)]
        self.bucket = np.array([i if i < shape.exact else b for i, (b, _) in enumerate(kinds)])
        self.klass = np.array([1 + i if i < shape.single else c for i, (_, c) in enumerate(kinds)])
        self.by_end: dict[bytes, tuple[int, int]] = {}

    def ending(self, word: bytes) -> tuple[int, int]:
        h = xxhash.xxh3_64_intdigest(word[-3:])
        return self.shape.exact + h % self.shape.shared, 1 + self.shape.single + (h >> 20) % self.shape.endings

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Head number (-1 if rare), bucket and class of each word; the rare words in order."""
        get = self.number.get
        at = np.array([get(w, -1) for w in words], np.int64)
        bucket, klass = self.bucket[at], self.klass[at]
        gone = np.flatnonzero(at < 0)
        rare = [words[i] for i in gone.tolist()]
        if rare:
            known = self.by_end
            pairs = []
            for w in rare:
                end = w[-3:]
                if end not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[end] = self.ending(w)
                pairs.append(known[end])
            bucket[gone], klass[gone] = np.array(pairs).T
        return at, bucket, klass, rare

    def contexts(self, bucket: np.ndarray) -> np.ndarray:
        """Context of every token, the end included."""
        before = self.shape.buckets - 1
        one = np.r_[before, bucket]
        two = np.r_[before, before, bucket[:-1]][:len(one)]
        return two * self.shape.buckets + one


@dataclass
class LanguageModel:
    counts: DataFrame  # word binary, n: every training token, the end aside
    head: list
    tokens: int  # N, ends included
    types: int  # V, the end included if a document was learned from
    ends: int
    weights: np.ndarray
    mass: np.ndarray  # of each class: its words' counts plus one, and one for unknown words
    shape: Shape = field(default_factory=Shape)


def _split(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_counts(texts: DataFrame, entries: int = 400_000) -> DataFrame:
    """``word, n`` over all rows; each task hands on what it has counted at ``entries`` words."""
    def make():
        count: Counter = Counter()

        def step(rows):
            for (text,) in rows:
                count.update(_split(text))
            if len(count) < entries:
                return []
            out = list(count.items())
            count.clear()
            return out
        step.finish = lambda: list(count.items())
        return step
    return map_rows_with(texts.select("text"), make, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, at most ``most``, whole steps of frequency at a time."""
    step = F.floor(F.log2("n") * 16)
    have, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect(),
                    key=lambda r: -r["step"]):
        if have + r["k"] > most:
            break
        have, least = have + r["k"], r["step"]
    if least is None:
        return []
    return sorted(((bytes(r["word"]), r["n"]) for r in counts.filter(step >= least).collect()),
                  key=lambda r: (-r[1], r[0]))


def train(docs: DataFrame, text_col: str = "text", shape: Shape | None = None) -> LanguageModel:
    """Learns from every row of ``docs``; null text is an empty one, which teaches its end."""
    s = shape or Shape()
    spark = docs.sparkSession
    texts = docs.select(as_bytes(text_col).alias("text"))
    counts = stored(word_counts(texts))
    ends = texts.count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    head = head_words(counts, s.head)
    shared = spark.sparkContext.broadcast(head)

    def gather():
        # As large as the model allows, whatever the task reads.
        words, seen = Words(shared.value, s), np.zeros(s.buckets ** 2 * s.classes, np.int64)

        def step(rows):
            keys = []
            for (text,) in rows:
                _, bucket, klass, _ = words.encode(_split(text))
                keys.append(words.contexts(bucket) * s.classes + np.r_[klass, 0])
            cell, n = np.unique(np.concatenate(keys), return_counts=True)
            seen[cell] += n
            return []

        def drain(most=100_000):
            cell = np.flatnonzero(seen)
            for at in range(0, len(cell), most):
                yield cell[at:at + most], seen[cell[at:at + most]]
        step.drain = drain
        return step
    cells = (map_rows_with(texts, gather, "cell long, n long", rows_per_step=256)
             .groupBy("cell").agg(F.sum("n").alias("n")))
    cells = stored(cells.select(F.floor(F.col("cell") / s.classes).alias("context"),
                                F.struct((F.col("cell") % s.classes).alias("k"), "n").alias("kn"))
                   .groupBy("context").agg(F.collect_list("kn").alias("cells")))

    def dense():
        def step(rows):
            seen = np.zeros((len(rows), s.classes), np.float32)
            for i, (_, kn) in enumerate(rows):
                seen[i, [c["k"] for c in kn]] = [c["n"] for c in kn]
            return [(np.array([r[0] for r in rows], np.int64).tobytes(), seen.tobytes())]
        return step
    # Decoded once, not in every gradient step: blocks of contexts and their counts by class.
    cells = stored(map_rows_with(cells, dense, "contexts binary, seen binary", rows_per_step=2048))
    mass = np.ones(s.classes)
    kinds = Words(head, s)
    # Mass of each class: head words here, rare words by a grouped sum over their endings.
    if head:
        np.add.at(mass, kinds.klass, kinds.count + 1)

    def rest():
        words, sums = Words(shared.value, s), Counter()

        def step(rows):
            for w, n in rows:
                if w not in words.number:
                    sums[words.ending(w)[1]] += n + 1
            return []
        step.finish = lambda: list(sums.items())
        return step
    for r in map_rows_with(counts, rest, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        mass[r["k"]] += r["n"]
    for i in range(min(len(head), s.single)):
        mass[1 + i] = kinds.count[i] + 1  # a class of one word has no unknown words
    mass[0] = 1
    return LanguageModel(counts, head, total["n"] + ends, total["v"] + (ends > 0), ends,
                         _fit(spark, cells, s), mass, s)


def _fit(spark, cells: DataFrame, s: Shape, blocks: int = 16) -> np.ndarray:
    """Diagonally scaled gradient steps; every step sums the gradients of all partitions."""
    weights = np.zeros((s.rows, s.classes), np.float32)
    edges = np.linspace(0, s.rows, blocks + 1).astype(int)
    for _ in range(s.steps):
        now = spark.sparkContext.broadcast(weights)

        def gradients(now=now):
            grad = np.zeros((2, s.rows, s.classes), np.float32)

            def step(rows):
                for contexts, counts in rows:
                    context = np.frombuffer(contexts, np.int64)
                    seen = np.frombuffer(counts, np.float32).reshape(-1, s.classes)
                    p = np.exp(class_logs(now.value, context, s))
                    n = seen.sum(axis=1, keepdims=True)
                    off, spread = n * p - seen, n * p * (1 - p)
                    for f in features(context, s):
                        order = np.argsort(f, kind="stable")
                        first = np.flatnonzero(np.r_[True, np.diff(f[order]) > 0])
                        at = f[order][first]
                        grad[0, at] += np.add.reduceat(off[order], first)
                        grad[1, at] += np.add.reduceat(spread[order], first)
                return []
            step.finish = lambda: [(b, grad[:, edges[b]:edges[b + 1]].tobytes()) for b in range(blocks)]
            return step

        def total(table):
            import pyarrow as pa
            parts = [np.frombuffer(g, np.float32) for g in table["grad"].to_pylist()]
            return pa.table({"block": table["block"][:1], "grad": pa.array([np.sum(parts, axis=0).tobytes()])})
        summed = map_rows_with(cells, gradients, "block int, grad binary", rows_per_step=1).groupBy(
            "block").applyInArrow(total, "block int, grad binary").collect()
        for r in summed:
            a, b = edges[r["block"]], edges[r["block"] + 1]
            g, h = np.frombuffer(r["grad"], np.float32).reshape(2, b - a, s.classes)
            weights[a:b] -= np.clip(0.4 * (g + 0.5 * weights[a:b]) / (h + 1.0), -1, 1)
        now.unpersist()
    return weights


def score_texts(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_tokens, n_known, train_tokens, base_score, score``.

    Scores are log10 probabilities of the whole text and its end; null text is
    an empty one. Ids may be null or repeated: every row is scored for itself.
    """
    s = model.shape
    shared = docs.sparkSession.sparkContext.broadcast((model.head, model.weights, model.mass))
    base = math.log10(model.tokens + model.types + 1)
    end_known, end_log = int(model.ends > 0), math.log10(model.ends + 1)

    def make():
        head, weights, mass = shared.value
        words = Words(head, s)
        logs, log_mass = np.log10(words.count + 1), np.log10(mass)
        number = TaskContext.get().partitionId() << 40

        def step(rows):
            nonlocal number
            encoded = []
            for _, text in rows:
                at, bucket, klass, rare = words.encode(_split(text))
                encoded.append((at[at >= 0], words.contexts(bucket), np.r_[klass, 0], Counter(rare)))
            contexts, back = np.unique(np.concatenate([e[1] for e in encoded]), return_inverse=True)
            table = class_logs(weights, contexts, s) / math.log(10)
            out, done = [], 0
            for (key, _), (at, context, klass, rare) in zip(rows, encoded):
                n = len(context)
                steps = table[back[done:done + n], klass].sum(dtype=float)
                done += n
                known = float(logs[at].sum())
                out.append((number, key, n, len(at) + end_known, known + end_log - n * base,
                            float(steps - log_mass[klass].sum()) + known, list(rare), list(rare.values())))
                number += 1
            return out
        return step
    texts = docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("text"))
    rows = stored(map_rows_with(texts, make, f"row long, id {docs.schema[id_col].dataType.simpleString()}, "
                                "n_tokens long, n_known long, base_score double, score double, "
                                "rare array<binary>, times array<int>", rows_per_step=256))
    # Words beyond the head meet their counts by a join; none of them is frequent.
    rare = (rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w"))
            .select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
            .join(model.counts, "word").groupBy("row")
            .agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("known")))
    more = F.coalesce("more", F.lit(0.0))
    return rows.drop("rare", "times").join(rare, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"),
        (F.col("score") + more).alias("score"))
