"""Quality rules by an isolation forest over rule statistics.

Every whole text is measured once. Two fixed rules fail it outright; the rest
is judged by how soon random splits part its statistics from those of other
texts: a forest of random trees is grown on a bounded sample of distinct
statistics, a text's score is 2^-(mean path length / expected length), and the
score from which on texts are rejected is calibrated on all labelled rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geospan.llm.common import as_bytes, map_rows, map_rows_with, share, stored

SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
CONTINUATION = bytes(range(128, 192))
SPACES = b" \t\n\x0b\x0c\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Per text: mean word length, symbols a word, size of the vocabulary for the length, share of capitals, of the commonest word.
TRAITS = 5
#: Scores are compared in steps of 1 / STEPS.
STEPS = 10_000


def repeated_words(ids: np.ndarray, width: int = 3) -> int:
    """Words in windows of ``width`` consecutive words that occur twice or more, first ones included."""
    if len(ids) <= width:
        return 0
    kinds = int(ids.max()) + 1
    window = ids[:-1] * kinds + ids[1:]
    for i in range(2, width):
        window = np.unique(window, return_inverse=True)[1][:len(ids) - i] * kinds + ids[i:]
    _, at, n = np.unique(window, return_inverse=True, return_counts=True)
    again = n[at] > 1
    hit = np.zeros(len(ids), bool)
    for i in range(width):
        hit[i:i + len(again)] |= again
    return int(hit.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


def measure(text: bytes) -> tuple:
    """The ``BASE`` numbers of a UTF-8 text and its ``TRAITS`` (zeros without words)."""
    words = text.split()
    number = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    n = len(words)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    chars = len(text.translate(None, SPACES + CONTINUATION))
    if n:
        capitals = len(text) - len(text.translate(None, CAPITALS))
        traits = [chars / n, symbols / n, math.log(len(number) + 1) / math.log(n + 1), capitals / chars,
                  int(np.bincount(ids).max()) / n]
    else:
        traits = [0.0] * TRAITS
    return n, chars, symbols, repeated_lines(text), repeated_words(ids), traits


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def expected_path(n: int) -> float:
    """Mean length of an unsuccessful search in a binary tree of ``n`` keys."""
    return 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else float(n == 2)


@dataclass
class Forest:
    """Trees as arrays of nodes: trait (-1 in a leaf), split, left child (right is the next), path length of a leaf."""

    trees: list
    usual: float

    def scores(self, traits: np.ndarray) -> np.ndarray:
        """0 to 1 for each row; the sooner random splits isolate it, the higher."""
        total = np.zeros(len(traits))
        for trait, split, left, length in self.trees:
            at = np.zeros(len(traits), np.int64)
            while len(inner := np.flatnonzero(trait[at] >= 0)):
                node = at[inner]
                at[inner] = left[node] + (traits[inner, trait[node]] >= split[node])
            total += length[at]
        return 2.0 ** (-total / (len(self.trees) * self.usual)) if self.trees else total


def grow_forest(sample: np.ndarray, trees: int = 100, subsample: int = 256, seed: int = 17) -> Forest:
    """An isolation forest; each tree splits its own subsample at random until rows are alone or deep."""
    rng = np.random.default_rng(seed)
    size = min(subsample, len(sample))
    if size < 2:
        return Forest([], 1.0)
    limit = math.ceil(math.log2(size))
    return Forest([_tree(sample[rng.choice(len(sample), size, replace=False)], rng, limit) for _ in range(trees)],
                  expected_path(size))


def _tree(rows: np.ndarray, rng, limit: int):
    nodes, open_ = [None], [(0, rows, 0)]
    while open_:
        at, rows, depth = open_.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        wide = np.flatnonzero(high > low)
        if len(rows) < 2 or depth == limit or not len(wide):
            nodes[at] = (-1, 0.0, 0, depth + expected_path(len(rows)))
            continue
        trait = int(rng.choice(wide))
        # Above the least value, so that neither side is empty.
        split = max(float(rng.uniform(low[trait], high[trait])), float(np.nextafter(low[trait], np.inf)))
        below = rows[:, trait] < split
        nodes[at] = (trait, split, len(nodes), 0.0)
        open_ += [(len(nodes), rows[below], depth + 1), (len(nodes) + 1, rows[~below], depth + 1)]
        nodes += [None, None]
    return tuple(np.array(c) for c in zip(*nodes))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, the ``BASE`` columns and ``traits`` of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("text")),
                    lambda rows: [(key, *measure(text)) for key, text in rows],
                    f"id {kind}, {', '.join(f'{c} long' for c in BASE)}, traits array<double>")


def train(measured: DataFrame, sample_rows: int = 8192, trees: int = 100, subsample: int = 256) -> Forest:
    """A forest on about ``sample_rows`` distinct statistics of texts that pass the fixed rules.

    Equal statistics (copies of one text, however many) share one hash and count once.
    """
    passed = measured.filter(~base_failed())
    key = F.xxhash64("traits")
    kinds = passed.agg(F.approx_count_distinct(key)).first()[0]
    picked = passed.filter(F.pmod(key, F.lit(max(kinds, 1))) < sample_rows).select("traits").distinct().collect()
    rows = sorted(r.traits for r in picked)
    return grow_forest(np.array(rows, float).reshape(len(rows), TRAITS), trees, subsample)


def calibrate(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", clean_weight: float = 2.0) -> int:
    """The step of the score from which on texts are rejected; STEPS + 1 (none) without labels of both kinds.

    Of all labelled rows that pass the fixed rules, the share of poor ones
    rejected less ``clean_weight`` times the share of good ones rejected is
    greatest there; of equal thresholds the highest. An id with several labels is
    poor if any is.
    """
    marks = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.min("quality").alias("quality"))
    counts = (scored.filter(~base_failed()).select("id", "step").join(marks, "id").groupBy("step")
              .agg(F.count_if(F.col("quality") == 0).alias("poor"), F.count_if(F.col("quality") != 0).alias("good")).collect())
    table = np.zeros((STEPS + 2, 2))
    for step, poor, good in counts:
        table[step] = poor, good
    if not table.sum(axis=0).all():
        return STEPS + 1
    caught, lost = (table[::-1].cumsum(axis=0) / table.sum(axis=0)).T[:, ::-1]
    gain = caught - clean_weight * lost
    return int(np.flatnonzero(gain >= gain.max() - 1e-12)[-1])


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  sample_rows: int = 8192) -> DataFrame:
    """One row per document: id, the ``BASE`` columns, ``base_failed``, ``kept`` and ``anomaly`` (0 to 1).

    Words are split at ASCII white space; lines at line feeds. Null and empty
    texts have zeros throughout and fail the fixed rules. A very long text is
    measured whole. Repeated rows are judged alike, each for itself. Equal
    scores get the same verdict. Without labels only the fixed rules reject; an
    empty table gives an empty one. Of ``docs`` id and text are read, of
    ``labels`` id and quality, so further columns cannot clash.
    """
    measured = stored(measures(docs, id_col, text_col))
    forest = share(docs.sparkSession, train(measured, sample_rows))

    def scorer():
        held = forest()
        return lambda rows: [(*row, s) for row, s in zip(rows, np.round(
            held.scores(np.array([row[-1] for row in rows])) * STEPS).astype(int).tolist())]

    kind = docs.schema[id_col].dataType.simpleString()
    scored = stored(map_rows_with(measured, scorer, f"id {kind}, {', '.join(f'{c} long' for c in BASE)}, "
                                                    "traits array<double>, step int", rows_per_step=4096).drop("traits"))
    threshold = calibrate(scored, labels, id_col)
    return scored.select(F.col("id").alias(id_col), *BASE, base_failed().alias("base_failed"),
                         (~base_failed() & (F.col("step") < threshold)).alias("kept"),
                         (F.col("step") / STEPS).alias("anomaly"))
