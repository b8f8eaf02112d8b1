"""Toxicity: boosted trees over dense lexical features, calibrated isotonically.

A lexicon of words and word stems is learned from a labelled sample: terms
that many toxic documents and hardly any others hold. Each text then gets
densities of that lexicon, its nearness to words of the second person, capitals,
punctuation and obfuscation rates. One part of the sample teaches the lexicon,
another the trees, a third the calibration.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geospan.llm.boosting import Boosted, calibrated, isotonic
from geospan.llm.common import as_bytes, map_rows_with, share, short_batches, stored

#: Words of the second person in the languages of the tables.
SECOND_PERSON = frozenset((
    "you", "your", "yours", "yourself", "u", "ur", "thou", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie",
    "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "usted", "ustedes", "vosotros"))
#: Characters that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$!|", "oieastasii")
WORD = re.compile(r"[^\W_]+(?:['’*@$!|][^\W_]+)*")
DISGUISED = re.compile(r"(?<![^\W_])(?=[^\W\d_]*[0-9@$*!|])(?:[^\W\d_]+[0-9@$*!|]+)+[^\W\d_]+")
SPELLED = re.compile(r"(?<!\w)(?:\w[ .\-_*]){3,}\w(?!\w)")
#: Every disguised word holds a match of this; it is quick to look for.
DISGUISE_HINT = re.compile(r"[0-9@$*!|]+[^\W\d_]")
STRETCHED = re.compile(r"(\w)\1\1")
BANGS = re.compile(r"[!?]{2,}")
BEYOND_ASCII = re.compile(r"[^\x00-\x7F]+")
NOT_CAPITAL = bytes(c for c in range(256) if not 65 <= c <= 90)
STEMS = (4, 5, 6)


def terms_of(word: str) -> list[str]:
    """The word itself and its stems, marked by a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def count_capitals(text: str) -> int:
    """Upper-case letters of any script."""
    plain = len(text.encode("utf-8", "replace").translate(None, NOT_CAPITAL))
    return plain if text.isascii() else plain + sum(sum(map(str.isupper, t)) for t in BEYOND_ASCII.findall(text))


def count_near(found: list[int], person: list[int], reach: int = 5) -> int:
    """How many of ``found`` have one of ``person`` within ``reach`` words; both rise."""
    if not found or not person:
        return 0
    at, places = np.array(found), np.array(person)
    return int((np.searchsorted(places, at + reach, "right") > np.searchsorted(places, at - reach, "left")).sum())


class Features:
    """Dense features of texts, given the lexicon's weights."""

    def __init__(self, lexicon: dict[str, float], entries: int = 200_000):
        self.lexicon, self.entries, self.weights = lexicon, entries, {}
        self.starts = {t[:3] for t in lexicon}

    def weight(self, word: str) -> float:
        found = self.weights.get(word)
        if found is None:
            plain = word.lower()
            forms = {plain} if plain.isalpha() else {plain, plain.translate(DISGUISE)}
            found = max((self.lexicon.get(t, 0.0) for f in forms if f[:3] in self.starts for t in terms_of(f)),
                        default=0.0)
            if len(self.weights) >= self.entries:
                self.weights.clear()
            self.weights[word] = found
        return found

    def row(self, text: str) -> list[float]:
        words = WORD.findall(text)
        n, chars = max(len(words), 1), max(len(text), 1)
        every = list(map(self.weights.get, words))
        if None in every:
            every = [self.weight(x) if w is None else w for x, w in zip(words, every)]
        found = [i for i, w in enumerate(every) if w]
        weights = [every[i] for i in found]
        person = [i for i, x in enumerate(words) if x.lower() in SECOND_PERSON] if found else []
        near, persons = float(count_near(found, person)), len(person)
        spelled = SPELLED.findall(text)
        bangs, asks = text.count("!"), text.count("?")
        disguised = len(DISGUISED.findall(text)) if DISGUISE_HINT.search(text) else 0
        return [len(found) / n, math.log1p(len(found)), sum(weights) / n, sum(weights), max(weights, default=0.0),
                float(len({words[i].lower() for i in found})), near / n, near, persons / n,
                count_capitals(text) / chars, sum(len(x) > 2 for x in filter(str.isupper, words)) / n,
                bangs / chars, asks / chars, (len(BANGS.findall(text)) if bangs + asks > 1 else 0) / n,
                sum(text.count(c) for c in ".,;:") / chars, disguised / n, len(spelled) / n,
                len(STRETCHED.findall(text)) / n, text.count("*") / chars, math.log1p(len(words))]


class ToxicityModel:
    """Lexicon, trees and calibration; small and of bounded size."""

    def __init__(self, lexicon, trees, knots):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def scorer(self):
        features = Features(self.lexicon)

        def score(texts: list[str]) -> np.ndarray:
            if not texts:
                return np.zeros(0)
            raw = self.trees.score(np.array([features.row(t) for t in texts]))
            return np.clip(calibrated(self.knots, raw), 0, 1)
        return score


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_rows: int = 12_000, lexicon_terms: int = 400, support: int = 6,
          odds: float = 12.0) -> ToxicityModel:
    """Learns from at most ``max_rows`` labelled rows, those with the least hash of their id.

    Rows whose label or id is null are left out; with none left, or of one
    class, the score is constant. A term enters the lexicon if at least
    ``support`` toxic documents hold it, at ``odds`` times the rate of others.
    """
    chosen = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("label"),
                      F.xxhash64(id_col).alias("h")).orderBy("h").limit(max_rows)
              .withColumn("part", F.pmod(F.shiftright("h", 8), F.lit(5)).cast("int")))
    sample = stored(docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("text"))
                    .join(F.broadcast(stored(chosen)), "id").select("text", "label", "part"))

    def make():
        count: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def step(rows):
            for text, label in rows:
                words = {w.lower() for w in WORD.findall(text.decode("utf-8", "replace"))}
                count[label].update({t for w in words for t in terms_of(w)})
            return []
        # Toxic terms only: what no toxic document holds cannot enter the lexicon.
        step.finish = lambda: [(t, n, count[0].get(t, 0)) for t, n in count[1].items()] + [
            (t, 0, n) for t, n in count[0].items() if t not in count[1]]
        return step
    size = {r["label"]: r["n"] for r in sample.filter("part < 2").groupBy("label").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    rate = (F.col("n1") + 0.1) / (n1 + 1)
    other = (F.col("n0") + 0.1) / (n0 + 1)
    rows = (map_rows_with(sample.filter("part < 2").select("text", "label"), make, "term string, n1 long, n0 long")
            .groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
            .filter((F.col("n1") >= support) & (rate > odds * other))
            .withColumn("weight", F.log(rate / other) * F.sqrt("n1")).orderBy(F.desc("weight"), "term")
            .limit(lexicon_terms).collect())
    lexicon = {r["term"]: math.log((r["n1"] + 0.1) / (n1 + 1) * (n0 + 1) / (r["n0"] + 0.1)) for r in rows}

    def featurise():
        features = Features(lexicon)
        return lambda rows: [(features.row(t.decode("utf-8", "replace")), y, p) for t, y, p in rows]
    made = map_rows_with(sample.filter("part >= 2"), featurise,
                         "x array<double>, label int, part int").toPandas()
    x = np.array(made["x"].tolist()) if len(made) else np.zeros((0, 1))
    y, fit = made["label"].to_numpy(), made["part"].to_numpy() < 4
    trees = Boosted().fit(x[fit], y[fit])
    held = ~fit
    knots = isotonic(trees.score(x[held]), y[held]) if held.any() else isotonic(np.zeros(0), np.zeros(0))
    return ToxicityModel(lexicon, trees, knots)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``toxic`` (0 or 1); columns of these names are replaced.

    Null text counts as empty and has a score too. Only the text is looked at.
    """
    from pyspark.sql.functions import pandas_udf
    short_batches(docs.sparkSession)
    shared = share(docs.sparkSession, model)

    def run(batches):
        import pandas as pd
        score = shared().scorer()
        for texts in batches:
            whole = texts.fillna("").tolist()
            out = [score(whole[i:i + 256]) for i in range(0, len(whole), 256)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))
    from collections.abc import Iterator
    import pandas as pd
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    scored = docs.withColumn("toxicity", pandas_udf(run, "double")(F.col(text_col)))
    return scored.withColumn("toxic", (F.col("toxicity") >= threshold).cast("int"))
