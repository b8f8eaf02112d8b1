"""URL filter: rules first, boosted trees on lexical features for the rest.

URLs that a rule judges are the labelled ones; a bounded sample of them
trains the trees, which judge URLs that no rule fits.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geospan.llm.boosting import Boosted
from geospan.llm.common import share

PARTS = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
LOWER = {chr(c): chr(c + 32) for c in range(65, 91)}


def host_of(url: Column) -> Column:
    """What follows the first ``://``, A-Z lower-cased; empty without one or for null."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1)
    return F.translate(found, "".join(LOWER), "".join(LOWER.values()))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null without one. ``rules``: (verdict, host/path)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0])):  # the last that fits wins
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        name = F.when(fits, F.lit(rule)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def tokens(host: str, path: str) -> tuple[str, ...]:
    """What statistics are kept of: host suffixes, the path's first part and its extension."""
    labels = host.split(".")
    parts = path.split("/")
    ext = parts[-1].rpartition(".")[2] if "." in parts[-1] else ""
    return (f"s1:{labels[-1]}", f"s2:{'.'.join(labels[-2:])}", f"p:{parts[1] if len(parts) > 2 else ''}", f"e:{ext}")


#: Statistic of a suffix that too few labelled URLs have.
UNSEEN = -1.0


class UrlModel:
    """Block rates of suffixes, and trees; of bounded size."""

    def __init__(self, rates: dict[str, float], trees: Boosted):
        self.rates, self.trees = rates, trees

    def row(self, url: str, host: str, path: str) -> list[float]:
        query = url.partition("?")[2].partition("#")[0]
        n = max(len(url), 1)
        first_digit = re.search(r"\d", path)
        stats = [self.rates.get(t, UNSEEN) for t in tokens(host, path)]
        return [len(url), len(host), len(path), host.count("."), path.count("/"), len(query), query.count("="),
                query.count("&"), sum(map(str.isdigit, url)) / n, sum(map(str.isdigit, host)), url.count("-"),
                sum(not c.isalnum() for c in url) / n, entropy(host), entropy(path), float(url.startswith("https")),
                float("#" in url), float(path.endswith("/")), float(first_digit.start() if first_digit else -1),
                *stats]

    def score(self, rows: list[tuple[str, str, str]]) -> np.ndarray:
        """Probability of block."""
        return self.trees.score(np.array([self.row(*r) for r in rows])) if rows else np.zeros(0)


def train(labelled: DataFrame, max_rows: int = 20_000, support: int = 20) -> UrlModel:
    """``labelled``: ``url, host, path, verdict``; of the distinct URLs at most ``max_rows``, by least hash.

    Suffix statistics come from a half of them, the trees from the other. With
    no rows, or one verdict only, the score is constant.
    """
    rows = (labelled.select("url", "host", "path", "verdict").withColumn("h", F.xxhash64("url"))
            .dropDuplicates(["h"]).orderBy("h").limit(max_rows).collect())
    label = np.array([r["verdict"] == "block" for r in rows], float)
    base = float(label.mean()) if len(label) else 0.0
    blocked, seen = Counter(), Counter()
    for r, y in list(zip(rows, label))[::2]:
        for t in tokens(r["host"], r["path"]):
            seen[t] += 1
            blocked[t] += y
    model = UrlModel({t: (blocked[t] + 4 * base) / (n + 4) for t, n in seen.items() if n >= support}, Boosted(60))
    other = rows[1::2]
    if not other:
        model.trees.fit(np.zeros((0, 1)), label[1::2])
        return model
    x = np.array([model.row(r["url"], r["host"], r["path"]) for r in other])
    # Each row once more without its host's statistics: hosts of unseen suffixes are judged by the rest.
    masked = x.copy()
    masked[:, -4:-2] = UNSEEN
    model.trees.fit(np.concatenate([x, masked]), np.tile(label[1::2], 2))
    return model


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", max_rows: int = 20_000,
               threshold: float = 0.5) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, block_score``; columns of these names are replaced.

    Null URLs and URLs without ``://`` have an empty host and path, fit no
    rule, and get the method's verdict like any other. Of rules that fit the
    longest wins, of equally long ones the last by name.
    """
    import pandas as pd
    from collections.abc import Iterator
    from pyspark.sql.functions import pandas_udf
    made = ("host", "path", "rule", "verdict", "block_score")
    kept = [c for c in pages.columns if c not in made]
    url = F.coalesce(F.col(url_col), F.lit("")).alias("url")
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    labelled = pages.select(url, host.alias("host"), path.alias("path")).withColumn("verdict", says).filter(
        "verdict is not null")
    shared = share(pages.sparkSession, train(labelled, max_rows))

    def run(batches):
        model = shared()
        for urls, hosts, paths in batches:
            yield pd.Series(model.score(list(zip(urls.fillna(""), hosts, paths))))
    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    score = pandas_udf(run, "double")
    out = pages.select(*kept).withColumns({"host": host, "path": path})
    out = out.withColumn("block_score", score(F.col(url_col), F.col("host"), F.col("path"))).withColumn("rule", rule)
    verdict = F.coalesce(says, F.when(F.col("block_score") >= threshold, "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).select(*kept, *made)
