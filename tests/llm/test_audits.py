"""Source divergence, quality rules and the filter audit against brute force."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from geospan.llm import divergence, filter_audit, quality_rules

DOCS = "doc_id long, text string, lang string, source string, part string, n int, value string, id long"


def corpus(spark, rows):
    """Documents with extra columns that clash with names the operators use."""
    return spark.createDataFrame([(i, t, lang, s, "p", 1, "v", -1) for i, t, lang, s in rows], DOCS)


# ---------------------------------------------------------------- divergence

def divergence_brute(rows, least_docs, top=50):
    docs = [(lang or "", s or "", re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
            for _, t, lang, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least_docs}
        whole = Counter(t for d in mine for t in d[2] if t in kept)
        groups = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}
        price = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for s, c in groups.items():
            pairs = [(sum(abs(price(c, t) - price(o, t)) for t in kept), item) for item, o in groups.items() if item != s]
            terms = [(price(c, t) - price(whole, t), t) for t in c if price(c, t) > price(whole, t)]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(items[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("bucket_terms", [16_384, 3])
def test_divergence_equals_brute_force(spark, bucket_terms):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ab", "Cd", "éf", "ßg", "日本") for b in "uvwxyz"]
    rows = [(i, rng.choice([" ", "-", "_1"]).join(rng.choices(words, range(1, 31), k=rng.randrange(0, 40))),
             rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S3", None, "ü", "hot", "hot", "hot"])) for i in range(220)]
    rows += [(900, None, "en", "no text"), (901, "", "lone", "only"), (902, "12 34", "two", "a"), (903, "seldom", "two", "b")]
    rows += rows[:5]  # repeated rows are documents of their own
    got = divergence.audit_sources(corpus(spark, rows), least_docs=12, top_terms=7, bucket_terms=bucket_terms)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == divergence_brute(rows, 12, 7)


def test_divergence_empty_table(spark):
    assert divergence.audit_sources(corpus(spark, [])).count() == 0


def test_long_text_is_split_whole():
    text = ("Alpha béta1gamma " * 200_000).encode()
    assert divergence.term_counts(text) == {b"alpha": 200_000, "béta".encode(): 200_000, b"gamma": 200_000}


def test_gallop_and_merge_equal_brute_force():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (5, 0), (1, 1), (40, 1000), (900, 1000), (1000, 3)):
        a, b = (np.sort(rng.choice(2000, k, replace=False)) for k in (n, m))
        assert (divergence.gallop(a, b) == np.searchsorted(b, a)).all()
        x, y = rng.integers(1, 10**11, n), rng.integers(1, 50, m)
        weight_x, weight_y = int(x.sum()) + 10_000, int(y.sum()) + 10_000
        p, q = dict(zip(a.tolist(), x.tolist())), dict(zip(b.tolist(), y.tolist()))
        want = sum(abs(10**9 * (p.get(t, 0) + 5) // weight_x - 10**9 * (q.get(t, 0) + 5) // weight_y) for t in p.keys() | q.keys())
        assert divergence.merge_pair(a, x, weight_x, b, y, weight_y) == (want, len(p.keys() | q.keys()))
        assert divergence.merge_pair(b, y, weight_y, a, x, weight_x) == (want, len(p.keys() | q.keys()))


# ---------------------------------------------------------------- quality

def measure_brute(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(re.search("[^\\x20\\x09-\\x0D]", line)) and line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(hit)


def test_measures_equal_brute_force():
    rng = random.Random(5)
    texts = ["", " \n ", "a", "a a a", "a a a a", "é b c\x0b\n\n d", "x\n x\nx\n\n \n \nx", "a b c a b c d a b"]
    texts += ["".join(rng.choices(["aa ", "b ", "é ", "#", "|\n", "aa b é ", "C\t"], k=rng.randrange(200))) for _ in range(60)]
    for text in texts:
        assert quality_rules.measure(text.encode())[:5] == measure_brute(text)


def test_forest_paths_equal_brute_force():
    rng = np.random.default_rng(2)
    rows = np.r_[rng.normal(size=(600, 5)), rng.normal(6, 1, size=(20, 5)), np.ones((50, 5))]
    forest = quality_rules.grow_forest(rows, trees=25, subsample=64)

    def path(tree, row, node=0):
        trait, split, left, length = (c[node] for c in tree)
        return length if trait < 0 else path(tree, row, left + int(row[trait] >= split))
    want = [2 ** (-np.mean([path(t, row) for t in forest.trees]) / forest.usual) for row in rows]
    got = forest.scores(rows)
    assert np.allclose(got, want)
    assert got[600:620].min() > np.median(got[:600])
    assert quality_rules.grow_forest(np.zeros((0, 5))).scores(np.ones((2, 5))).tolist() == [0, 0]


def test_quality_of_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_rules.judge_quality(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    for key, row in got.items():
        base = measure_brute(texts[key] or "")
        assert tuple(row[1:6]) == base
        assert row.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (row.base_failed and row.kept)
    marked = [(r.quality, got[r.doc_id].kept) for r in labels.collect() if not got[r.doc_id].base_failed]
    poor, good = ([kept for q, kept in marked if q == k] for k in (0, 1))
    assert sum(poor) <= 0.05 * len(poor) and sum(good) >= 0.98 * len(good)


def test_quality_edge_cases(spark):
    prose = " ".join(f"word{i}" for i in range(80))
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (None, prose, "en", "s"), (3, prose, "en", "s"), (3, prose, "en", "s"),
            (4, "same words " * 100_000, "en", "s")]
    labels = spark.createDataFrame([(3, 1, "x"), (None, 0, "x"), (2, None, "x")], "doc_id long, quality int, n_words string")
    got = quality_rules.judge_quality(corpus(spark, rows), labels).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_words, r.base_failed, r.kept) for r in got if r.doc_id is not None) == [
        (False, 1, 0, True, False), (False, 2, 0, True, False), (False, 3, 80, False, True), (False, 3, 80, False, True),
        (False, 4, 200_000, True, False)]
    assert [r.kept for r in got if r.doc_id is None] == [True]
    assert quality_rules.judge_quality(corpus(spark, []), labels).count() == 0


# ---------------------------------------------------------------- filter audit

def audit_brute(rows, labels):
    text = [(i, s or "", t or "") for i, t, _, s in rows]
    fails = []
    for i, _, t in text:
        words = re.findall("[^\\x20\\x09-\\x0D]+", t)
        fails.append({f for f, bad in (
            ("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", t)) > 2 * len(t)), ("D", bool(re.search("[#$%&*|]", t))),
            ("E", i is not None and any(u == t and j is not None and j < i for j, _, u in text))) if bad})
    out = []
    for part in {s for _, s, _ in text}:
        mine = [(i, f) for (i, s, _), f in zip(text, fails) if s == part]
        rows_ = []
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                rows_.append([part, order, step, len(left), len(gone), sum(f in x[1] for x in mine) - len(gone),
                              sum(x[1] == {f} for x in mine), sum(any(j == x[0] and q == 1 for j, q, _ in labels) for x in gone if x[0] is not None),
                              sum(any(j == x[0] and z == 1 for j, _, z in labels) for x in gone if x[0] is not None), f])
        total = Counter()
        for row in rows_:
            total[row[-1]] += row[4]
        out += [(*row[:-1], total[row[-1]]) for row in rows_]
    return sorted(out)


def test_filter_audit_equals_brute_force(spark):
    rng = random.Random(9)
    pool = [" ".join(rng.choices([f"w{k}" for k in range(rng.choice([20, 900]))], k=rng.choice([150, 230])))
            + rng.choice(["", " A B C D E F G H I J K L M N O P Q R S T", " #", " | X"]) for _ in range(25)]
    rows = [(rng.randrange(150), rng.choice(pool), "en", rng.choice(["s1", "s2", "", None])) for _ in range(160)]
    rows += [(None, pool[0], "en", "s1"), (None, None, "en", "s2"), (500, None, "en", "s1"), (501, "", "en", "s2"),
             (502, "É" * 60_000, "en", "s2")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(*row, "x") for row in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit_filters(corpus(spark, rows), frame)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                           "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == audit_brute(rows, labels)
    assert filter_audit.audit_filters(corpus(spark, []), frame).count() == 0


def test_gray_walk_equals_direct_sums():
    cells = np.random.default_rng(4).integers(0, 9, (32, 3))
    states = filter_audit.gray_walk(cells)
    for s in range(32):
        assert (states[s] == cells[[m for m in range(32) if m & s == 0]].sum(axis=0)).all()
