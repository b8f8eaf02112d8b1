"""Exact, near and substring dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from geospan.llm import exact_dedup, near_dedup, substring_dedup
from geospan.llm.components import components

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# ---------------------------------------------------------------- exact

def exact_brute(rows):
    text = {i: re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for i, t in rows}
    out = []
    for i, t in text.items():
        group = [j for j, u in text.items() if u == t]
        out.append((i, max(group), len(group), i == max(group), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def test_exact_dedup_equals_brute_force(docs):
    rows = [(1, "Aa É"), (2, "aA É"), (3, "aa é"), (4, None), (5, ""), (6, " "), (7, "x" * 100_000), (8, "X" * 100_000)]
    rows += [(100 + i, "the same") for i in range(300)]  # a heavy group
    got = exact_dedup.exact_dedup(docs(rows), heavy_rows=50)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect())) == exact_brute(rows)


def test_exact_dedup_empty_null_and_repeated(docs):
    assert exact_dedup.exact_dedup(docs([])).count() == 0
    got = sorted(exact_dedup.exact_dedup(docs([(None, "a"), (1, "a"), (1, "a"), (None, "b")])).collect(), key=str)
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got] == [
        (1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 1, True)]


def test_exact_dedup_plan_is_native(docs):
    plan = exact_dedup.exact_dedup(docs([(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- components

def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (20, 21), (21, 22), (22, 20), (30, 31), (40, 40)]
    edges += [(100 + i, 101 + i) for i in range(40)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {i: 1 for i in (1, 2, 3, 9)} | {i: 20 for i in (20, 21, 22)} | {30: 30, 31: 30}
    assert got == want | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- near

def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_banded_alignment_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(1500):
        a = [rng.randint(0, rng.choice([2, 9, 99])) for _ in range(rng.randint(0, 30))]
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            at = rng.randint(0, len(b))
            b[at:at + rng.randint(0, 1)] = [rng.randint(0, 9)] * rng.randint(0, 1)
        x, y, true = np.array(a, np.uint64), np.array(b, np.uint64), common(a, b)
        slack = len(a) + len(b) - 2 * true
        assert near_dedup.aligned_within(x, y, slack) == true
        assert near_dedup.aligned_within(x, y, rng.randint(0, 12)) <= true
        differ = sum(int(v).bit_count() for v in (near_dedup.parity_bitmap(x) ^ near_dedup.parity_bitmap(y)).view(np.uint64))
        shared = len(np.intersect1d(near_dedup.labelled(x), near_dedup.labelled(y)))
        assert differ <= len(a) + len(b) - 2 * shared


def shingle_list(text, k=5):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return [tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def near_brute(rows, similarity=0.8):
    """Class of every document: all pairs, aligned by dynamic programming."""
    seq = {i: shingle_list(t) for i, t in rows}
    bags = {i: Counter(x) for i, x in seq.items()}
    root = {i: i for i in seq}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(seq)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = seq[i], seq[j]
            if a != b and 1.8 * sum((bags[i] & bags[j]).values()) < similarity * (len(a) + len(b)) - 1e-9:
                continue  # too few shared shingles in any order
            if a == b or a and b and common(a, b) >= similarity * (len(a) + len(b) - common(a, b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def changed(rng, text, edits_):
    words = text.split()
    for _ in range(edits_):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def test_near_classes_equal_brute_force(docs):
    rng = random.Random(7)
    rows = [(1000, None), (1001, ""), (1002, "one two"), (1003, "One  TWO"), (1004, "one three")]
    shared = prose(rng, 25)  # a passage that many documents share: no reason to link them
    for g in range(12):
        base = prose(rng, rng.randint(40, 90))
        rows += [(10 * g + j, changed(rng, base, j // 2)) for j in range(5)]
    chain = prose(rng, 100)
    for j in range(8):  # neighbours are alike, the ends are not
        rows.append((500 + j, chain))
        chain = changed(rng, chain, 2)
    rows += [(600 + j, shared + " " + prose(rng, 60)) for j in range(12)]
    got = {r.doc_id: r for r in near_dedup.near_classes(docs(rows)).collect()}
    assert {i: r.class_id for i, r in got.items()} == near_brute(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())
    assert got[1001].copy_of == 1000 and got[1003].copy_of == 1002


def dense_group(rng, n):
    """Copies of one text with one or two changed words each: few are alike directly, most through others."""
    base = prose(rng, 120)
    return [(i, changed(rng, base, 1 + i % 2)) for i in range(n)]


def test_near_classes_of_a_dense_group(docs, monkeypatch):
    formed = []
    monkeypatch.setattr(near_dedup, "components", lambda edges: (formed.append(edges.count()), components(edges))[1])
    monkeypatch.setattr(near_dedup, "DEALT", 64)
    counts = []
    for n in (300, 1200):
        rows = dense_group(random.Random(11), n)
        formed.clear()
        got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs(rows)).collect()}
        if n == 300:
            assert got == near_brute(rows)
        counts.append(sum(formed))
    assert counts[1] <= 6 * counts[0]  # four times the rows; all pairs would be sixteen times


def test_short_texts_share_a_key():
    rng = random.Random(13)
    for n in range(4, near_dedup.SHORT + 1):
        codes = np.array([rng.randint(1, 9) for _ in range(n)], np.uint64)
        at = rng.randrange(n)
        for other in (np.delete(codes, at), np.r_[np.delete(codes, at), np.uint64(77)]):
            if near_dedup.similar(codes, other, 0.8) and len(other) >= 4:
                assert set(near_dedup.short_keys(codes).tolist()) & set(near_dedup.short_keys(other).tolist())
    assert len(near_dedup.short_keys(np.arange(3, dtype=np.uint64))) == len(near_dedup.short_keys(np.arange(10, dtype=np.uint64))) == 0


def test_near_classes_edge_cases(docs):
    assert near_dedup.near_classes(docs([])).count() == 0
    long = prose(random.Random(4), 60_000)
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs([(1, long), (2, long + " tail"), (3, "a b c d e f g h"),
                                                                      (4, "a b c d e f g h i")])).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}
    text = prose(random.Random(3), 30)
    got = sorted(near_dedup.near_classes(docs([(None, text), (5, text), (5, text), (6, text)])).collect(), key=str)
    assert [(r.doc_id, r.class_id, r.kept) for r in got] == [(5, 5, True), (5, 5, True), (6, 5, False),
                                                             (None, None, True)]


# ---------------------------------------------------------------- substring

def substring_brute(rows, window=13):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p:p + window]), i)
    out = []
    for i, w in words.items():
        gone = {q for p in range(len(w) - window + 1) if first[tuple(w[p:p + window])] < i
                for q in range(p, p + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept))
    return sorted(out)


@pytest.mark.parametrize("heavy_rows", [3, 20_000])
def test_substring_removal_equals_brute_force(docs, heavy_rows):
    rng = random.Random(5)
    passages = [prose(rng, n) for n in (12, 13, 14, 30, 60)]
    rows = [(0, None), (1, ""), (2, "too short"), (3, "a b c " * 20), (4, "a b c " * 20),
            (5, prose(rng, 6000)), (6, " ".join(["again"] * 40)), (7, " ".join(["again"] * 30))]
    for i in range(10, 60):
        parts = [prose(rng, rng.randint(0, 30)) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(passages))
        if rng.random() < 0.4:
            parts.insert(1, rng.choice(passages))
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(parts)))
    rows.append((70, rows[5][1] + " tail"))
    table = docs(rows)
    spans = substring_dedup.repeated_spans(table, group_rows=50, heavy_rows=heavy_rows)
    got = substring_dedup.remove_spans(table, spans)
    assert sorted(map(tuple, got.collect())) == substring_brute(rows)


def test_substring_edge_cases(docs):
    empty = docs([])
    assert substring_dedup.remove_spans(empty, substring_dedup.repeated_spans(empty)).count() == 0
    text = prose(random.Random(2), 20)
    table = docs([(None, text), (1, text), (1, text), (2, text)])
    got = substring_dedup.remove_spans(table, substring_dedup.repeated_spans(table)).collect()
    assert sorted(((r.id, r.n_words, r.n_removed) for r in got), key=str) == [
        (1, 20, 0), (1, 20, 0), (2, 20, 20), (None, 20, 0)]
