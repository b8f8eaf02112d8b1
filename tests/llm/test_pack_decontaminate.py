"""Packing (exact round trip), decontamination (brute force), and the pipeline's stages."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from geospan.llm import decontaminate, packing
from geospan.llm.common import as_bytes

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = ["a  b", " lead", "tail ", "x\n y", "x \ny", "<|endoftext|> hi", "it's 's don't  're", "   ", "", "é ü  z", "1 2  3"]


def test_ids_equal_the_tokenizers_library():
    from tokenizers import Tokenizer
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    encode = packing.rank_tokenizer(PATH, PATTERN)
    for text in ODD + [" ".join(ODD) * 20]:
        assert np.frombuffer(encode(text), "<u4").tolist() == other.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_tokenizers_library_with_its_added_tokens():
    from tokenizers import Tokenizer
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.rank_tokenizer(PATH, PATTERN, packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    assert np.frombuffer(encode("a<|endoftext|>b"), "<u4").tolist() == [64, 50256, 65]
    rng = random.Random(3)
    made = ["".join(rng.choice(ODD + ["<|endoftext|>", "<|endoftext|", "  ", "a"]) for _ in range(9)) for _ in range(300)]
    for text in ODD + [" ".join(ODD) * 20] + made:
        assert np.frombuffer(encode(text), "<u4").tolist() == other.encode(text, add_special_tokens=False).ids


def test_query_and_pipeline_pack_added_tokens_as_one(spark, docs, tmp_path):
    import corpus_pipeline as P
    from geospan.llm.queries import op9_pack
    table = docs([(1, "a<|endoftext|>b")])
    table.write.parquet(f"{tmp_path}/documents.parquet")
    want = (4, zlib.crc32(np.array([64, 50256, 65, 2], "<u4").tobytes()))
    for made in (op9_pack(spark, str(tmp_path)), P.pack_sequences(spark, table, str(tmp_path))):
        assert [(r.length, r.ids_crc32) for r in made.collect()] == [want]


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing_is_an_exact_round_trip(docs, capacity):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["red", "a", "Baum", "sky!"]) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "long text " * 2500), (203, None), (None, "x"), (3, "again")]
    encode = packing.rank_tokenizer(PATH, PATTERN)
    got = packing.pack(docs(rows), PATH, PATTERN, 2, capacity=capacity).collect()
    ids = [(i, encode(t or "") + np.array([2], "<u4").tobytes()) for i, t in rows]
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    want = Counter()
    for i, b in ids:
        n, start, piece = len(b) // 4, 0, 0
        while start < n:
            length = (n % capacity or capacity) if piece == 0 else capacity
            want[i, piece, start, length, zlib.crc32(b[4 * start:4 * (start + length)])] += 1
            start, piece = start + length, piece + 1
    assert pieces == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity


def covered(plan, capacity=1024):
    made = Counter()
    for config, n in plan.items():
        assert sum(config) <= capacity
        for length in config:
            made[length] += n
    return made


@pytest.fixture(scope="module")
def real_lengths():
    """Piece lengths of the documents of sf0.1, with the contract's tokenizer."""
    import pyarrow.parquet as pq
    encode = packing.rank_tokenizer(PATH, PATTERN)
    out = Counter()
    for text in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist():
        n = len(encode(text or "")) // 4 + 1
        out[1024] += n // 1024
        out[n % 1024] += n % 1024 > 0
    return +out


def best_fit_asked(monkeypatch):
    plain, asked = packing.best_fit, []
    monkeypatch.setattr(packing, "best_fit", lambda c, capacity: asked.append(sum(c.values())) or plain(c, capacity))
    return asked


def test_plan_of_real_lengths_comes_from_the_program(real_lengths, monkeypatch):
    plain = packing.best_fit
    asked = best_fit_asked(monkeypatch)
    for times, share in ((1, 0.5), (100, 0.9)):
        counts = Counter({k: v * times for k, v in real_lengths.items()})
        plan = packing.pack_histogram(counts, 1024)
        assert covered(plan) == counts
        assert sum(plan.values()) <= sum(plain(counts, 1024).values())
        assert asked.pop() <= (1 - share) * sum(counts.values()) and not asked


def test_program_beats_best_fit_where_three_fit(monkeypatch):
    rng = random.Random(2)
    counts = Counter(rng.randint(260, 520) for _ in range(40_000))
    fit = sum(packing.best_fit(counts, 1024).values())
    asked = best_fit_asked(monkeypatch)
    plan = packing.pack_histogram(counts, 1024)
    assert covered(plan) == counts and sum(plan.values()) < 0.97 * fit
    assert asked[0] < 0.5 * sum(counts.values())
    assert not packing.pack_histogram({}, 1024)


def test_program_bound_and_gap():
    # Pairs that fill a sequence exactly: the program finds them, and its bound is their number.
    counts = {400: 500, 624: 500, 300: 200, 724: 200}
    used, bound = packing.solve_program(counts, 1024)
    assert bound == pytest.approx(700, rel=1e-3)
    assert sum(used.values()) <= 700 and all(sum(c) == 1024 for c in used)
    for length, n in counts.items():
        assert sum(c.count(length) * times for c, times in used.items()) <= n + 1e-6


def test_prices_equal_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(30):
        lengths = np.sort(rng.choice(np.arange(1, 20), 5, replace=False))
        price = rng.random(5)
        best, pick = packing.price_configurations(lengths, price, 30)
        want = np.zeros(31)
        for room in range(31):
            want[room] = max([0.0, *(price[i] + want[room - x] for i, x in enumerate(lengths) if x <= room)])
        assert np.allclose(best, want)
        held = packing._contents(pick, lengths, 30)
        assert lengths[held].sum() <= 30 and price[held].sum() == pytest.approx(want[30])


def test_packing_an_empty_table(docs):
    assert packing.pack(docs([]), PATH, PATTERN, 2).count() == 0


# ---------------------------------------------------------------- decontamination

def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination_brute(rows, items, window=13):
    phrases = {}
    for item, text in items:
        w = words(text)
        for p in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[p:p + window]), set()).add("" if item is None else str(item))
    out = []
    for i, text in rows:
        w, hit, named = words(text), set(), set()
        for n in {len(p) for p in phrases}:
            for p in range(len(w) - n + 1):
                if found := phrases.get(tuple(w[p:p + n])):
                    hit |= set(range(p, p + n))
                    named |= found
        out.append((i, len(w), len(hit), len(named), sorted(named), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("block_windows", [7, 200_000])
def test_contamination_equals_brute_force(spark, docs, block_windows):
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    items = [(i, say(rng.choice([5, 13, 14, 30]))) for i in range(8)] + [
        (50, None), (51, ""), (52, "?!"), (53, "w1"), (54, "dup dup dup dup"), (None, "nameless item"), (0, say(20))]
    rows = [(0, None), (1, ""), (2, "w1"), (3, "dup " * 30), (4, "a Nameless-ITEM b"), (5, say(5000))]
    for i in range(10, 60):
        part = rng.choice(items)[1] or ""
        rows.append((i, say(rng.randint(0, 80)) + " " + part.upper().replace(" ", ", ") + " " + say(rng.randint(0, 400))))
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, id int")
    got = decontaminate.contamination(docs(rows), table, block_windows=block_windows)
    assert sorted(map(tuple, got.collect())) == contamination_brute(rows, items)


def test_contamination_edge_cases(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(docs([(1, "a b"), (1, "a b"), (None, "a b")]), none).collect()
    assert [(r.n_hit, r.contaminated) for r in got] == [(0, False)] * 3
    assert decontaminate.contamination(docs([]), none).count() == 0


def test_proximity(spark, docs):
    table = docs([(1, "x a b c y"), (2, "y c b a x"), (3, "x " + "z " * 9 + "y")]).select(
        "doc_id", as_bytes("text").alias("text")).withColumnRenamed("doc_id", "key")
    index = decontaminate.forward_index(table.selectExpr("key as id", "text"), {b"x": 0, b"y": 1})
    pairs = spark.createDataFrame([(0, 0, 1, 0)], "pair int, first int, second int, gap int")
    near = decontaminate.proximity_matches(decontaminate.postings(index), pairs, 4).collect()
    assert sorted((r.id, r.pos, r.other) for r in near) == [(1, 0, 4), (2, 4, 0)]


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages_on_planted_documents(spark, docs, tmp_path):
    import corpus_pipeline as P
    rng = random.Random(5)
    say = lambda n: " ".join(f"t{rng.randrange(900)}" for _ in range(n))
    passage, base = say(20), say(80)
    near = base.split()
    near[40] = "changed"
    rows = [(i, say(60)) for i in range(40)]
    rows += [(100, "Same TEXT here"), (101, "same text HERE"), (110, base), (111, " ".join(near)),
             (120, say(10) + " " + passage + " " + say(10)), (130, None)]
    table = docs(rows)
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    exact = P.drop_exact_copies(spark, table, str(tmp_path))
    left = P.drop_contaminated(spark, P.drop_near_copies(spark, exact, str(tmp_path)), str(tmp_path))
    assert left.columns == table.columns
    assert {r.doc_id for r in left.collect()} == {i for i, _ in rows} - {100, 111, 120}
    packed = P.pack_sequences(spark, left, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in left.collect()}
    assert [name for name, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontaminate", "pack"]
