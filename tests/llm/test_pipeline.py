"""The pipeline's stages on small tables with every kind of row, and end to end."""

import random

import pytest

import corpus_pipeline as P

WORDS = [f"w{i}" for i in range(300)]
#: Names that the stages use themselves.
CLASHES = "toxicity string, toxic string, _text string, digest string, id string, row string, kept string, `a.b` string"


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(8)
    bad = ["scum", "vermin", "worthless"]
    rows, labels = [], []
    for i in range(120):
        words = prose(rng, 60).split()
        if i % 3 == 0:
            words[rng.randrange(60):0] = rng.choices(bad, k=4)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    item = prose(rng, 20)
    rows += [(200, rows[1][1]), (201, rows[1][1].upper()), (202, rows[2][1] + " tail"), (203, None), (204, ""), (None, prose(rng, 40)),
             (205, item + " " + prose(rng, 30)), (206, prose(rng, 30_000)), (207, rows[4][1]), (207, rows[4][1])]
    made = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *"abcdefgh") for i, t in rows],
                                 f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}")
    made.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_keep_all_columns_and_the_right_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = {r.doc_id for r in docs.collect() if r.doc_id is None or r.doc_id >= 120 or r.doc_id % 3}
    ids = {}
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.schema == docs.schema
        rows = kept.collect()
        assert all(tuple(r)[5:] == tuple("abcdefgh") for r in rows)
        ids[name] = sorted((r.doc_id for r in rows), key=str)
    every = sorted((r.doc_id for r in docs.collect()), key=str)
    assert set(ids["toxicity"]) == clean

    def without(*gone):
        return [i for i in every if i not in gone]
    assert ids["exact_dedup"] == without(1, 200, 203, 4)
    assert ids["near_dedup"] == without(200, 201, 202, 204, 207)
    assert ids["decontaminate"] == without(205)


@pytest.mark.parametrize("stage", [s for _, s in P.STAGES])
def test_stages_of_an_empty_table(spark, folder, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert stage(spark, docs, folder).count() == 0


def test_run_packs_what_the_stages_keep(spark, folder):
    got = P.run(spark, folder).collect()
    assert {r.doc_id for r in got if r.doc_id is not None and r.doc_id >= 120} == {201, 204, 206, 207}
    assert not {r.doc_id for r in got if r.doc_id is not None and r.doc_id < 120 and r.doc_id % 3 == 0}
    assert 205 not in {r.doc_id for r in got}
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= P.CAPACITY
