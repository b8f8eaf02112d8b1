"""One conversion of an id at a time, whatever the number of runs."""

import os
import time
from concurrent.futures import ThreadPoolExecutor

import pytest

from geospan.operators.convlog import COMPLETE, FAILED, PROCESSING
from geospan.plans import convert
from geospan.streaming.convlog import LOG_SCHEMA


def test_one_of_many_claims_wins(spark, tmp_path):
    for n in range(5):
        path = str(tmp_path / "claims" / str(n))
        with ThreadPoolExecutor(16) as pool:
            assert sum(pool.map(lambda _: convert.claim(spark, path), range(16))) == 1
        assert not convert.claim(spark, path)
        convert.release(spark, path)
        assert convert.claim(spark, path)
        old = time.time() - 7200
        os.utime(path, (old, old))
        assert not convert.claim(spark, path, hours=3)
        with ThreadPoolExecutor(8) as pool:
            assert sum(pool.map(lambda _: convert.claim(spark, path, 1), range(8))) == 1


def test_concurrent_runs_convert_once(spark, tmp_path):
    source = tmp_path / "data.tsv"
    source.write_text("id\tWGS84 WKT\n1\tPOINT (25 60)\n", encoding="utf-8")
    log = str(tmp_path / "log")

    def run(n, path=str(source)):
        return convert.convert_export(spark, path, str(tmp_path / f"out{n}"), kind="flat", geometry_type="point", filename="a", log_dir=log)
    with pytest.raises(Exception):
        run(9, str(tmp_path / "gone.tsv"))
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(run, range(4)))
    assert sorted(bool(d.get("skipped")) for d in done) == [False, True, True, True]
    log_rows = spark.read.schema(LOG_SCHEMA).parquet(log)
    assert sorted(r.status for r in log_rows.collect()) == sorted([PROCESSING, FAILED, PROCESSING, COMPLETE])
    assert run(5).get("skipped") and not [p for p in os.listdir(log + "-claims") if not p.startswith(".")]
