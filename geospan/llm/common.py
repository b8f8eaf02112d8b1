"""Helpers that several operators share."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geospan.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def residue(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def held_out(id_col: str, modulus: int) -> Column:
    """True where the residue is 2; a null id counts as held out (nothing is learned from it)."""
    return F.coalesce(residue(id_col, modulus) == 2, F.lit(True))


def fold_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared checkpoint folder and reads it back.

    It cuts the lineage (a lost executor re-reads files instead of redoing the
    work) and gives the planner true sizes. The folder is scratch space.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows where the session has Spark's 10,000: rows hold whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def map_rows(df: DataFrame, fn: Callable[[list], list], schema: str, rows_per_step: int = 512) -> DataFrame:
    """Applies ``fn`` to short lists of row tuples; ``fn`` returns tuples of ``schema``.

    Rows pass through in steps of ``rows_per_step``, so what a task holds does
    not depend on the size of its partition.
    """
    short_batches(df.sparkSession)
    return df.mapInArrow(_stepper(lambda: fn, _arrow_schema(df, schema), rows_per_step), schema)


def map_rows_with(df: DataFrame, make: Callable[[], Callable[[list], list]], schema: str,
                  rows_per_step: int = 512) -> DataFrame:
    """Like ``map_rows``, with ``make()`` called once in each task (caches, tokenizers).

    What it returns may have a ``finish``, which gives the task's last rows, or
    a ``drain``, which yields them batch by batch as tuples of columns.
    """
    short_batches(df.sparkSession)
    return df.mapInArrow(_stepper(make, _arrow_schema(df, schema), rows_per_step), schema)


def _arrow_schema(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def _stepper(make, schema, step):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out = fn(list(zip(*(c.to_pylist() for c in part.columns))))
                if out:
                    yield _batch(zip(*out), schema)
        if finish := getattr(fn, "finish", None):
            if out := finish():
                yield _batch(zip(*out), schema)
        if drain := getattr(fn, "drain", None):
            for columns in drain():
                yield _batch(columns, schema)
    return run


def _batch(columns, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def share(spark: SparkSession, value) -> Callable:
    """Broadcasts ``value``; the function returned gives it, to be called once in each task.

    Unlike a plain broadcast it pickles classes of this package by value.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def as_bytes(column: str) -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias(column)
