"""The corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, packing.

Every stage takes what its predecessor kept; all but the last return the
columns of ``documents``. Stages are written as Parquet in the cluster's
shared folder and read again, so a lost executor never sends the work back
over a stage boundary.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geospan.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from geospan.llm.common import held_out, stored, table
from geospan.llm.queries import CAPACITY, END_ID, TOKENIZER, VOCABULARY


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but those whose id is in ``ids``; rows with a null id stay."""
    return docs.join(stored(ids.distinct()), "doc_id", "left_anti").select(*_columns(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; labels of held-out rows are not looked at.

    Null and empty texts have a score like any other, very long ones are scored
    whole, equal texts alike, and repeated rows stay or go together. Without
    labels of both kinds nothing is dropped unless all labels say toxic. All
    columns come through as they are, whatever their names; an empty table
    gives an empty one.
    """
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id", 4))
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    rows = docs.select(F.struct(*_columns(docs)).alias("row"), F.col("text"))
    return toxicity.score_toxicity(rows, model).filter("toxic = 0").select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the largest doc_id.

    Null and empty texts are equal; a very long text is compared whole. Rows
    that repeat id and text are one document and stay together. Rows without an
    id always stay. All columns come through; an empty table gives an empty one.
    """
    return _without(docs, exact_dedup.exact_dedup(docs).filter("not kept").select("doc_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each class of near copies.

    Texts without a word are one class. A very long text is compared whole.
    Repeated rows stay or go together; rows without an id always stay. All
    columns come through; an empty table gives an empty one.
    """
    return _without(docs, near_dedup.near_classes(docs).filter("not kept").select("doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which passages of the benchmark make up less than a twentieth.

    Texts without a word stay; a very long text is searched whole. Repeated rows
    stay or go together; rows without an id always stay. All columns come
    through; an empty table gives an empty one, an empty benchmark drops nothing.
    """
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.filter("contaminated").select("doc_id"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the remaining documents, packed into sequences.

    Null and empty texts are an end token each; a very long text is cut into
    pieces. Each repeated row is packed; equal lengths take their slots in the
    order of the tasks that cut them. Columns but id and text are not read; an
    empty table gives no pieces.
    """
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, END_ID, capacity=CAPACITY,
                        added=packing.added_tokens(public_tokenizers.path(TOKENIZER)))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies),
          ("decontaminate", drop_contaminated), ("pack", pack_sequences)]

#: Toxicity, near-dedup and packing have no SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
