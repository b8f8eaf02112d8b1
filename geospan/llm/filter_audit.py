"""Filter interaction audit by a Gray-code walk over all subsets of filters.

Each document becomes a mask of the filters it fails; documents are counted by
part and mask, at most 2^n cells a part however many documents there are. One
walk over the subsets in Gray-code order toggles one filter at a time: every
mask cell holds a counter of its active failures, and a cell whose counter
leaves or reaches zero is added to or taken from the running survivors. The
survivors of all 2^n states are stored, and every step of every filter order is
the difference of two states.

The duplicate filter compares a text with all smaller ids of the table. Only
the least id of each digest is gathered, map-side combined, and rows are held
against it by (digest, id), so that the copies of one text do not meet in one
task.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geospan.llm.common import UPPER, map_rows, stored

#: Filters in the order of their bits.
FILTERS = "ABCDE"
#: Characters that filter D looks for.
ODD_CHARS = "#$%&*|"
SPACE = r"[\x20\x09-\x0D]+"
STEP_SCHEMA = ("filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
               "good_lost long, toxic_lost long, shapley long")


def text_failures(text: Column) -> Column:
    """Bits 1, 2, 4, 8 for the filters A to D; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    fails = [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n,
             100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 2 * F.length(text),
             F.translate(text, ODD_CHARS, "") != text]
    bits = [F.when(fail, 1 << i).otherwise(0) for i, fail in enumerate(fails)]
    return sum(bits[1:], bits[0])


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per document: ``id, part, mask`` (bit i: it fails the i-th of ``FILTERS``).

    A null part counts as the empty string. A document fails E if its whole
    text (null: empty) is that of a smaller id anywhere in the table; rows that
    share an id are not smaller than each other, and a null id has no smaller one.
    """
    base = stored(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                              F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"),
                              text_failures(F.col(text_col)).alias("mask")))
    known = base.filter("id is not null")
    first = known.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    tagged = known.join(first, ["digest", "id"], "left")
    repeat = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    return tagged.select("id", "part", (F.col("mask") + repeat).alias("mask")).unionByName(
        base.filter("id is null").select("id", "part", "mask"))


def mask_cells(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each part and mask, and how many are labelled so.

    An id with several label rows has a label if any of them sets it.
    """
    marks = (labels.filter(F.col(id_col).isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1)))
             .groupBy(F.col(id_col).alias("id"))
             .agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
                  F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")))
    cells = lambda df: df.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    none = masks.filter("id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return cells(masks.filter("id is not null").join(marks, "id", "left").select("part", "mask", "good", "toxic")
                 .unionByName(none))


def gray_walk(cells: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters.

    ``cells`` is (masks, ...) with what each mask cell holds; the result has the
    same shape, its row S being the sum of the cells that fail no filter of S.
    """
    failures = np.zeros(len(cells), np.int64)
    running = cells.sum(axis=0)
    states = np.empty_like(cells)
    states[0] = running
    subset = 0
    masks = np.arange(len(cells))
    for step in range(1, len(cells)):
        bit = (step & -step).bit_length() - 1
        touched = masks >> bit & 1 == 1
        subset ^= 1 << bit
        if subset >> bit & 1:
            running = running - cells[touched & (failures == 0)].sum(axis=0)
            failures[touched] += 1
        else:
            failures[touched] -= 1
            running = running + cells[touched & (failures == 0)].sum(axis=0)
        states[subset] = running
    return states


def order_steps(cells: np.ndarray, filters: str = FILTERS) -> list[tuple]:
    """Rows of ``STEP_SCHEMA``, all orders of ``filters``, from the (masks, 3) cells of one part."""
    n = len(filters)
    states = gray_walk(cells)
    masks = np.arange(len(cells))
    fails = [int(cells[masks >> i & 1 == 1, 0].sum()) for i in range(n)]
    # An order passes from subset S to S + {i} in |S|! (n - |S| - 1)! of the n! orders.
    shapley = [sum(factorial(s.bit_count()) * factorial(n - s.bit_count() - 1) * int(states[s, 0] - states[s | 1 << i, 0])
                   for s in range(len(cells)) if not s >> i & 1) for i in range(n)]
    rows = []
    for order in permutations(range(n)):
        name, before = "".join(filters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            gone = states[before] - states[after]
            rows.append((name, step, int(states[after, 0]), int(gone[0]), fails[i] - int(gone[0]), int(cells[1 << i, 0]),
                         int(gone[1]), int(gone[2]), shapley[i]))
            before = after
    return rows


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "source") -> DataFrame:
    """One row per part, filter order and step: ``part`` and the columns of ``STEP_SCHEMA``.

    All documents are counted, repeated rows each. Null and empty texts fail A
    only (and E if a smaller id has none either); a very long text is judged
    whole. Ties cannot occur: the result has no ranks. An empty table gives an
    empty result. Only id, text and part are read from ``docs`` and id, quality
    and toxic from ``labels``, so further columns never clash.
    """
    masks = failure_masks(docs, id_col, text_col, part_col)
    cells = mask_cells(masks, labels.select(id_col, "quality", "toxic"), id_col)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def walk(rows):
        out = []
        for part, held in rows:
            table = np.zeros((1 << len(FILTERS), 3), np.int64)
            for cell in held:
                table[cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
            out.extend((part, *row) for row in order_steps(table))
        return out

    return map_rows(parts, walk, f"part string, {STEP_SCHEMA}", rows_per_step=64)
