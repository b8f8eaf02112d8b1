"""Best-fit packing of token pieces by a configuration linear program.

Texts are tokenised where they are; only the histogram of piece lengths, at
most ``capacity`` numbers, reaches the driver. There the configuration LP
(cover every length's count with as few sequences as possible) is solved by
multiplicative weights. In each round a knapsack dynamic program prices all
configurations at once: the best of all, which bounds the optimum from below,
and for each length the best that holds it. Those near the best are used as far
as the round's share of their lengths goes, and lengths that fall behind the
schedule get dearer, those ahead of it cheaper. How often each configuration is
used is rounded down, and best fit packs the rest: the fractions and the last
hundredths, which are left in the histogram's own proportions.

The resulting plan, runs of slots for each length, is bounded by the number of
configurations, not by that of the pieces; pieces are matched to slots by their
rank among pieces of equal length, which is counted in two levels so that no
length, however common, meets in one task.
"""

from __future__ import annotations

import base64
import json
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geospan.llm.common import as_bytes, map_rows_with, stored


def added_tokens(path: str) -> dict[str, int]:
    """Tokens that a ``tokenizers`` JSON adds to its vocabulary; text that spells one gets its id."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if odd := [t["content"] for t in added if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]:
        raise ValueError(f"added tokens that take more than their own text: {odd}")
    return {t["content"]: t["id"] for t in added}


def rank_tokenizer(path: str, pattern: str, added: dict[str, int] | None = None):
    """Encodes whole texts to little-endian 32-bit ids with a byte-level BPE rank file.

    With the ``added`` tokens of the vocabulary's JSON, which a rank file does
    not list, ids equal those of the ``tokenizers`` library; without, an added
    token's text is encoded like any other.
    """
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added or {})
    return lambda text: array("I", encoding.encode(text, allowed_special="all")).tobytes()


def pieces(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int, capacity: int,
           added: dict[str, int] | None = None) -> DataFrame:
    """``id, piece, start, length, ids_crc32, part, nth``: the pieces of every document.

    ``part`` and ``nth``: the task, and the rank in it among pieces of the same length.
    """
    def make():
        encode = rank_tokenizer(tokenizer_path, pattern, added)
        seen: Counter = Counter()
        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()

        def step(rows):
            out = []
            for key, text in rows:
                ids = encode(text.decode("utf-8", "replace")) + end
                n = len(ids) // 4
                first = n % capacity or capacity
                bounds = [0, *range(min(first, n), n + 1, capacity)]
                for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    out.append((key, i, a, b - a, zlib.crc32(ids[4 * a:4 * b]), part, seen[b - a]))
                    seen[b - a] += 1
            return out
        return step
    return map_rows_with(docs, make, f"id {docs.schema['id'].dataType.simpleString()}, piece int, start long, "
                         "length long, ids_crc32 long, part int, nth long", rows_per_step=128)


def price_configurations(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest total price within each room up to ``capacity``, and the item to take there (-1: a smaller room does).

    An unbounded knapsack over sorted ``lengths``.
    """
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(int(lengths[0]), capacity + 1):
        n = fitting[room]
        value = best[room - lengths[:n]] + price[:n]
        i = int(value.argmax())
        best[room], pick[room] = (value[i], i) if value[i] > best[room - 1] else (best[room - 1], -1)
    return best, pick


def _contents(pick: np.ndarray, lengths: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            out.append(int(pick[room]))
            room -= int(lengths[pick[room]])
    return out


def best_fit(counts: Counter, capacity: int) -> Counter:
    """Configurations (sorted tuples) made by best fit, longest first, over a histogram."""
    rooms: list[int] = []  # distinct free spaces, sorted
    open_: dict[int, Counter] = {}

    def put(room, contents, n):
        if room not in open_:
            insort(rooms, room)
            open_[room] = Counter()
        open_[room][contents] += n
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                fit = capacity // length
                if full := n // fit:
                    put(capacity - fit * length, (length,) * fit, full)
                if rest := n % fit:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            room = rooms[i]
            contents, free = next(iter(open_[room].items()))
            times = min(room // length, -(-n // free)) or 1
            used = min(free, max(1, n // times))
            times = min(times, n // used)
            open_[room][contents] -= used
            if not open_[room][contents]:
                del open_[room][contents]
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            put(room - times * length, contents + (length,) * times, used)
            n -= used * times
    out: Counter = Counter()
    for held in open_.values():
        for contents, n in held.items():
            out[tuple(sorted(contents, reverse=True))] += n
    return out


def solve_program(counts: dict[int, int], capacity: int, rounds: int = 25, passes: int = 30, step: float = 0.125,
                  near: float = 0.001, slack: float = 0.1, left: float = 0.03) -> tuple[dict[tuple, float], float]:
    """A fractional plan that uses no length more often than it occurs, and a lower bound of the sequences needed.

    In each of ``rounds`` an equal share of every length may be used, all but a
    share ``left`` in the end. Configurations within ``near`` of the best are used,
    for at most ``passes`` prices of the lengths that still may, while their best is
    within ``slack`` of the best of all; ``step`` is how much a length's price grows
    for each round that it is behind the average.
    """
    lengths = np.array(sorted(counts))
    need = np.array([counts[int(x)] for x in lengths], float)
    rest, weight = need.copy(), np.zeros(len(lengths))
    used: dict[tuple, float] = {}
    bound = 0.0
    for turn in range(1, rounds + 1):
        stays = (1 - (1 - left) * turn / rounds) * need
        price = lengths / capacity * np.exp(weight)
        top = price_configurations(lengths, price, capacity)[0][capacity]
        bound = max(bound, float(price @ need) / top)
        for _ in range(passes):
            open_ = np.flatnonzero(rest - stays > 1e-9 * need)
            if not len(open_):
                break
            sizes, quota = lengths[open_], (rest - stays)[open_]
            best, pick = price_configurations(sizes, price[open_], capacity)
            if best[capacity] < (1 - slack) * top:
                break
            value = price[open_] + best[capacity - sizes]
            for i in np.argsort(-value, kind="stable"):
                if value[i] < (1 - near) * best[capacity]:
                    break
                held = Counter([int(i), *_contents(pick, sizes, capacity - int(sizes[i]))])
                times = min(quota[j] / n for j, n in held.items())
                if times > 1e-9:
                    config = tuple(sorted((int(sizes[j]) for j in held.elements()), reverse=True))
                    used[config] = used.get(config, 0.0) + times
                    for j, n in held.items():
                        quota[j] -= n * times
            rest[open_] = stays[open_] + quota
        behind = (rest - stays) / need
        weight += step * (behind - behind.mean())
    return used, bound


def pack_histogram(counts: dict[int, int], capacity: int, **program) -> Counter:
    """Configurations and how often each is used; every piece of the histogram is covered exactly once.

    ``program`` is passed on to :func:`solve_program`.
    """
    left = Counter({k: v for k, v in counts.items() if v})
    plan: Counter = Counter()
    if capacity in left:
        plan[(capacity,)] = left.pop(capacity)
    if not left:
        return plan
    used, _ = solve_program(left, capacity, **program)
    for config, times in used.items():
        if n := int(times + 1e-6):
            plan[config] += n
            for length in config:
                left[length] -= n
    return plan + best_fit(+left, capacity)


def slots(plan: Counter) -> list[tuple[int, int, int, int, int]]:
    """``length, first rank, last rank, sequence of the first, offset``: runs of slots."""
    next_rank: Counter = Counter()
    out, sequence = [], 0
    for config, n in sorted(plan.items(), reverse=True):
        offset = 0
        for length in config:
            out.append((length, next_rank[length], next_rank[length] + n - 1, sequence, offset))
            next_rank[length] += n
            offset += length
        sequence += n
    return out


def stretches(runs: list[tuple[int, int, int, int, int]], most: int = 100_000) -> dict[int, int]:
    """For each length how many ranks a bucket of the slot join spans: about one run's, at most ``most``."""
    n_runs = Counter(run[0] for run in runs)
    ranks = {run[0]: 0 for run in runs}
    for length, _, last, _, _ in runs:
        ranks[length] = max(ranks[length], last + 1)
    return {length: max(1, min(most, ranks[length] // n)) for length, n in n_runs.items()}


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = 1024, added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    ``added``: tokens beside the rank file, see :func:`added_tokens`.
    Null or empty text is the end token alone. Longer documents are cut into
    pieces of ``capacity`` tokens, the first taking the remainder. Repeated and
    null ids are packed like any other row; equal lengths take their slots in the
    order of the tasks that cut them. An empty table gives no pieces. Only id and
    text are read, so further columns cannot clash.
    """
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("text"))
    cut = stored(pieces(texts, tokenizer_path, pattern, end_id, capacity, added))
    sizes = stored(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = slots(pack_histogram(histogram, capacity))
    spans = stretches(runs)
    widths = spark.createDataFrame(list(spans.items()), "length long, width long")
    # A run lies in the buckets of ranks that it reaches; a piece looks for its own in one bucket, which has few.
    places = spark.createDataFrame([(*run, spans[run[0]]) for run in runs],
                                   "length long, lo long, hi long, sequence long, offset long, width long").withColumn(
        "bucket", F.explode(F.sequence(F.expr("lo div width"), F.expr("hi div width")))).drop("width")
    before = (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")
    ranks = sizes.select("length", "part", before).join(widths, "length")
    ranked = cut.join(ranks, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth")).withColumn(
        "bucket", F.expr("rank div width"))
    return (ranked.join(places, ["length", "bucket"]).filter((F.col("lo") <= F.col("rank")) & (F.col("rank") <= F.col("hi")))
            .select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
                    (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset"))
