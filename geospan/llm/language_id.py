"""Language ID by compression.

Each language's dictionary is raw lower-cased text of that language; a text is cut into
pieces, each compressed by zstandard with every dictionary, and the language
with the smallest total wins. Where the runner-up is nearly as small the
guess is marked as rejected.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def train_dictionaries(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs: int = 600,
                       doc_chars: int = 1200) -> dict[str, bytes]:
    """A raw-content dictionary for each language.

    From at most ``max_docs`` distinct texts a language, the ones with the
    least hash, of which a stretch of ``doc_chars`` characters is taken at a
    place that the hash gives (a common header teaches no more than its share);
    rows without language or text teach nothing. Sizes are bounded by these two
    parameters and the number of languages.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    h = F.xxhash64(text_col)
    # Distinct texts, about: copies must not lower the rate, as they are removed below.
    sizes = {r["lang"]: max(r["n"], 1) for r in known.groupBy(F.col(lang_col).alias("lang")).agg(
        F.approx_count_distinct(h).alias("n")).collect()}
    if not sizes:
        return {}
    rate = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, 6 * max_docs / n))])
    start = F.pmod(F.xxhash64(h, F.lit(1)), F.greatest(F.length(text_col) - doc_chars, F.lit(0)) + 1) + 1
    sample = (known.filter(F.pmod(h, F.lit(1_000_000)) < rate[F.col(lang_col)] * 1_000_000)
              .groupBy(F.col(lang_col).alias("lang"), h.alias("h"))
              .agg(F.first(F.substring(F.col(text_col), start.cast("int"), F.lit(doc_chars))).alias("text")))
    from pyspark.sql import Window
    sample = sample.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    parts: dict[str, list[str]] = {lang: [] for lang in sizes}
    for r in sample.filter(F.col("nth") <= max_docs).orderBy("lang", "nth").toLocalIterator():
        parts[r["lang"]].append(r["text"])
    return {lang: "\n".join(texts).lower().encode() for lang, texts in sorted(parts.items()) if texts}


class Compressors:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], piece: int = 2048, level: int = 5):
        import zstandard
        self.langs, self.piece, self.coders = list(dictionaries), piece, []
        for content in dictionaries.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_checksum=False,
                                                        write_content_size=False, write_dict_id=False))

    def sizes(self, text: bytes) -> list[int]:
        pieces = [text[i:i + self.piece] for i in range(0, len(text), self.piece)]
        return [sum(map(len, map(c.compress, pieces))) for c in self.coders]

    def guess(self, text: str) -> tuple[str, float, int, int]:
        """Language, score (0 to 1), its size and the runner-up's."""
        if not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0, 0, 0
        sizes = self.sizes(text.lower().encode("utf-8", "replace"))
        best = min(range(len(sizes)), key=lambda i: (sizes[i], self.langs[i]))
        rest = [s for i, s in enumerate(sizes) if i != best]
        score = 1 / (1 + sum(2.0 ** (-min(s - sizes[best], 400) / 2) for s in rest))
        return self.langs[best], score, sizes[best], min(rest, default=sizes[best])


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text",
             reject_margin: float = 0.01) -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` and ``rejected``; columns of these names are replaced.

    ``lang_pred`` is ``und`` for a null text or one without a letter, and if
    nothing was learned; ties go to the first language by name. ``rejected``:
    ``und``, or the runner-up's size is within ``reject_margin`` of the best.
    Only the whole text is looked at.
    """
    import pandas as pd
    from collections.abc import Iterator
    from pyspark.sql.functions import pandas_udf
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        coders = Compressors(shared.value)
        for texts in batches:
            rows = [coders.guess(t) for t in texts.fillna("")]
            yield pd.DataFrame({"lang": [r[0] for r in rows], "score": [r[1] for r in rows],
                                "narrow": [r[3] - r[2] <= reject_margin * r[2] for r in rows]})
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    guess = pandas_udf(run, "lang string, score double, narrow boolean")(F.col(text_col))
    kept = docs.drop("lang_pred", "lang_score", "rejected")
    return (kept.withColumn("_guess", guess).select(
        *kept.columns, F.col("_guess.lang").alias("lang_pred"), F.col("_guess.score").alias("lang_score"),
        F.col("_guess.narrow").alias("rejected")))
