"""Language identification by rank-order profiles.

A profile lists a language's most frequent character n-grams (1 to 3 letters, a run of other
characters counting as one blank) by falling frequency. A document's own list is compared with each
profile by out-of-place distance: the sum over its n-grams of how far apart the two ranks are, and
the length of a profile for an n-gram that the profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, hide, map_arrow

#: n-grams in a profile and in a document's list.
PROFILE = 400
#: Learning reads about this many documents of each language, those with the smallest hashes.
LEARN_DOCS = 4000
#: Characters of a text that are read at once.
SLICE = 1_000_000
#: The pipeline drops documents that are less like every profile than this. Prose of a learned language
#: is far above it, however short.
LEAST_SCORE = 0.05

_LETTER = np.full(0x110000, 2, np.uint8)  # 2: not looked up yet


def _letters(codes: np.ndarray) -> np.ndarray:
    kind = _LETTER[codes]
    if (kind == 2).any():
        for c in np.unique(codes[kind == 2]):
            _LETTER[c] = chr(c).isalpha()
        kind = _LETTER[codes]
    return kind == 1


def _together(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the same codes added up."""
    if len(parts) == 1:
        return parts[0]
    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)


def grams(text: str | None, size: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a whole text as 63-bit codes, ascending, and their counts.

    A text is read in slices of ``size`` characters, each with the two codes before it, so that a text
    of any length needs no more than a slice and its different n-grams.
    """
    low = (text or "").lower()
    parts: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    pending, before = 0, False
    # a blank is code 1, so n-grams of different lengths have different codes; one stands for each run of other characters
    tail = np.array([1], np.int64)
    for a in range(0, len(low), size):
        codes = np.frombuffer(low[a : a + size].encode("utf-32-le", "replace"), np.uint32)
        is_letter = _letters(codes)
        new = np.where(is_letter, codes, 1).astype(np.int64)[is_letter | np.concatenate([[before], is_letter[:-1]])]
        before = bool(is_letter[-1])
        if before and a + size >= len(low):
            new = np.append(new, 1)
        x, t = np.concatenate([tail, new]), len(tail)
        two = x[:-1] | x[1:] << 21
        three = two[:-1] | x[2:] << 42
        # a blank alone is no unigram; a blank in the middle is no n-gram of one word
        from_ = max(t - 2, 0)
        found = np.concatenate([new[new > 1], two[t - 1 :], three[from_:][x[1 + from_ : -1] > 1]])
        parts.append(np.unique(found, return_counts=True))
        tail, pending = x[-2:], pending + len(parts[-1][0])
        if pending > len(parts[0][0]) + size:
            parts, pending = [_together(parts)], 0
    return _together(parts)


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, ties by code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        few = counts >= least
        codes, counts = codes[few], counts[few]
    return codes[np.lexsort((codes, -counts))][:size]


class Profiles:
    """Learned profiles: language -> codes by falling frequency. At most PROFILE codes for each language."""

    def __init__(self, by_lang: dict[str, list[int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted(by_lang)
        self.sorted, self.ranks = [], []
        for lang in self.langs:
            codes = np.array(by_lang[lang], np.int64)
            order = np.argsort(codes)
            self.sorted.append(codes[order])
            self.ranks.append(order)

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = grams(text)
        if not len(codes) or not self.langs:
            return "und", 0.0
        mine = top(codes, counts, self.size)
        place, best = np.arange(len(mine)), None
        for lang, known, ranks in zip(self.langs, self.sorted, self.ranks, strict=True):
            at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            away = np.where(known[at] == mine, np.abs(ranks[at] - place), self.size)
            distance = int(np.minimum(away, self.size).sum())
            if best is None or distance < best[0]:
                best = (distance, lang)
        return best[1], 1.0 - best[0] / (self.size * len(mine))


def learn(docs: DataFrame, size: int = PROFILE, learn_docs: int = LEARN_DOCS) -> Profiles:
    """Profiles from text and non-null lang of the rows that are not held out.

    At most about ``learn_docs`` documents of each language: a share of its rows that its count
    gives, picked by hash. Only the profiles (languages times ``size`` rows) reach the driver.
    """
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    share = known.groupBy("lang").agg((F.lit(float(learn_docs)) / F.count(F.lit(1))).alias("share")).collect()
    if not share:
        return Profiles({}, size)
    pick = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id"), F.col("text")), F.lit(1_000_003)) / 1_000_003.0
    chosen = known.join(F.broadcast(docs.sparkSession.createDataFrame([(r.lang, r.share) for r in share], "lang string, share double")), "lang")
    chosen = chosen.filter(pick < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        pending = 0

        def merged() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, counts = _together(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "code", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = grams(text)
                held.setdefault(lang, []).append(found)
                pending += len(found[0])
                if pending > 2_000_000:
                    yield from merged()
                    pending = 0
        yield from merged()

    counts = map_arrow(chosen, count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    ranked = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).collect()
    by_lang: dict[str, list[int]] = {r.lang: [] for r in share}
    for r in sorted(ranked, key=lambda r: (r.lang, r.rank)):
        by_lang[r.lang].append(r.code)
    return Profiles({k: v for k, v in by_lang.items() if v}, size)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """All columns of ``docs`` plus lang_pred and score (1: the document's list is the profile, 0: shares nothing).

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was
    learned. Ties between languages go to the first in code point order. Other columns pass through; a
    column named lang_pred or score is replaced. Nothing but the text decides.
    """
    docs, back = hide(docs, "text")
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t) for t in batch.column(at).to_pylist()]
            added = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return back(map_arrow(docs, score, schema), "lang_pred", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that are like no language learned."""
    slim, back = hide(docs, "doc_id", "text", "lang")
    found = identify(slim, learn(slim))
    return back(found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)))
