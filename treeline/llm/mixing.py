"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Every source is shuffled by a hash and read up to ``max_epochs`` times. A copy of a document has a
virtual finish time: the words that its source has sent until then, divided by its source's target.
Copies are range-ordered by that time over all sources and the mix ends at the total budget, so all
sources come to their targets together.

Both cumulative sums are two-level (sums of hash or time bins, then sums within a bin), so neither a
source that holds a third of all rows nor the global order ever lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, hide, n_words, partitions

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Hash bits of the shuffle.
KEY_BITS = 60


def shuffle_key(doc_id: Column, text: Column, seed: int) -> Column:
    """The place of a row in its source's shuffle: 60 bits that both engines of the tests can compute."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"), text).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """source, source_size -> source, source_size, total, target.

    A target is its source's weighted share of all words, at most ``max_epochs`` times the source; the
    excess goes to the others by weight until none is above. Ordered by size over weight the capped
    sources come first, so one pass of running sums finds the fixed point. All sums are of integers.
    """
    everything = Window.partitionBy()
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank + 1).cast("int")).cast("long")
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        by_source.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(rising), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), F.lit(0)))
        .withColumn("capped", F.col("cap") * F.col("left_weight") < F.col("left") * F.col("weight"))
        # all open sources share by weight what the first open one finds left
        .withColumn("open", F.max(F.when(~F.col("capped"), F.struct("left_weight", "left"))).over(everything))
    )
    share = (F.col("open.left") * F.col("weight")).cast("double") / F.col("open.left_weight")
    return filled.select("source", "source_size", "total", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def takes(rows: DataFrame, weights: tuple[int, ...], max_epochs: int, bin_bits: int) -> DataFrame:
    """rows: source, doc_id, _key, _size. One row for each different (source, doc_id, _key), with _source_size, _target and _takes."""
    same = ["source", "doc_id", "_key"]
    rows = rows.groupBy(*same).agg(F.sum("_size").alias("_words"))
    rows = rows.withColumn("_bin", F.shiftrightunsigned("_key", KEY_BITS - bin_bits))
    by_bin = rows.groupBy("source", "_bin").agg(F.sum("_words").alias("_bin_words"))
    goal = targets(by_bin.groupBy("source").agg(F.sum("_bin_words").alias("source_size")), weights, max_epochs)
    earlier = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bin.withColumn("_before", F.coalesce(F.sum("_bin_words").over(earlier), F.lit(0))).alias("s")
    starts = starts.join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.source", "s._bin", "s._before", "g.source_size", "g.target", "g.total")
    placed = rows.alias("r").join(starts.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r._bin") == F.col("s._bin")))
    placed = placed.select("r.*", "s._before", "s.source_size", "s.target", "s.total")
    within = Window.partitionBy("source", "_bin").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_until", F.col("_before") + F.sum("_words").over(within))
    epochs = F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda e: F.struct(e.alias("epoch"), (F.col("_until") + e * F.col("source_size")).alias("sent")))
    sends = placed.withColumn("_copy", F.explode(epochs)).withColumn("_finish", F.when(F.col("target") > 0, F.col("_copy.sent") / F.col("target")).otherwise(F.lit(0.0)))
    slots = 4 << bin_bits  # of equal width in time up to 2 (the budget ends near time 1), then by its logarithm
    late = 2 * slots + F.floor(F.log2(F.greatest("_finish", F.lit(2.0))) * (slots >> 4))
    sends = sends.withColumn("_slot", F.when(F.col("_finish") < 2, F.floor(F.col("_finish") * slots)).otherwise(late))
    by_slot = sends.groupBy("_slot").agg(F.sum("_words").alias("_slot_words"))
    passed = by_slot.withColumn("_earlier", F.coalesce(F.sum("_slot_words").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sends = sends.join(passed, "_slot")
    whole = F.col("_earlier") + F.col("_slot_words") <= F.col("total")
    # the one slot in which the budget ends is cut at a copy
    order = Window.partitionBy("_slot").orderBy("_finish", F.col("source").asc_nulls_last(), "_key", "doc_id", "_copy.epoch").rowsBetween(Window.unboundedPreceding, 0)
    cut = sends.filter(~whole & (F.col("_earlier") <= F.col("total"))).withColumn("_spent", F.col("_earlier") + F.sum("_words").over(order))
    sent = sends.filter(whole).select(*same).unionByName(cut.filter(F.col("_spent") <= F.col("total")).select(*same))
    every = placed.select(*same, F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.lit(0).alias("_take"))
    none = [F.lit(None).cast("long").alias("_source_size"), F.lit(None).cast("double").alias("_target")]
    return (
        every.unionByName(sent.select(*same, *none, F.lit(1).alias("_take")))
        .groupBy(*same)
        .agg(F.max("_source_size").alias("_source_size"), F.max("_target").alias("_target"), F.sum("_take").alias("_takes"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: int = 17, bin_bits: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all) plus _size, _source_size, _target and _takes (how often the mix reads the row).

    Needs doc_id, text and source; other columns pass through, and one of a name that is added is
    replaced. A null text has size 0; a null source is a source of its own, the last; null and
    repeated doc_ids are rows like others, and rows equal in doc_id, text and source are taken
    together. Rows of size 0 may be taken, at no cost. An empty table gives an empty result. Reruns
    agree, as the shuffle is a hash.

    The text is read once for sizes and hashes, which are written; everything else works on those.
    """
    spark = docs.sparkSession
    bin_bits = bin_bits or max(8, (4 * partitions(spark)).bit_length())
    scratch = Scratch(spark, "mix")
    thin = docs.select("source", "doc_id", shuffle_key(F.col("doc_id"), F.col("text"), seed).alias("_key"), n_words(F.col("text")).alias("_size"))
    thin = scratch.write(thin, "rows")
    taken = scratch.write(takes(thin, weights, max_epochs, bin_bits), "takes")
    if columns is not None:
        docs = docs.select(*columns)
    slim, back = hide(docs, "doc_id", "text", "source")
    if set(docs.columns) <= {"doc_id", "source"}:
        sized = thin
    else:
        sized = slim.withColumn("_key", shuffle_key(F.col("doc_id"), F.col("text"), seed)).withColumn("_size", n_words(F.col("text")))
    d, t = sized.alias("d"), taken.alias("t")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("_key", "doc_id", "source")]
    joined = d.join(t, same[0] & same[1] & same[2]).select("d.*", "t._source_size", "t._target", "t._takes")
    return scratch.keep(back(joined, "_size", "_source_size", "_target", "_takes"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, columns=["doc_id"]).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_takes") * F.col("_size")).alias("taken"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', '17', doc_id::VARCHAR, text)), 1, 15))::BIGINT AS k
  FROM documents
), s AS (
  SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight,
         3 * source_size AS cap, (SUM(source_size) OVER ())::BIGINT AS total FROM s
), f AS (
  SELECT *, total - COALESCE(SUM(cap) OVER r, 0)::BIGINT AS rest, (SUM(weight) OVER ())::BIGINT - COALESCE(SUM(weight) OVER r, 0)::BIGINT AS rest_weight
  FROM w WINDOW r AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), o AS (
  SELECT rest AS open_rest, rest_weight AS open_weight FROM f WHERE NOT cap * rest_weight < rest * weight ORDER BY rest_weight DESC LIMIT 1
), g AS (
  SELECT source, source_size, total, CASE WHEN cap * rest_weight < rest * weight THEN cap::DOUBLE
         ELSE (open_rest * weight)::DOUBLE / open_weight END AS target FROM f, o
), p AS (
  SELECT d.*, g.source_size, g.total, g.target, SUM(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS until
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), c AS (
  SELECT p.*, e.epoch, CASE WHEN target > 0 THEN (until + e.epoch * source_size)::DOUBLE / target ELSE 0.0 END AS finish
  FROM p, (SELECT unnest([0, 1, 2]) AS epoch) e
), r AS (
  SELECT *, SUM(size) OVER (ORDER BY finish, source NULLS LAST, k, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS spent FROM c
)
SELECT doc_id, size, source_size, target, (SUM(CASE WHEN spent <= total THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM r GROUP BY doc_id, source, k, size, source_size, target
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with the columns of documents."""
    slim, back = hide(docs, "doc_id", "text", "source")
    mixed = mix(slim).filter("_takes > 0")
    return back(mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_takes")))))
