"""Spelling variants of the words of a corpus, by letter-parity bitmask bands.

1. Every text is scanned once. Words are counted by batch, then over all documents.
2. A word's mask has one bit for each letter (accented ones share some), set if the letter occurs an
   odd number of times. One inserted, deleted or replaced letter flips at most two bits, so of three
   bands of the mask one at least stays as it is.
3. Words meet on an equal band. Lengths differ by one at most, and one edit leaves half of the shorter
   word alone, at the front or at the back; both are part of the key, so the words that share a band
   value, however many, are compared only within equal halves.
4. A pair counts in the first band and side that it shares, and is verified by edit distance.
5. Forms are followed to the last by pointer jumping; counts grow tenfold at each step, so chains are short.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow

LEAST_LENGTH, LEAST_N, RATIO, EVERY = 7, 2, 10, 31
#: Different words that a task remembers before it hands their counts on.
REMEMBERED = 200_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PIECE = 1_000_000


def pieces(text: str, size: int = _PIECE) -> Iterator[str]:
    """A text in pieces that cut no run of letters."""
    lo = 0
    while len(text) - lo > size:
        hi = lo + size
        while hi < len(text) and (text[hi].isascii() and text[hi].isalpha() or "À" <= text[hi] <= "ÿ"):
            hi += 1
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def counted(docs: DataFrame, least: int = LEAST_LENGTH, every: int = EVERY) -> DataFrame:
    """word, n of all words of at least so many code points; one (document, run) in ``every`` loses a letter."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def table(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for piece in pieces(text.as_py()):
                    found = Counter(runs.findall(piece.encode().translate(_LOWER).decode()))
                    for run, n in found.items():
                        h = zlib.crc32(run.encode(), start)
                        if h % every == 0:
                            k = h % len(run)
                            run = run[:k] + run[k + 1 :]
                            if len(run) < least:
                                continue
                        counts[run] += n
                    if len(counts) > REMEMBERED:
                        yield table(counts)
                        counts = Counter()
        yield table(counts)

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(thin, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def mask(word: Column) -> Column:
    """The parities of a word's letters: bits 0 to 25 for a to z, 26 to 63 for accented letters."""
    code = lambda c: F.when(F.ascii(c) < 128, F.ascii(c) - 97).otherwise(26 + (F.ascii(c) - 192) % 38)
    flip = lambda held, c: held.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), code(c).cast("int")))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), flip)


def _bits(band: int) -> int:
    """The bits of a band, every third, as a signed number."""
    bits = sum(1 << k for k in range(band, 64, 3))
    return bits - (1 << 64) if bits >> 63 else bits


def _keyed(words: DataFrame, longer: bool) -> DataFrame:
    """A row for each band and side of each word, as the shorter or the longer one of a pair."""
    short = F.length("word") - (1 if longer else 0)
    half = F.ceil((short - 1) / 2).cast("int")
    bands = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col("mask").bitwiseAND(F.lit(_bits(b))).alias("value")) for b in range(3)]))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), half).alias("part")), F.struct(F.lit(1).alias("side"), F.right("word", half).alias("part"))))
    rows = words.select("word", "n", "mask", short.alias("short"), half.alias("half"), bands.alias("b"))
    return rows.select("word", "n", "mask", "short", "half", F.col("b.band").alias("band"), F.col("b.value").alias("value"), sides.alias("s")).select(
        "word", "n", "mask", "half", F.xxhash64("short", "band", "value", "s.side", "s.part").alias("key"), "short", "band", "value", F.col("s.side").alias("side"), F.col("s.part").alias("part")
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """words: word, n -> a, b, n_a, n_b of each two words that one edit apart, once; a is the shorter or, of equal lengths, the smaller."""
    masked = words.withColumn("mask", mask(F.col("word")))
    left = _keyed(masked, False)
    right = left.withColumn("longer", F.lit(False)).unionByName(_keyed(masked, True).withColumn("longer", F.lit(True)))
    a, b = left.alias("a"), right.alias("b")
    apart = F.col("a.mask").bitwiseXOR(F.col("b.mask"))
    first_band = F.lit(True)
    for band in range(2):
        first_band &= (F.col("a.band") <= band) | (apart.bitwiseAND(F.lit(_bits(band))) != 0)
    first_side = (F.col("a.side") == 0) | (F.substring("a.word", F.lit(1), F.col("a.half")) != F.substring("b.word", F.lit(1), F.col("a.half")))
    same = F.col("a.key") == F.col("b.key")
    for c in ("short", "band", "value", "side", "part"):
        same &= F.col(f"a.{c}") == F.col(f"b.{c}")
    fits = (F.col("b.longer") | (F.col("a.word") < F.col("b.word"))) & (F.bit_count(apart) <= 2) & first_band & first_side
    pairs = a.join(b, same & fits & (F.levenshtein("a.word", "b.word", 1) == 1))
    return pairs.select(F.col("a.word").alias("a"), F.col("b.word").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))


def variants(docs: DataFrame, least: int = LEAST_LENGTH, least_n: int = LEAST_N, ratio: int = RATIO, every: int = EVERY) -> DataFrame:
    """word, form, root, n, n_near, form_n of each different word of all texts.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A to Z in lower case, of at least ``least``
    code points and ``least_n`` occurrences. A null or empty text has none; a null doc_id is written as
    nothing before the colon; rows equal in all columns count once each. Ties of a form go to the
    smallest word in code-point order. An empty table gives an empty result; other columns are ignored.
    A long text is scanned in pieces, so a task holds one text and the words that it remembers.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.write(counted(docs, least, every).filter(F.col("n") >= least_n), "words")
    pairs = near_pairs(words)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("m"))))
    best = pairs.select(both.alias("p")).select("p.*").groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    top = -F.col("best.less")
    some = top >= ratio * F.col("n")
    best = scratch.write(best.select("word", "n_near", F.when(some, F.col("best.near")).alias("form"), F.when(some, top).alias("form_n")), "best")
    roots = scratch.write(best.filter("form is not null").select("word", F.col("form").alias("root")), "roots0")
    step = 0
    while True:  # each round doubles how far a root is followed
        step += 1
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = scratch.write(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots{step}")
        scratch.drop(f"roots{step - 1}")
        roots = now.select("word", "root")
        if now.filter("moved").isEmpty():
            break
    out = words.join(best, "word", "left").join(roots, "word", "left")
    return scratch.keep(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: Runs and their CRC by a table of 256 steps; near words by what is left without one code point.
OP13_SQL = r"""
WITH RECURSIVE t AS MATERIALIZED (SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1))) ORDER BY k) AS crc FROM (SELECT unnest(range(256)) AS k)),
r AS MATERIALIZED (SELECT COALESCE(doc_id::VARCHAR, '') AS id, run, COUNT(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY 1, 2),
b AS (SELECT id, run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195::BIGINT, unicode(ch)::BIGINT - 64] END)) AS bytes FROM r),
h AS (SELECT run, n, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]))) AS h FROM b, t),
w AS MATERIALIZED (SELECT word, SUM(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM h) WHERE length(word) >= 7 GROUP BY word HAVING SUM(n) >= 2),
x AS MATERIALIZED (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
l AS MATERIALIZED (SELECT DISTINCT x.word AS a, y.word AS b FROM x JOIN x y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word UNION SELECT x.word, w.word FROM x JOIN w ON x.rest = w.word UNION SELECT w.word, x.word FROM x JOIN w ON x.rest = w.word),
m AS MATERIALIZED (SELECT a.word, a.n, COUNT(b.word) AS n_near, arg_min(b.word, (-b.n, b.word)) AS near, MAX(b.n) AS near_n FROM w a LEFT JOIN l ON l.a = a.word LEFT JOIN w b ON b.word = l.b GROUP BY a.word, a.n),
f AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM m),
c(word, root) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f e ON e.word = c.root WHERE e.form IS NULL
"""
