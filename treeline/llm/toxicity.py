"""Toxicity by subword-bag embeddings under a linear softmax.

A word is the average of the embeddings of its character n-grams (hashed, with word ends marked) and
of itself; a document is the average of its words; a softmax over two classes reads the document.
Embeddings and softmax are trained together in numpy. An unseen misspelling shares most n-grams with
the word it comes from, and so its vector.

The classes' difference of a linear softmax over averages is an average itself, so a document is
scored from one number for each n-gram bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, hide, map_arrow
from .words import mix64

BUCKETS, DIMS, SIZES = 1 << 17, 8, (3, 4, 5)
#: Learning reads about this many labelled documents of each class, those with the smallest hashes, and of those what
#: fits into so many bytes as bucket weights (about 20 kB each), as one task holds them.
LEARN_DOCS, LEARN_BYTES = 3000, 240_000_000
#: What an average is multiplied by before the softmax: a few telling words in a hundred must reach a verdict.
GAIN = 40.0
EPOCHS, BATCH, RATE = 8, 64, 0.02
STEPS, VALIDATE = 600, 7
#: Weight decay in units of the rate, and the documents that an n-gram must be in to be learned at all: both the best
#: of a few by three-fold cross-validation over the rows of sf0.1 that may be learned from.
DECAY, LEAST_DOCS = 1.0, 20

#: Characters of a text that are read at once; a slice ends between words.
SLICE = 250_000

_WORD_CHAR = np.full(0x110000, 2, np.uint8)  # 2: not looked up yet
_U = np.uint64


def _word_chars(codes: np.ndarray) -> np.ndarray:
    kind = _WORD_CHAR[codes]
    if (kind == 2).any():
        for c in np.unique(codes[kind == 2]):
            _WORD_CHAR[c] = chr(c).isalnum()
        kind = _WORD_CHAR[codes]
    return kind == 1


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """A text in lower case, cut where no word is cut."""
    low, a = text.lower(), 0
    while a < len(low):
        b = a + size
        while b < len(low) and low[b].isalnum():
            b += 1
        yield low[a:b]
        a = b


def _long(text: str | None, size: int) -> bool:
    return len(text or "") > size


def subwords(texts: list[str | None], sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word) of each n-gram, and (text, n-grams) of each word; words are runs of letters and digits, lower case."""
    codes = [np.frombuffer((t or "").lower().encode("utf-32-le", "replace"), np.uint32) for t in texts]
    # a blank before each text, so that no word runs over
    lengths = np.array([len(c) + 1 for c in codes], np.int64)
    joined = np.concatenate([x for c in codes for x in (np.array([32], np.uint32), c)] or [np.empty(0, np.uint32)])
    inside = _word_chars(joined)
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n_words = len(start)
    text = np.repeat(np.arange(len(texts)), lengths)[start] if n_words else np.empty(0, np.int64)
    # words side by side with their ends marked
    size = end - start + 2
    first = np.concatenate([[0], np.cumsum(size)])
    marked = np.full(int(first[-1]), 0x3C, np.uint64)
    word = np.repeat(np.arange(n_words), size)
    place = np.arange(len(marked)) - first[:-1][word] if n_words else np.empty(0, np.int64)
    body = (place > 0) & (place < size[word] - 1) if n_words else np.empty(0, bool)
    marked[body] = joined[inside]
    marked[place == size[word] - 1] = 0x3E
    buckets, owners = [], []
    h = np.zeros(len(marked), np.uint64)
    done = 0
    for n in sizes:
        for k in range(done, n):
            step = np.zeros(len(marked), np.uint64)
            step[: max(len(marked) - k, 0)] = marked[k:]
            h = h * _U(0x100000001B3) + step + _U(1)
        done = n
        at = np.flatnonzero(place + n <= size[word])
        buckets.append((mix64(h[at] + _U(n)) % _U(BUCKETS)).astype(np.int32))
        owners.append(word[at])
    # the word itself
    if n_words:
        powers = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(int(size.max()), 0x100000001B3, np.uint64)]))
        whole = np.add.reduceat(mix64(marked) * powers[place], first[:-1])
        buckets.append((mix64(whole) % _U(BUCKETS)).astype(np.int32))
        owners.append(np.arange(n_words))
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    return bucket, owner, text, np.bincount(owner, minlength=n_words)


def bags(texts: list[str | None], size: int = SLICE) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its different buckets and their weights, which sum to 1 (no words: empty). Long texts are read in slices."""
    bucket, owner, text, grams = subwords([None if _long(t, size) else t for t in texts])
    words = np.bincount(text, minlength=len(texts))
    of = text[owner]
    weight = 1.0 / grams[owner] / words[of]
    key, at = np.unique(of.astype(np.int64) * BUCKETS + bucket, return_inverse=True)
    total = np.bincount(at, weight, len(key)).astype(np.float32)
    edges = np.searchsorted(key, np.arange(len(texts) + 1) * BUCKETS)
    found = [((key[a:b] % BUCKETS).astype(np.int32), total[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    for k, t in enumerate(texts):
        if _long(t, size):
            sums, n = np.zeros(BUCKETS), 0
            for part in slices(t, size):
                bucket, owner, text, grams = subwords([part])
                sums += np.bincount(bucket, 1.0 / grams[owner], BUCKETS)
                n += len(text)
            at = np.flatnonzero(sums)
            found[k] = (at.astype(np.int32), (sums[at] / max(n, 1)).astype(np.float32))
    return found


class Model:
    """One number for each bucket, and a bias: what the softmax makes of the embeddings."""

    def __init__(self, buckets: np.ndarray, bias: float):
        self.buckets, self.bias = buckets.astype(np.float32), float(bias)

    def _sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the sum of its words' means, and its words."""
        bucket, owner, text, grams = subwords(texts)
        word = np.bincount(owner, self.buckets[bucket], len(text)) / np.maximum(grams, 1)
        return np.bincount(text, word, len(texts)).astype(np.float64), np.bincount(text, minlength=len(texts))

    def scores(self, texts: list[str | None], size: int = SLICE) -> np.ndarray:
        """Texts longer than ``size`` are read in slices, whose sums add up."""
        total, words = self._sums([None if _long(t, size) else t for t in texts])
        for k, t in enumerate(texts):
            if _long(t, size):
                for part in slices(t, size):
                    more, n = self._sums([part])
                    total[k] += more[0]
                    words[k] += n[0]
        mean = total / np.maximum(words, 1)
        return 1.0 / (1.0 + np.exp(-np.clip(GAIN * mean + self.bias, -60, 60)))


def gradients(bag: np.ndarray, e: np.ndarray, w: np.ndarray, b: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted mean cross-entropy of documents, given as [document, n-gram] weights, and its gradients by e, w and b."""
    x = bag @ e * np.asarray(GAIN, e.dtype)
    z = x @ w + b
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    at = np.arange(len(toxic))
    loss = float(-(np.log(p[at, toxic]) * weight).mean())
    p[at, toxic] -= 1
    p *= weight[:, None] / len(toxic)
    return loss, bag.T @ (p @ w.T) * np.asarray(GAIN, e.dtype), x.T @ p, p.sum(axis=0)


def train(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, share: float | None = None, seed: int = 8, epochs: int = EPOCHS, least_docs: int = LEAST_DOCS) -> Model:
    """Adam on mini-batches, embeddings and softmax weights together, classes weighing the same.

    n-grams of fewer than ``least_docs`` documents say nothing (of so few documents that none has as
    many, all count). Few rows are read more often, up to STEPS batches. One row in VALIDATE is held
    back: the bias is moved to where its F1 is largest, at the toxic ``share`` of all labels (by
    default that of the rows).
    """
    rng = np.random.default_rng(seed)
    toxic = np.asarray(toxic, np.int64)
    if not len(rows) or toxic.min() == toxic.max():
        return Model(np.zeros(BUCKETS), 40.0 if len(toxic) and toxic[0] else -40.0)
    every, every_toxic = rows, toxic
    shuffled = rng.permutation(len(rows))
    held = shuffled[: len(rows) // VALIDATE]
    rows, toxic = [every[k] for k in shuffled[len(held) :]], every_toxic[shuffled[len(held) :]]
    if toxic.min() == toxic.max():
        rows, toxic, held = every, every_toxic, held[:0]
    epochs = max(epochs, -(-STEPS * BATCH // len(rows)))
    count = np.bincount(np.concatenate([r[0] for r in rows]), minlength=BUCKETS)
    learned = np.flatnonzero(count >= min(least_docs, max(1, count.max() // 2)))
    place = np.full(BUCKETS, -1, np.int64)
    place[learned] = np.arange(len(learned))
    rows = [(place[i][place[i] >= 0], x[place[i] >= 0]) for i, x in rows]
    e = (rng.standard_normal((len(learned), DIMS)) * 0.1).astype(np.float32)
    w = (rng.standard_normal((DIMS, 2)) * 0.5).astype(np.float32)
    b = np.zeros(2, np.float32)
    moments = [np.zeros_like(x) for x in (e, e, w, w, b, b)]
    class_weight = (len(toxic) / 2.0 / np.bincount(toxic, minlength=2))[toxic].astype(np.float32)
    step = 0
    for epoch in range(epochs):
        rate = np.float32(RATE * (1 - epoch / epochs))
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            used, at = np.unique(np.concatenate([rows[k][0] for k in pick]), return_inverse=True)
            bag = np.zeros((len(pick), len(used)), np.float32)
            bag[np.repeat(np.arange(len(pick)), [len(rows[k][0]) for k in pick]), at] = np.concatenate([rows[k][1] for k in pick])
            own = e[used]
            _, ge, gw, gb = gradients(bag, own, w, b, toxic[pick], class_weight[pick])
            step += 1
            fix = np.float32(np.sqrt(1 - 0.999**step) / (1 - 0.9**step))
            # only rows met in this batch move
            m, v = moments[0][used] * 0.9 + ge * 0.1, moments[1][used] * 0.999 + ge * ge * 0.001
            moments[0][used], moments[1][used] = m, v
            e[used] = own * (1 - DECAY * rate) - rate * fix * m / (np.sqrt(v) + 1e-8)
            for value, grad, k in ((w, gw, 2), (b, gb, 4)):
                moments[k] = moments[k] * 0.9 + grad * 0.1
                moments[k + 1] = moments[k + 1] * 0.999 + grad * grad * 0.001
                value -= rate * fix * moments[k] / (np.sqrt(moments[k + 1]) + 1e-8)
    table = np.zeros(BUCKETS, np.float32)
    table[learned] = e @ (w[:, 1] - w[:, 0])
    model = Model(table, b[1] - b[0])
    if not len(held):
        return model
    logit = np.array([GAIN * float(w_ @ model.buckets[i_]) + model.bias for i_, w_ in (every[k] for k in held)])
    truth = every_toxic[held]
    if truth.min() == truth.max():
        return model
    share = float(every_toxic.mean()) if share is None else share
    weight = np.where(truth == 1, share / truth.sum(), (1 - share) / (1 - truth).sum())
    order = np.argsort(-logit)
    hit, called = np.cumsum((weight * truth)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (called + share)
    k = int(f1.argmax())
    after = logit[order][min(k + 1, len(order) - 1)]
    return Model(table, model.bias - float(logit[order][k] + after) / 2)


def learn(docs: DataFrame, labels: DataFrame, learn_docs: int = LEARN_DOCS, learn_bytes: int = LEARN_BYTES, seed: int = 8) -> Model:
    """A model of the labelled documents that are not held out; a doc_id with both labels counts as toxic. No labels: everything scores 0.

    Of several rows of a doc_id the one with the least hash of its text teaches, so ``learn_docs`` bounds the rows too.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {k: min(1.0, learn_docs / n) for k, n in counts.items()}
    if not share:
        return train([], np.empty(0, np.int64))
    pick = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id")), F.lit(1_000_003)) / 1_000_003.0
    chosen = known.filter(pick < F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col("toxic")))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                found = bags(part.column(2).to_pylist())
                packed = [pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *packed], ["doc_id", "toxic", "buckets", "weights"])

    # the chosen ids are few by their bound, so this join reads the documents without a shuffle
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))), "doc_id")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    rows = rows.filter("text is not null").withColumn("n", F.row_number().over(first)).filter("n = 1")
    rows = map_arrow(rows.select("doc_id", "toxic", "text"), gather, "doc_id long, toxic int, buckets binary, weights binary")
    toxic_share = counts.get(1, 0) / sum(counts.values())

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                held += len(r[2]) + len(r[3])
                if held <= learn_bytes:
                    got.append(r)
        model = train([(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in got], np.array([r[1] for r in got], np.int64), toxic_share, seed)
        yield pa.RecordBatch.from_arrays([pa.array([model.buckets.tobytes()], pa.binary()), pa.array([model.bias])], ["buckets", "bias"])

    # the sample is bounded, so one task trains on it; the driver gets a float for each bucket
    made = map_arrow(rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id"), fit, "buckets binary, bias double").first()
    if made is None:  # no labelled document has a text
        return train([], np.empty(0, np.int64))
    return Model(np.frombuffer(made.buckets, np.float32), made.bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` plus score (0 to 1, higher: toxic is likelier) and predicted (1 from 0.5 on).

    The whole text is read, and nothing but the text decides. A text that is null or without letters
    and digits gets what the bias alone says. A column named score or predicted is replaced; others
    pass through. An empty table gives an empty result.
    """
    docs, back = hide(docs, "text")
    at = docs.columns.index("text")
    spread = docs.sparkSession.sparkContext.broadcast((model.buckets, model.bias))  # one float for each of a fixed number of buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*spread.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found, lo, held = [], 0, 0
            for k, t in enumerate(texts):
                held += len(t or "")
                if held > 1_000_000:
                    found.append(own.scores(texts[lo : k + 1]))
                    lo, held = k + 1, 0
            found.append(own.scores(texts[lo:]))
            s = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return back(map_arrow(docs, run, schema), "score", "predicted")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
