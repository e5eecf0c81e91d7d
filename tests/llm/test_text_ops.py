"""BPE, shards, substring dedup, mixing, near duplicates, language ID and toxicity against brute force, with odd inputs."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from treeline.llm import bpe, common, langid, mixing, ngram_join, sst, substring_dedup, toxicity, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def keyed(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# op1


def test_bpe_is_the_library(library):
    rng = random.Random(1)
    letters = [chr(c) for c in [*range(1, 0x250), 0x3B1, 0x4E00, 0x1680, 0x2003, 0x200B, 0x3000, 0x660, 0x1F600, 0x300]]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", "<|endoftext|>", "a <|endoftext|>b", "  x \n\n y\t", "don't 's!'s", "a" * 3000, "ab" * 900 + " " * 300]
    own = bpe.ForcedBoundaryBPE(bpe.default_path())
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(text) == want.ids
        assert own.encode_array(text).tolist() == want.ids
        assert own.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False) == text


def test_no_token_spans_a_forced_boundary():
    own = bpe.ForcedBoundaryBPE(bpe.default_path())
    word = "zzqxjkwvAé".encode()
    assert b"".join(own.fragments(word)) == word
    cuts = np.cumsum([len(f) for f in own.fragments(word)])[:-1]
    for c in cuts:
        assert not any(word[c - 1 : c + 1] in t for t in own.table[:50256])


def test_bpe_table(odd_docs, no_docs, library):
    got = keyed(bpe.encode_table(odd_docs).select(F.coalesce("doc_id", F.lit(-1)).alias("i"), "n_tokens", "ids_sha256", "decoded_sha256"), "i", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for r in odd_docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((-1 if r.doc_id is None else r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert bpe.encode_table(no_docs).count() == 0
    assert bpe.encode_table(odd_docs, keep_ids=True).filter("size(ids) <> n_tokens").count() == 0


# op3


def test_shard_file():
    out = io.BytesIO()
    writer = sst.Writer(out)
    rng = random.Random(2)
    rows = [(None, [7])] + [(i // 2 - 50, [rng.randrange(50_000) for _ in range(rng.choice([0, 1, 900]))]) for i in range(400)]
    for i, ids in rows:
        writer.add(i, np.array(ids))
    writer.close()
    reader = sst.Reader(out)
    assert [(i, x.tolist()) for i, x in reader] == rows
    assert len(reader.at) > 1 and reader.docs == len(rows)
    for i in (None, -50, 0, 149):
        assert [x.tolist() for x in reader.get(i)] == [ids for k, ids in rows if k == i]
    assert sum(reader.may_have(i) for i in range(1000, 3000)) < 60 and reader.get(5000) == []
    writer = sst.Writer(io.BytesIO())
    writer.add(2, np.array([1]))
    with pytest.raises(ValueError):
        writer.add(1, np.array([1]))


def test_shards_round_trip(spark, odd_docs, no_docs, library):
    folder = common.Scratch(spark, "t").path("s")
    manifest = sst.write_shards(odd_docs, folder, shards=3).cache()
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in sst.read_shards(manifest, folder).collect()))
    want = []
    for r in odd_docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [sst.END_ID]
        want.append((-1 if r.doc_id is None else r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert got == sorted(want)
    rows = sorted(sst.read_shards(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id is None for r in rows[:2]] == [True, True]
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()
    assert sst.read_shards(sst.write_shards(no_docs, folder, shards=2).cache(), folder).count() == 0


# op2


def brute_dedup(texts, width):
    split = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[k : k + width]) for w in split for k in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("bucket", [2_000, 10_000_000])
def test_substring_dedup(odd_docs, bucket):
    rows = odd_docs.collect()
    want = sorted((-1 if r.doc_id is None else r.doc_id, *b) for r, b in zip(rows, brute_dedup([r.text for r in rows], 35), strict=True))
    got = substring_dedup.dedup(odd_docs, bucket_bytes=bucket).select(F.coalesce("doc_id", F.lit(-1)).alias("i"), "_n_words", "_n_removed", "_kept")
    assert keyed(got, "i", "_n_words", "_n_removed", "_kept") == want
    assert max(n for _, _, n, _ in want) > 0


def thue_morse(n, letters="ab"):
    return [letters[k.bit_count() % 2] for k in range(n)]


def test_hashes_of_thue_morse_words():
    """Words and sequences that differ in nothing but their pattern, which powers of an odd base modulo 2^64 can't tell apart."""
    for n in (512, 1024, 4096):
        pair = ["".join(thue_morse(n)), "".join(thue_morse(n, "ba"))]
        found = words.words_of(pa.array(pair))
        assert found.hash[0] != found.hash[1]
        a, b = (words.words_of(pa.array([" ".join(thue_morse(n, ("x", "y")[::k]))])).hash for k in (1, -1))
        for lane in (0, 1):
            assert words.sequence_hash(a, np.array([0]), n, lane) != words.sequence_hash(b, np.array([0]), n, lane)
        sets, begin = words.shingle_sets(words.words_of(pa.array([f"{w} a b c d e f" for w in pair])))
        keys = ngram_join.set_keys(sets, begin)
        assert keys[0] != keys[1]


def test_sequence_hashes_are_of_the_words():
    rng = random.Random(11)
    text = [f"w{rng.randrange(3)}" for _ in range(400)]
    found = words.words_of(pa.array([" ".join(text)]))
    at = np.array([rng.randrange(300) for _ in range(3000)])
    length = np.array([rng.choice([0, 1, 2, 3, 5, 8, 9, 35, 64, 70]) for _ in at])
    one, two = (words.sequence_hash(found.hash, at, length, lane) for lane in (0, 1))
    by_words = {}
    for k, (a, n) in enumerate(zip(at, length, strict=True)):
        by_words.setdefault(tuple(text[a : a + n]), set()).add((int(one[k]), int(two[k])))
    assert all(len(v) == 1 for v in by_words.values())
    assert len({h for v in by_words.values() for h in v}) == len(by_words)


def test_odd_words_in_substring_dedup_and_joins(spark):
    pair = ["".join(thue_morse(1024)), "".join(thue_morse(1024, "ba"))]
    base = [f"c{k}" for k in range(34)]
    texts = [" ".join([*base, pair[0]]), " ".join([*base, pair[1]]), " ".join(thue_morse(512, ["x", "y"])), " ".join(thue_morse(512, ["y", "x"]))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert keyed(substring_dedup.dedup(docs), "doc_id", "_n_words", "_n_removed", "_kept") == [(k, *b) for k, b in enumerate(brute_dedup(texts, 35))]
    rows, nodes, _ = ngram_join.near_duplicates(docs)
    assert nodes.count() == rows.select("set_key").distinct().count() == len({frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in map(str.split, texts)})


def test_equal_rows_are_spread(spark):
    rng = random.Random(12)
    text = " ".join(f"r{rng.randrange(10**6)}" for _ in range(60))
    rows = [(1, text)] * 40 + [(None, text)] * 40 + [(2, text + " end"), (3, "short")] + [(k, " ".join(f"u{rng.randrange(10**6)}" for _ in range(50))) for k in range(10, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((-1 if i is None else i, *b) for (i, _), b in zip(rows, brute_dedup([t for _, t in rows], 35), strict=True))
    got = substring_dedup.dedup(docs, bucket_bytes=2_000).select(F.coalesce("doc_id", F.lit(-1)).alias("i"), "_n_words", "_n_removed", "_kept")
    assert keyed(got, "i", "_n_words", "_n_removed", "_kept") == want


def test_substring_dedup_of_mixed_passages(spark):
    rng = random.Random(5)
    pool = [[f"p{rng.randrange(30)}" for _ in range(50)] for _ in range(4)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(pool)
            a = rng.randrange(20)
            parts += p[a : a + rng.randint(5, 50)] + [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 12))]
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for width, gram in ((6, 3), (12, 5)):
        got = keyed(substring_dedup.dedup(docs, width, gram, bucket_bytes=3000), "doc_id", "_n_words", "_n_removed", "_kept")
        assert got == [(i, *b) for i, b in enumerate(brute_dedup(texts, width))]


def test_dedup_stage(odd_docs, no_docs):
    out = substring_dedup.stage(odd_docs.sparkSession, odd_docs, "")
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert out.filter("_size <> 1 OR _row <> 2.0 OR n <> 'y' OR `a.b` <> 3").count() == 0
    assert substring_dedup.stage(no_docs.sparkSession, no_docs, "").count() == 0


# op5


def test_mix(odd_docs, no_docs):
    rows = mixing.mix(odd_docs, bin_bits=3).collect()
    assert len(rows) == odd_docs.count()
    size = Counter()
    target, taken = {}, Counter()
    for r in rows:
        assert r._size == len(WORD.findall(r.text or "")) and 0 <= r._takes <= 3
        size[r.source] += r._size
        target[r.source] = r._target
        taken[r.source] += r._takes * r._size
    assert all(r._source_size == size[r.source] for r in rows)
    total = sum(size.values())
    assert sum(target.values()) == pytest.approx(total) and sum(taken.values()) <= total
    # water filling by hand
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    want, open_ = {}, set(names)
    while True:
        left = total - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            want |= share
            break
        want |= {s: 3.0 * size[s] for s in over}
        open_ -= over
    assert target == pytest.approx(want)
    again = mixing.mix(odd_docs.repartition(5), bin_bits=3)
    assert sorted(map(str, rows)) == sorted(map(str, again.collect()))
    assert mixing.mix(no_docs).count() == 0


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), f"s{min(rng.randrange(9), 5)}", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = mixing.mix(docs).groupBy("source").agg(F.max("_target").alias("t"), F.sum(F.col("_takes") * F.col("_size")).alias("k")).collect()
    for r in out:
        assert r.k == pytest.approx(r.t, rel=0.02)
    staged = mixing.stage(spark, docs, "")
    assert staged.columns == docs.columns
    assert staged.count() == mixing.mix(docs).agg(F.sum("_takes")).first()[0]


# op6


def brute_links(texts, width=5, threshold=0.8):
    sets = []
    for t in texts:
        w = WORD.findall(t or "")
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    n = len(texts)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return links, [find(i) for i in range(n)]


def test_ngram_join_matches_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    texts = []
    for _ in range(12):
        base = [f"v{rng.randrange(3000)}" for _ in range(90)]
        for _ in range(rng.choice([1, 2, 9])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(90)] = f"z{rng.randrange(9999)}"
            texts.append(" ".join(w))
    texts += ["", None, " ", "a b c", "a  b\tc", "a b c d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links, root = brute_links(texts)
    for tile in (2, 256):
        monkeypatch.setattr(ngram_join, "TILE_TEXTS", tile)
        rows, nodes, _ = ngram_join.near_duplicates(docs)
        found = rows.join(nodes, "set_key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("c"), F.coalesce("n_links", F.lit(0)).alias("n"))
        assert keyed(found, "doc_id", "c", "n") == [(i, root[i], links[i]) for i in range(len(texts))]


def test_ngram_stage(odd_docs, no_docs):
    out = ngram_join.stage(odd_docs.sparkSession, odd_docs, "")
    assert out.columns == odd_docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(7) == 1 and 1 in ids and 2 not in ids and 3 not in ids and ids.count(14) == 2 and 4 in ids and 5 in ids and 6 in ids
    assert ngram_join.stage(no_docs.sparkSession, no_docs, "").count() == 0


def test_banding_keeps_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.95), (1.0, 0.99)):
        bands, rows = ngram_join.banding(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall or threshold == 1.0


# op10


def test_grams_match_brute_force():
    def plain(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        text, n = f" {' '.join(words)} ", Counter()
        for k in range(1, 4):
            for i in range(len(text) - k + 1):
                g = text[i : i + k]
                if g.strip() and not (k == 3 and g[1] == " "):
                    n[g] += 1
        return n

    for text in ("Ab, ba! ab", "x", "é ñ--ß  q", "日本 a"):
        codes, counts = langid.grams(text)
        assert sorted(counts.tolist()) == sorted(plain(text).values())
    assert len(langid.grams(None)[0]) == len(langid.grams("12 !")[0]) == 0


def test_grams_of_slices():
    rng = random.Random(12)
    for text in ("", "  ", "a", "Ab, ba! ab", "ΑΣ ΑΣ'Α", *("".join(rng.choice("abC é,1 日") for _ in range(rng.randrange(60))) for _ in range(60))):
        whole = langid.grams(text)
        for size in (1, 2, 3, 7):
            sliced = langid.grams(text, size)
            assert sliced[0].tolist() == whole[0].tolist() and sliced[1].tolist() == whole[1].tolist(), (text, size)


def test_toxicity_of_slices():
    rng = random.Random(13)
    texts = [None, "", "!!", *(" ".join("".join(rng.choice("abcdé1Σ'") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 80))) for _ in range(20))]
    model = toxicity.Model(np.random.default_rng(1).standard_normal(toxicity.BUCKETS), -0.2)
    whole, bags = model.scores(texts), toxicity.bags(texts)
    for size in (1, 5, 40):
        assert np.allclose(model.scores(texts, size), whole, atol=1e-12)
        for (b, w), (own, weight) in zip(bags, toxicity.bags(texts, size), strict=True):
            assert b.tolist() == own.tolist() and np.allclose(w, weight, atol=1e-6)


def test_long_texts_need_slices_only():
    import tracemalloc

    text = " ".join(f"word{k % 5000} andre{k % 77}" for k in range(400_000))
    model = toxicity.Model(np.zeros(toxicity.BUCKETS), 0.0)
    for read in (langid.grams, lambda t: model.scores([t]), lambda t: toxicity.bags([t])):
        tracemalloc.start()
        read(text)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 20 * len(text), peak  # some 6 MB of text; whole-text arrays took 75 to 120 bytes for each


def test_out_of_place_distance():
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcde ") for _ in range(80)) for _ in range(6)]
    size = 30
    lists = [langid.top(*langid.grams(t), size).tolist() for t in texts]
    profiles = langid.Profiles(dict(zip("vwxyz", lists[:5], strict=True)), size)
    for text, own in zip(texts, lists, strict=True):
        away = {}
        for lang, known in zip("vwxyz", lists[:5], strict=True):
            away[lang] = sum(min(abs(known.index(c) - k), size) if c in known else size for k, c in enumerate(own))
        best = min(away, key=lambda x: (away[x], x))
        assert profiles.predict(text) == (best, 1 - away[best] / (size * len(own)))
    counts = langid.grams(texts[0])
    order = sorted(zip(*(x.tolist() for x in counts), strict=True), key=lambda x: (-x[1], x[0]))
    assert lists[0] == [c for c, _ in order[:size]]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.op10_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_language_of_odd_docs(odd_docs, no_docs):
    found = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.identify(odd_docs, langid.learn(odd_docs)).collect()}
    assert found[4, None] == found[5, ""] == found[13, "1234 5678 !!"] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in found.values())
    out = langid.stage(odd_docs.sparkSession, odd_docs, "")
    assert out.columns == odd_docs.columns and out.filter("text IS NULL OR text = ''").count() == 0
    assert langid.identify(no_docs, langid.learn(no_docs)).count() == 0
    blank = langid.identify(odd_docs, langid.learn(no_docs))
    assert {r.lang_pred for r in blank.collect()} == {"und"}


# op8


def test_scores_are_the_average_of_bags():
    rng = np.random.default_rng(9)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), 0.3)
    texts = ["Hello wörld again", None, "", "a", "the the cat 42", "--"]
    for text, score, (bucket, weight) in zip(texts, model.scores(texts), toxicity.bags(texts), strict=True):
        assert weight.sum() == pytest.approx(1 if len(bucket) else 0, abs=1e-5)
        assert score == pytest.approx(1 / (1 + np.exp(-(toxicity.GAIN * (weight @ model.buckets[bucket]) + 0.3))), abs=1e-4)


def test_misspelling_shares_its_score(spark):
    rng = random.Random(10)
    neutral = ["table", "river", "walks", "green", "stone", "paper", "under", "light"]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(neutral) + rng.choice(["", "s", "ed"]) for _ in range(25)]
        if i % 2:
            w[rng.randrange(25)] = rng.choice(["blasted", "blasting", "blaster"])
        rows.append((i, " ".join(w)))
        labels.append((i, i % 2))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    clean, toxic, misspelt = model.scores([" ".join(neutral * 3), " ".join([*neutral * 3, "blaster"]), " ".join([*neutral * 3, "blastter"])])
    assert toxic > 0.5 > clean and misspelt > clean
    assert (model.scores([rows[1][1]]) == toxicity.learn(docs.repartition(7), marks).scores([rows[1][1]])).all()


def test_toxicity_gradients():
    rng = np.random.default_rng(9)
    bag, e, w, b = rng.random((6, 5)) / 40, rng.standard_normal((5, 3)), rng.standard_normal((3, 2)), rng.standard_normal(2)
    toxic, weight = np.array([0, 1, 1, 0, 1, 0]), rng.random(6)
    _, *grads = toxicity.gradients(bag, e, w, b, toxic, weight)
    for value, grad in zip((e, w, b), grads, strict=True):
        for at in np.ndindex(value.shape):
            old, d = value[at], 1e-6
            value[at] = old + d
            up = toxicity.gradients(bag, e, w, b, toxic, weight)[0]
            value[at] = old - d
            down = toxicity.gradients(bag, e, w, b, toxic, weight)[0]
            value[at] = old
            assert grad[at] == pytest.approx((up - down) / (2 * d), abs=1e-5)


def test_repeated_documents_teach_once(spark):
    rows = [(k, f"plain text number{k} " * 5) for k in range(60)] + [(100 + k, f"awful words {k}") for k in range(60)]
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows], "doc_id long, toxic int")
    once, often = (spark.createDataFrame(r, "doc_id long, text string") for r in (rows, rows + [rows[70]] * 300 + [rows[3]] * 50))
    assert (toxicity.learn(once, labels).buckets == toxicity.learn(often, labels).buckets).all()
    few = toxicity.learn(once, labels, learn_bytes=3_000)
    assert not np.array_equal(few.buckets, toxicity.learn(once, labels).buckets)


def test_toxicity_of_odd_docs(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (None, 1), (3, None), (9, 0), (12, 0), (12, 0)], "doc_id long, toxic int")
    none = labels.filter("false")
    for model in (toxicity.learn(odd_docs, labels), toxicity.learn(odd_docs, none), toxicity.learn(no_docs, labels)):
        out = toxicity.score(odd_docs, model)
        assert out.filter("score IS NULL OR score < 0 OR score > 1 OR predicted <> CAST(score >= 0.5 AS INT)").count() == 0
        assert out.count() == odd_docs.count() and "a.b" in out.columns
    assert toxicity.score(no_docs, toxicity.learn(no_docs, none)).count() == 0


def test_held_out_rule(spark):
    ids = [0, 1, 5, 77, -3, None]
    got = [r.h for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(common.held_out(F.col("doc_id")).alias("h")).collect()]
    assert got == [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]


# op6: what is compared


def test_texts_that_share_half_are_not_compared(spark):
    """Texts that share 60 of 100 words meet in bands, but hardly any pair is plausible, so few are shipped."""
    rng = random.Random(11)
    shared = [f"s{k}" for k in range(60)]
    rows = [(k, " ".join(shared + [f"u{k}x{j}" for j in range(40)])) for k in range(1500)]
    rows += [(5000, " ".join(f"v{j}" for j in range(100))), (5001, " ".join(f"v{j}" for j in range(101)))]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    bands, per = ngram_join.banding()
    ties = ngram_join.plausible(ngram_join.signed(docs, bands, per), ngram_join.least_agreement(bands * per, 0.8)).distinct().count()
    assert 1 <= ties < 150
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in joined(docs)}
    assert got[5000] == got[5001] == (5000, 1)
    assert all(got[k] == (k, 0) for k in range(1500))


def joined(docs):
    rows, nodes, _ = ngram_join.near_duplicates(docs)
    return rows.join(nodes, "set_key").select("doc_id", "class_id", "n_links").collect()


def test_many_equal_rows_are_one_text(spark):
    text = " ".join(f"w{k}" for k in range(80))
    docs = spark.createDataFrame([(1, text)] * 6000 + [(2, text + " more")], "doc_id long, text string").repartition(6)
    got = joined(docs)
    assert len(got) == 6001
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in got} == {(1, 1, 6000), (2, 1, 6000)}


def test_large_buckets_are_tiled(spark):
    """More near copies than a tile of signatures or texts holds: all are linked with all."""
    base = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join([*base[: k % 380], f"x{k}", *base[k % 380 :]])) for k in range(700)]
    got = joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 699)}


def test_runs_are_whole(spark):
    """map_runs hands over whole groups, wherever batches end."""

    def sizes(table):
        keys = table.column("k").to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return pa.table({"k": pa.array(keys[begin]), "n": pa.array(np.diff(np.append(begin, len(keys))))})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k,) for k in range(40) for _ in range(1 + k * 3 % 23)]
        got = common.map_runs(spark.createDataFrame(rows, "k long"), "k", sizes, "k long, n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["k"], r["n"]) for r in got) == [(k, 1 + k * 3 % 23) for k in range(40)]
