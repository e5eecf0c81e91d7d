"""The pipeline against a brute-force version in plain Python, on a table of the driver and on odd and empty ones."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

from treeline.llm import bpe, langid, mixing

corpus_pipeline = pytest.importorskip("corpus_pipeline")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ["language_id", "ngram_jaccard_join", "substring_dedup", "mixing", "bpe"]


def grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    text, n = f" {' '.join(words)} ", Counter()
    if words:
        for k in range(1, 4):
            for i in range(len(text) - k + 1):
                g = text[i : i + k]
                if g.strip() and not (k == 3 and g[1] == " "):
                    n[g] += 1
    return n


def code(gram):
    return sum((1 if c == " " else ord(c)) << 21 * k for k, c in enumerate(gram))


def ranked(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[: langid.PROFILE]]


def by_language(rows):
    profiles = {}
    for r in rows:
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        if r["lang"] is not None and r["text"] is not None and not held:
            profiles.setdefault(r["lang"], Counter()).update(grams(r["text"]))
    profiles = {k: {g: i for i, g in enumerate(ranked(v))} for k, v in profiles.items() if v}
    kept = []
    for r in rows:
        own = ranked(grams(r["text"] or ""))
        if own and profiles:
            away = min(sum(min(abs(p[g] - i), langid.PROFILE) if g in p else langid.PROFILE for i, g in enumerate(own)) for p in profiles.values())
            if 1.0 - away / (langid.PROFILE * len(own)) >= langid.LEAST_SCORE:
                kept.append(r)
    return kept


def one_of_each_class(rows):
    words = [WORD.findall(r["text"] or "") for r in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = {}
    for i, s in enumerate(sets):
        for g in s:
            at.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in at[g] if j < i)
        for j, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i) if sets[i] else -1 - i, []).append(r)
    named = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    return [min(g, key=named) for g in groups.values()]


def without_passages(rows):
    words = [WORD.findall(r["text"] or "") for r in rows]
    seen = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        text = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append(r | {"text": text, "n_chars": len(text)})
    return out


def mixed(rows):
    size = [len(WORD.findall(r["text"] or "")) for r in rows]
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    total, of = sum(size), Counter()
    for r, n in zip(rows, size, strict=True):
        of[r["source"]] += n
    target, open_ = {}, set(names)
    while open_:
        left, share = total - sum(target.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] > 3 * of[s] * share}
        if not over:
            target |= {s: left * weight[s] / share for s in open_}
            break
        target |= {s: 3 * of[s] for s in over}
        open_ -= over
    key = [int(hashlib.md5(":".join(str(x) for x in ("17", r["doc_id"], r["text"]) if x is not None).encode()).hexdigest()[:15], 16) for r in rows]
    order = sorted(range(len(rows)), key=lambda k: (key[k], rows[k]["doc_id"] is not None, rows[k]["doc_id"] or 0))
    sent, copies = Counter(), []
    for k in order:
        s = rows[k]["source"]
        sent[s] += size[k]
        for epoch in range(3):
            finish = (sent[s] + epoch * of[s]) / target[s] if target[s] > 0 else 0.0
            copies.append((finish, names.index(s), key[k], epoch, k))
    out, spent = [], 0
    for *_, k in sorted(copies):
        spent += size[k]
        if spent > total:
            break
        out.append(rows[k])
    return out


def encoded(rows):
    library = Tokenizer.from_file(bpe.default_path())
    out = []
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        out.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return sorted(out, key=str)


def test_pipeline_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = mixed(without_passages(one_of_each_class(by_language(rows))))
    assert len(rows) > 100
    got = corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=str) == encoded(rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES


def test_pipeline_of_odd_tables(spark, odd_docs, no_docs, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns; then a table without rows."""
    rng = random.Random(3)
    more = [(100 + k, " ".join(f"w{rng.randrange(400)}" for _ in range(80)), "en", f"s{k % 4}", 9, k, 0.5, None, None, "z") for k in range(30)]
    docs = odd_docs.unionByName(spark.createDataFrame(more, odd_docs.schema))
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    want = encoded(mixed(without_passages(one_of_each_class(by_language(rows)))))
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(want) > 20 and sorted(map(tuple, got), key=str) == want
    no_docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    staged = mixing.stage(spark, docs, "")
    assert staged.columns == docs.columns and mixing.stage(spark, no_docs, "").count() == 0
