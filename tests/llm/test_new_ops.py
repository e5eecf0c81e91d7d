"""Suffix dedup, fill-in-the-middle and spelling variants against brute force, with odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from treeline.llm import fim, spelling, suffix_dedup

LAST = (1 << 63) - 1


def sha(data):
    return hashlib.sha256(data).hexdigest()


def plain(df):
    return [r.asDict() for r in df.collect()]


# op11


def removed_by_force(docs, width):
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each (doc_id, text)."""
    least, out = {}, []
    texts = [(LAST if i is None else i, i, (t or "").encode()) for i, t in docs]
    for order, _, b in texts:
        for k in range(len(b) - width + 1):
            s = b[k : k + width]
            least[s] = min(least.get(s, LAST), order)
    for order, i, b in texts:
        gone = [False] * len(b)
        for k in range(len(b) - width + 1):
            if least[b[k : k + width]] < order:
                gone[k : k + width] = [True] * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((-1 if i is None else i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def removed(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect())


def test_suffixes_of_odd_rows(odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    want = removed_by_force(docs, 50)
    assert removed(suffix_dedup.dedup(odd_docs)) == want
    assert removed(suffix_dedup.dedup(odd_docs.repartition(5), chunk_bytes=300)) == want
    assert suffix_dedup.dedup(no_docs).count() == 0
    digests = {r["kept"] for r in suffix_dedup.dedup(odd_docs, digest=True).collect()}
    assert digests == {sha(x[-1]) for x in want}


def test_suffixes_in_small_chunks(spark):
    """Few letters, periods, passages at all offsets, equal doc_ids with other texts, and characters cut in half."""
    rng = random.Random(8)
    base = ["".join(rng.choice("ab") for _ in range(90)), "".join(rng.choice("xyzé日") for _ in range(120)), "q" * 200, "ab" * 80, "abcab" * 40]
    docs = []
    for _ in range(150):
        text = ""
        for _ in range(rng.randint(0, 5)):
            part = rng.choice(base)
            a, b = sorted(rng.randrange(len(part) + 1) for _ in range(2))
            text += part[a:b] + rng.choice(["", "-", "".join(rng.choice("mnop") for _ in range(9))])
        docs.append((rng.choice([None, *range(60)]), text or None))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    for width in (16, 23, 50):
        want = removed_by_force(docs, width)
        assert sum(x[2] for x in want) > 1000
        assert removed(suffix_dedup.dedup(table, width, chunk_bytes=400)) == want
    with pytest.raises(ValueError):
        suffix_dedup.dedup(table, 15)


def test_stretches_hold_each_window_once():
    """All slices give the same windows, each under one stretch; equal windows have equal anchors at equal offsets."""
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdef ") for _ in range(400))
    texts = [passage, "zz" + passage[5:] + "end", "short", "", "k" * 300, passage[:60]]
    data = b"".join(t.encode() + b"\xff" for t in texts)
    seen = []
    for most in (1 << 17, 128, 77):
        chunk = suffix_dedup.Chunk(0, list(range(6)), [len(t) for t in texts], data, 50, 8, {})
        chunk.scan(most)
        starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(chunk.first, chunk.last, strict=True)])
        assert len(set(starts)) == len(starts) == sum(max(len(t) - 49, 0) for t in texts)
        ranks = np.repeat(chunk.rank, chunk.last - chunk.first + 1)
        seen.append(dict(zip(starts.tolist(), ranks.tolist(), strict=True)))
        windows = {}
        for s, r in seen[-1].items():
            assert windows.setdefault(data[s : s + 50], r) == r
    assert seen[0] == seen[1] == seen[2]


def test_a_string_in_many_documents_is_one_name_a_chunk():
    text = "the same line of words in every document, again and again and again"
    chunk = suffix_dedup.Chunk(0, list(range(1000)), [len(text)] * 1000, (text.encode() + b"\xff") * 1000, 50, 4, {})
    chunk.scan()
    assert sum(len(r[2]) // 4 for r in chunk.rank_rows()) <= len(text) - 49


def test_suffixes_of_one_long_text(spark):
    """A text of many slices, and its copy with a changed byte in each hundred thousand."""
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghij ") for _ in range(700_000))
    other = list(text)
    for k in range(50_000, len(other), 100_000):
        other[k] = "Z"
    docs = [(1, text), (2, "".join(other)), (3, text[123_456:123_506] + "!")]
    got = removed(suffix_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")))
    assert [x[:4] for x in got] == [(1, 700_000, 0, 0), (2, 700_000, 700_000 - 7, 8), (3, 51, 50, 1)]
    assert got[1][4] == b"Z" * 7


# op12

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def filled_by_force(doc_id, text, fim_rate=100, spm_rate=50, seed=7):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= fim_rate:
        return len(units), "plain", None, None, text, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < spm_rate
    return len(units), "spm" if spm else "psm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}", text


def fim_rows():
    rng = random.Random(2)
    texts = [None, "", "\n", "\n\n\n", "no feed", "one\n", "a <P> b\nc", "<P", "<<S>x\n", "< P>\n<P\n>\n", "x<M>", "<" * 300, "日本\n語é\n<\r\n😀", "P>\nS>\n<M", ("é" * 127 + "\n") * 5, "<P" * 64 + ">"]
    texts += ["".join(rng.choice("ab<PSM>\né日😀 ") for _ in range(rng.randint(0, 400))) for _ in range(150)]
    texts += ["\n".join("ab< é日😀"[rng.randrange(8) :] for _ in range(rng.randint(0, 60))) for _ in range(150)]
    return [(None if k % 17 == 0 else k % 200, t, "en", 5) for k, t in enumerate(texts)]


def test_fill_in_the_middle_by_force(spark, no_docs):
    rows = fim_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string, _form string, n int").repartition(4)
    own = ["_n", "_form", "_prefix_chars", "_middle_chars", "_output", "_restored"]
    key = lambda x: str(x)
    for rates in ((100, 50), (60, 0), (0, 100), (100, 100)):
        got = fim.transform(table, *rates)
        assert got.columns == ["doc_id", "text", "n", *own]
        want = [(i, t, n, *filled_by_force(i, t, *rates)) for i, t, _, n in rows]
        assert sorted(((r["doc_id"], r["text"], r["n"], *[r[c] for c in own]) for r in got.collect()), key=key) == sorted(want, key=key)
    assert fim.transform(no_docs).count() == 0
    digest = fim.transform(table, digest=True)
    assert "text" not in digest.columns
    want = sorted((sha(filled_by_force(i, t)[4].encode()), sha((t or "").encode())) for i, t, _, _ in rows)
    assert sorted((r["_output"], r["_restored"]) for r in digest.collect()) == want


def test_lanes_of_one_long_text():
    """Cuts of a text of more lanes than step together."""
    rng = random.Random(6)
    text = "".join(rng.choice("aé<P\n") for _ in range(fim.LANE * fim.LANES)).encode()
    offsets = np.array([0, len(text)])
    data = np.frombuffer(text, np.uint8)
    lanes = fim.scan(data, offsets)
    units = UNIT.findall(text.decode())
    assert lanes.sum(0).tolist() == [len(text.decode()), len(units), 0]
    wanted = np.array([0, 1, len(units) // 2, len(units) - 1, len(units)])
    at, points = fim.locate(data, offsets, lanes, np.zeros(5, np.int64), wanted)
    assert [text[:x].decode() for x in at] == ["".join(units[:u]) for u in wanted]
    assert points.tolist() == [len("".join(units[:u])) for u in wanted]


# op13


def counted_by_force(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped_by_force(counts, ratio=10):
    forms, out = {}, []
    nears = {w: [v for v in counts if near(w, v)] for w in counts}
    for w, vs in nears.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w] or "", root, n, len(nears[w]), counts.get(forms[w], -1)))
    return sorted(out)


def grouped(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


def spelling_docs():
    rng = random.Random(12)
    letters = "abcdeéÿÀ×"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 10))) for _ in range(60)]
    docs = []
    for k in range(400):
        text = []
        for _ in range(rng.randint(0, 60)):
            w = words[min(int(rng.expovariate(0.15)), 59)]
            if rng.random() < 0.1:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]])
            text.append(rng.choice([w, w.upper(), w.capitalize()]) if w.isascii() else w)
        docs.append((None if k % 50 == 0 else k % 300, rng.choice([" ", "-", "9", "\n", "日"]).join(text) or None))
    chain = [("accommodation", 2000), ("acommodation", 100), ("acomodation", 8)]
    docs += [(1000 + k, " ".join([w] * min(n, 100))) for w, n in chain for k in range(max(n // 100, 1))]
    return docs


def test_variants_by_force(spark, odd_docs, no_docs):
    docs = spelling_docs()
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, word string").repartition(5)
    want = grouped_by_force(counted_by_force(docs))
    assert any(r[1] and r[1] != r[2] for r in want)
    assert any(r[4] > 10 for r in want)
    assert grouped(spelling.variants(table)) == want
    assert spelling.variants(no_docs).count() == 0
    odd = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    assert grouped(spelling.variants(odd_docs)) == grouped_by_force(counted_by_force(odd))


def test_each_near_pair_once(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abéÿ") for _ in range(rng.randint(7, 9))) for _ in range(900)})
    got = [(r["a"], r["b"]) for r in spelling.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()]
    want = {tuple(sorted((a, b), key=lambda w: (len(w), w))) for k, a in enumerate(words) for b in words[:k] if near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_pieces_cut_no_run():
    text = "abc déf " * 50 + "x" * 500 + " ünd " * 20
    for size in (1, 7, 100, 10_000):
        parts = list(spelling.pieces(text, size))
        assert "".join(parts) == text
        assert [w for p in parts for w in re.findall("[A-Za-zÀ-ÿ]+", p)] == re.findall("[A-Za-zÀ-ÿ]+", text)
