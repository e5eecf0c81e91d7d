"""Seeded alignment row by row: bands against the whole matrix, seeds against sets, rows of one pair or of none."""

import random

import duckdb
import numpy as np

from treeline.kernels.align import align_text, near_text
from treeline.operators import text_alignment as X
from treeline.plans import registry


def changed(rng, text, letters, rate):
    return "".join(c if rng.random() > rate else rng.choice(["", rng.choice(letters), c + rng.choice(letters) * rng.randint(1, 9)]) for c in text)


def test_alignment_in_a_band_is_that_of_the_matrix():
    rng = random.Random(5)
    for t in range(400):
        letters = ["ab", "acgt", "é\U0001f600xyz"][t % 3]
        a = "".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 9, 40, 120])))
        b = changed(rng, a, letters, [0.02, 0.1, 0.4][t % 7 % 3]) if t % 4 else "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        cut = rng.randrange(len(a))
        b = b[:cut] + b[cut + rng.randint(0, 30) * (t % 2) :] or "b"
        assert near_text(a, b) == align_text(a, b)[:2]


def test_seeds_are_those_of_sets():
    rng = random.Random(6)
    for t in range(60):
        k = [1, 5, 12, 25][t % 4]
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 300)))
        b = changed(rng, a, "abé", 0.05)
        at = [{w: s.find(w) for w in (s[i : i + k] for i in range(len(s) - k + 1)) if s.find(w, s.find(w) + 1) < 0} for s in (a, b)]
        want = X.rising([(at[0][w], at[1][w]) for w in at[0].keys() & at[1].keys()])
        assert X.seed_chain(a, b, k).tolist() == [list(x) for x in want]


def test_runs_are_stitched_as_their_anchors():
    rng = random.Random(7)
    for _ in range(40):
        a = "".join(rng.choice("abcd") for _ in range(200))
        b = changed(rng, a, "abcd", 0.03)
        chain = X.seed_chain(a, b, 8)
        covered = np.zeros((len(a) + 1, 2), int)
        for p, q, n in X.runs(chain, 8):
            assert a[p : p + n] == b[q : q + n]
            covered[p : p + n, 0] = 1
        for p in chain[:, 0]:
            covered[p : p + 8, 1] = 1
        assert (covered[:, 0] == covered[:, 1]).all()
        left, right = X.stitched(a, b, chain, 8)
        assert [left.replace("-", ""), right.replace("-", ""), len(left)] == [a, b, len(right)]


def test_rows_of_one_document_and_of_none_all_stay(spark, tmp_path):
    long = "one line of words with 12 numbers, a zebra and more " * 8
    rows = [("a", long), ("a", long[:200]), ("a", long), (None, "pizza 1"), (None, None), ("b", ""), ("c", "zz9")]
    spark.createDataFrame(rows, "doc_id string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["text_seeded_alignment"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.sql(registry.oracle_sql()["text_seeded_alignment"]).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) == 6
