"""Seeded alignment against alignment of the whole texts."""

import random

from treeline.kernels.align import align_text
from treeline.operators import text_alignment as X


def score(left, right, match=2.0, mismatch=-1.0, opening=-4.0, extension=-1.0):
    total, gap = 0.0, None
    for a, b in zip(left, right, strict=True):
        side = "a" if a == "-" else "b" if b == "-" else None
        total += (opening if side != gap else extension) if side else match if a == b else mismatch
        gap = side
    return total


def edited(rng, text, rate):
    out = []
    for c in text:
        r = rng.random()
        out.append(c if r > rate else "" if r < rate / 3 else rng.choice("acgté") + ("" if r < 2 * rate / 3 else c))
    return "".join(out)


def test_scores_are_those_of_whole_alignments(spark):
    """Texts with few edits: seeds bind and the score is the plain one; without gaps both texts come back."""
    rng = random.Random(7)
    rows = []
    for k in range(12):
        text = "".join(rng.choice("acgtéß") for _ in range(rng.choice([10, 70, 300, 600])))
        rows.append((k, text, edited(rng, text, 0.02)))
    rows += [(20, "", "acg"), (21, None, "acg"), (22, "acg", ""), (23, "x" * 200, "x" * 180), (24, "same text " * 30, "same text " * 30)]
    got = {r["pair"]: (r["left"], r["right"]) for r in X.seeded_alignments(spark.createDataFrame(rows, "pair int, one string, two string").repartition(3), 15).collect()}
    assert len(got) == len(rows)
    for k, one, two in rows:
        left, right = got[k]
        assert left.replace("-", "") == (one or "") and right.replace("-", "") == two
        if k < 12:
            assert score(left, right) == score(*align_text(one, two)[:2])


def test_chains_rise():
    rng = random.Random(2)
    for _ in range(50):
        anchors = [(rng.randrange(30), rng.randrange(30)) for _ in range(rng.randrange(12))]
        anchors = list({i: (i, j) for i, j in anchors}.values())
        chain = X.rising(anchors)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(chain, chain[1:], strict=False))
        best = [1] * len(anchors)
        for n, (i, j) in enumerate(sorted(anchors)):
            for m, (p, q) in enumerate(sorted(anchors)[:n]):
                if p < i and q < j:
                    best[n] = max(best[n], best[m] + 1)
        assert len(chain) == max(best, default=0)


def test_stretches_without_unique_seeds_are_seeded_again(spark):
    """Repeated lines, long runs and unlike texts beyond the bound of cells: both texts come back, and equal parts meet."""
    rng = random.Random(4)
    line = "".join(rng.choice("acgt") for _ in range(40))
    other = "".join(rng.choice("acgt") for _ in range(2500))
    rows = [(1, line * 60, line * 30 + "X" + line * 30), (2, "q" * 3000, "q" * 2000), (3, other, "".join(rng.choice("wxyz") for _ in range(2200))), (4, line * 50 + other, other + line * 50)]
    got = {r["pair"]: (r["left"], r["right"]) for r in X.seeded_alignments(spark.createDataFrame(rows, "pair int, one string, two string")).collect()}
    for k, one, two in rows:
        assert [x.replace("-", "") for x in got[k]] == [one, two] and len(got[k][0]) == len(got[k][1])
    assert sum(a == b for a, b in zip(*got[1], strict=True)) == 2400
