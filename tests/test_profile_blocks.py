"""Local alignments by blocks of a chain's letters against rows of the whole matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.kernels import align
from treeline.operators import analyses


@pytest.mark.parametrize("gaps", [(-10, -0.5), (-3, -0.5), (-2, -1)])
def test_ends_and_ways_back_are_those_of_rows(gaps):
    rng = np.random.default_rng(2)
    prices = [int(840 * g) for g in gaps]
    for t in range(150):
        n, m = (int(x) for x in rng.integers(1, 80, 2))
        scores = rng.integers(-9, 10, (n, 7)) * [1, 0.5][t % 2] - 2 * (t % 7 == 0)
        scores = np.abs(scores) if t % 5 == 0 else scores
        letters, cut = rng.integers(0, 7, m), int(rng.integers(0, m + 1))
        parts = np.rint(scores * 840).T.astype([np.int32, np.int64][t % 3 % 2])
        best, i, j, state = align.local_end(parts, letters, *prices)
        score, extent = align.local_extent(n, lambda k: scores[k, letters], m, *gaps)  # noqa: B023
        assert best / 840 == score and extent == (align.way_back(parts, letters, i, j, 840, *gaps, reach=[2, 5, 128][t % 3]) if best else 0)
        # a chain that is cut goes on from its state
        one = align.local_end(parts, letters[:cut], *prices)
        two = align.local_end(parts, letters[cut:], *prices, one[3])
        assert all((x == y).all() for x, y in zip(two[3], state, strict=True)) and best == max(one[0], two[0])


def test_scores_beyond_small_numbers_are_counted_in_long_ones():
    scores = np.full((2, 30), 1 << 28, np.int32)
    with pytest.raises(OverflowError):
        align.local_end(scores, np.zeros(30, int), -8400, -420)
    assert align.local_end(scores.astype(np.int64), np.zeros(30, int), -8400, -420)[0] == 30 << 28


def rows_of(found):
    return {(r["profile"], r["chain"]): (round(r["score"], 9), r["pairs"]) for r in found.collect()}


def test_blocks_are_done_again_until_they_meet(spark, monkeypatch):
    """Chains that resemble the profile all along, whose ways are far longer than a block begins early."""
    rng = np.random.default_rng(5)
    letters = np.array(list("ARNDCQEGHILKMFPSTWYVX"))
    cells, chains = [], []
    for p in range(2):
        text = rng.integers(0, 20, 300)
        cells += [(f"p{p}", 3 * k, str(letters[x]), 0.5) for k, x in enumerate(text)] + [(f"p{p}", 3 * k, str(letters[(x + 1 + k % 3) % 20]), 0.5) for k, x in enumerate(text)]
        keep = rng.random(300)
        chains.append((f"near{p}", "".join(letters[x] for x, u in zip(text, keep, strict=True) if u > 0.05)))
        chains.append((f"part{p}", "".join(letters[rng.integers(0, 21, 100)]) + "".join(letters[text[80:140]]) + "".join(letters[rng.integers(0, 21, 90)])))
    chains += [("empty", ""), ("other", "XéXB")]
    profiles = spark.createDataFrame(cells, "profile string, codon_site int, aa string, frequency double")
    texts = spark.createDataFrame(chains, "chain string, residues string")
    rounds = []
    call = analyses._profile_blocks
    monkeypatch.setattr(analyses, "_profile_blocks", lambda *x: rounds.append(x[-1]) or call(*x))
    got = rows_of(analyses.align_profiles(profiles, texts, block=40, lead=4))
    assert got == rows_of(analyses._align_whole(profiles, texts)) and len(got) == 12
    assert got["p0", "empty"] == got["p1", "other"] == (0.0, 0) and max(x for _, x in got.values()) > 200
    assert rounds[:3] == [4, 16, 64]
    # frequencies that aren't whole parts take the other way
    odd = profiles.withColumn("frequency", F.lit(0.3137))
    assert rows_of(analyses.align_profiles(odd, texts)) == rows_of(analyses._align_whole(odd, texts))
