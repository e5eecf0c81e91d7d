"""Scans by blocks of sites against scans of whole triplets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.operators import signals as Z
from treeline.operators import triplet_scan as T
from treeline.operators.alignment import triplet_events
from treeline.operators.windows import rolling_scan


@pytest.fixture(scope="module")
def aln(spark):
    """Five taxa, one of few sites, gaps, and a stretch that is all gaps."""
    rng = np.random.default_rng(3)
    rows = [(t, s, None if rng.random() < 0.1 else int(rng.integers(0, 2 + t % 3))) for t in range(5) for s in range(1, 700) if rng.random() < (0.1 if t == 4 else 0.95) and not 200 <= s < 260]
    return spark.createDataFrame(rows, "taxon int, site int, base int").repartition(3).cache()


@pytest.mark.parametrize(("block", "width"), [(1, 5), (16, 5), (37, 10), (8192, 10)])
def test_scan_by_blocks_is_that_of_whole_triplets(aln, block, width):
    whole = rolling_scan(triplet_events(aln), width).toPandas().sort_values(["a", "b", "c", "event"], ignore_index=True)
    blocks = T.event_blocks(aln, block).cache()
    names = ["a", "b", "c", "site", "event", "g"]
    got = T.peaks(blocks, width).toPandas().sort_values(["a", "b", "c", "event"], ignore_index=True)
    want = whole[whole["peak"]][names].reset_index(drop=True)
    assert len(want) and got[names].equals(want)
    order = (F.desc("g"), "a", "b", "c", "site")
    top = [tuple(r) for r in T.strongest(blocks, width, 7).orderBy(*order).limit(7).collect()]
    best = whole.dropna(subset="g").sort_values(["g", "a", "b", "c", "site"], ascending=[False, True, True, True, True]).head(7)
    assert top == [tuple(r) for r in best[["a", "b", "c", "site", "g"]].itertuples(index=False)]
    # no row holds more than a block's sites, so a task's memory does not grow with the alignment
    assert blocks.agg(F.max(F.size("site"))).first()[0] <= block


def test_refined_signals_by_blocks_of_sites(aln):
    order = ["a", "b", "c", "event"]
    want, got = (x.toPandas().sort_values(order, ignore_index=True) for x in (Z.refine(rolling_scan(triplet_events(aln), 10), 699, 10, 2.0), Z.refine_alignment(aln, 699, 10, 2.0, block=64)))
    assert len(want) and want.columns.tolist() == got.columns.tolist() and np.allclose(want.to_numpy(float), got.to_numpy(float))


def test_blocks_are_dealt_to_tasks(spark, aln):
    """Rows that hold blocks of events are few and small to Spark, but not to a task."""
    from treeline.operators.chains import spread

    rows = spark.range(2000).coalesce(1)
    assert spread(rows, 2000, 50).rdd.getNumPartitions() == 40 and spread(rows, 3).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert T.scanned(T.event_blocks(aln, 64), 5, lambda row, base, g, peak: None, "a int").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
