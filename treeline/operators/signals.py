"""Recombination signals of triplets: refinement by a chain along the sites, consensus of many triplets, cuts and their costs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import hmm
from .chains import kept, spread
from .triplet_scan import event_blocks, signal_blocks

REFINED = "a int, b int, c int, event int, breakpoint int, g double, interval_low int, interval_high int, switch double, accuracy double"


def _event_blocks(scan: DataFrame, least: float, block: int) -> DataFrame:
    """a, b, c, blk, event, site, state, found (places of the peaks in the block), g (of those): the events of a triplet in blocks."""
    row = F.struct(F.col("event").cast("int").alias("event"), F.col("site").cast("int").alias("site"), F.col("state").cast("byte").alias("state"), F.when(F.col("peak") & (F.col("g") >= least), F.col("g")).alias("g"))
    packed = scan.groupBy("a", "b", "c", F.floor(F.col("event") / block).alias("blk")).agg(F.sort_array(F.collect_list(row)).alias("x"))
    at = F.filter(F.sequence(F.lit(0), F.size("x") - 1), lambda k: F.get("x", k)["g"].isNotNull())
    packed = packed.withColumn("found", at)
    return kept(packed.select("a", "b", "c", "blk", *[F.col(f"x.{c}").alias(c) for c in ("event", "site", "state")], "found", F.transform("found", lambda k: F.get("x", k)["g"]).alias("g")))


def _mapped(df: DataFrame, fn: Callable[[pd.Series], list[tuple]], schema: str) -> DataFrame:
    """``fn`` on each row, which holds a block."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                out = fn(row)
                if out:
                    yield pd.DataFrame(out, columns=names)

    return df.mapInPandas(run, schema)


def _switches(blocks: DataFrame, rows: int, sites: int, rates: int) -> DataFrame:
    """The blocks with ``switch``, the probability that the state changed before each event, and their triplet's accuracy; triplets without peaks are left out.

    Segments between peaks give the accuracy. Blocks are folded to one matrix for each rate; those of a triplet meet in one
    task, a row for each block; then all blocks are decoded at once.
    """
    triplet = ["a", "b", "c"]
    upto = Window.partitionBy(*triplet).orderBy("blk")
    past = upto.rowsBetween(Window.unboundedPreceding, -1)
    slim = blocks.select(*triplet, "blk", F.size("found").alias("k"), F.element_at("site", -1).alias("last"))
    slim = slim.select(*triplet, "blk", F.lag("last").over(upto).alias("prev"), F.coalesce(F.sum("k").over(past), F.lit(0)).alias("base"))
    blocks = blocks.join(slim, [*triplet, "blk"])

    def segments(row) -> list[tuple]:
        parts = np.split(np.asarray(row.state), np.asarray(row.found, int))
        return [(row.a, row.b, row.c, int(row.base) + k, *np.bincount(p, minlength=3).tolist()) for k, p in enumerate(parts) if len(p)]

    counts = _mapped(blocks.select(*triplet, "state", "found", "base"), segments, "a int, b int, c int, seg long, n0 long, n1 long, n2 long")
    whole = counts.groupBy(*triplet, "seg").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(3)])
    one = whole.groupBy(*triplet).agg(F.sum(F.greatest("n0", "n1", "n2")).alias("same"), F.sum(F.col("n0") + F.col("n1") + F.col("n2")).alias("n"))
    purity = F.greatest(F.lit(0.55), F.least(F.lit(0.995), (F.col("same") + 0.5) / (F.col("n") + 1.5)))
    peaks = blocks.groupBy(*triplet).agg(F.sum(F.size("found")).alias("peaks")).filter("peaks > 0")
    work = spread(blocks, rows).join(kept(one.join(peaks, triplet).select(*triplet, "peaks", purity.alias("accuracy"))), triplet)

    def prepared(row) -> tuple[np.ndarray, np.ndarray]:
        first = np.inf if pd.isna(row.prev) else row.prev
        at = np.asarray(row.site, float)
        gaps = np.concatenate([[np.inf if first == np.inf else at[0] - first], np.diff(at)])
        return hmm.switch_stays(gaps, row.peaks * 2.0 ** np.linspace(-3, 3, rates), sites), hmm.switch_emissions(np.asarray(row.state), row.accuracy)

    def fold(row) -> list[tuple]:
        m, log = hmm.switch_fold(*prepared(row))
        return [(row.a, row.b, row.c, row.blk, m.ravel(), log)]

    def enter(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("blk", ignore_index=True)
        m, n = np.stack(rows["m"].to_numpy()).reshape(-1, rates, 3, 3), len(rows)
        before, after = np.full((n, rates, 3), 1 / 3), np.full((n, rates, 3), 1 / 3)
        evidence = np.stack(rows["log"].to_numpy()).sum(0)
        at = before[0]
        for k in range(n):
            before[k] = at
            at = (at[:, None, :] @ m[k])[:, 0]
            evidence = evidence + np.log(at.sum(1))
            at = at / at.sum(1, keepdims=True)
        for k in range(n - 1, 0, -1):
            x = (m[k] @ after[k][:, :, None])[:, :, 0]
            after[k - 1] = x / x.sum(1, keepdims=True)
        share = np.exp(evidence - evidence.max())
        share = [share / share.sum()] * n
        return rows[[*triplet, "blk"]].assign(before=[v.ravel() for v in before], after=[v.ravel() for v in after], share=share)

    folded = _mapped(work.select(*triplet, "blk", "site", "state", "prev", "peaks", "accuracy"), fold, "a int, b int, c int, blk long, m array<double>, log array<double>")
    entered = folded.groupBy(*triplet).applyInPandas(enter, "a int, b int, c int, blk long, before array<double>, after array<double>, share array<double>")

    def decode(row) -> list[tuple]:
        switch = hmm.switch_block(*prepared(row), row.before.reshape(rates, 3), row.after.reshape(rates, 3)) @ row.share
        return [(row.a, row.b, row.c, row.blk, row.event, row.site, row.found, row.g, switch, row.accuracy)]

    return kept(_mapped(spread(work.join(entered, [*triplet, "blk"]), rows), decode, "a int, b int, c int, blk long, event array<int>, site array<int>, found array<int>, g array<double>, switch array<double>, accuracy double"))


def refine(scan: DataFrame, sites: int, width: int, least: float = 4.0, mass: float = 0.95, rates: int = 9, block: int = 4096) -> DataFrame:
    """Every peak of a rolling scan (g of at least ``least``), moved to the nearest mode of its triplet's switch probabilities.

    scan: a, b, c, event, site, state, g, peak of all events, as ``rolling_scan`` gives them. A triplet's chain is solved by
    blocks of events; each block sees some events of those beside it. Adds raw_p, adjusted_p (by all windows of all
    triplets) and evidence = -log10 raw_p. A null peak is none; triplets without peaks give no rows.
    """
    blocks = _event_blocks(scan.select("a", "b", "c", "event", "site", "state", "g", "peak"), least, block)
    return _refined(blocks, scan.agg(F.count("g").alias("_tests")), sites, width, mass, rates)


def refine_alignment(aln: DataFrame, sites: int, width: int, least: float = 4.0, mass: float = 0.95, rates: int = 9, block: int = 8192) -> DataFrame:
    """``refine`` of the scan of all triplets of an alignment (taxon, site, base), whose events stay in blocks of sites throughout."""
    blocks = kept(signal_blocks(event_blocks(aln, block), width, least))
    return _refined(blocks.drop("tests"), blocks.agg(F.coalesce(F.sum("tests"), F.lit(0)).alias("_tests")), sites, width, mass, rates)


def _refined(blocks: DataFrame, tests: DataFrame, sites: int, width: int, mass: float, rates: int) -> DataFrame:
    """``refine`` of blocks of events; tests: one row with the number of windows."""
    rows = blocks.count()
    chains = _switches(blocks, rows, sites, rates)
    halo = 2 * width + 2  # a peak reaches no further, nor does one that narrows its stretch
    order = Window.partitionBy("a", "b", "c").orderBy("blk")
    near = lambda at: F.array_contains("found", at)
    edge = lambda low, high: F.transform(F.sequence(low, high), lambda k: F.struct(F.get("site", k).alias("site"), F.get("switch", k).alias("switch"), near(k).alias("found")))
    last = F.size("site") - 1
    edges = chains.select("a", "b", "c", "blk", edge(F.lit(0), F.least(F.lit(halo - 1), last)).alias("head"), edge(F.greatest(F.lit(0), last - (halo - 1)), last).alias("tail"))
    left = F.flatten(F.collect_list("tail").over(order.rowsBetween(-halo, -1)))  # a block holds an event at least
    right = F.flatten(F.collect_list("head").over(order.rowsBetween(1, halo)))
    # heads and tails of short blocks follow one another, so those nearest are whole
    edges = edges.select("a", "b", "c", "blk", left.alias("left"), right.alias("right"))
    fields = ("site", "switch", "found")
    edges = edges.select("a", "b", "c", "blk", *[F.slice(f"left.{c}", F.greatest(F.lit(1), F.size("left") - halo + 1), F.lit(halo)).alias(f"left_{c}") for c in fields], *[F.slice(f"right.{c}", F.lit(1), F.lit(halo)).alias(f"right_{c}") for c in fields])

    def run(row) -> list[tuple]:
        if not len(row.found):
            return []
        n, m = len(row.left_site), len(row.site)
        positions = np.concatenate([row.left_site, row.site, row.right_site]).astype(int).tolist()
        switch = np.concatenate([row.left_switch, row.switch, row.right_switch])
        own = np.asarray(row.found, int) + n
        every = np.concatenate([np.flatnonzero(np.asarray(row.left_found, bool)), own, np.flatnonzero(np.asarray(row.right_found, bool)) + n + m])
        first = int(np.searchsorted(every, own[0]))
        # the gap before an event has the event's number; the first event of a chain has none
        before = np.concatenate([[np.iinfo(int).min // 2], every[:-1]])
        after = np.concatenate([every[1:], [np.iinfo(int).max // 2]])
        out = []
        for k, at in enumerate(own.tolist()):
            low, high = max(1, at - width + 1), min(len(switch) - 1, at + width - 1)
            if k + first:
                low = max(low, (int(before[k + first]) + at) // 2 + 1)
            if k + first + 1 < len(every):
                high = min(high, (at + int(after[k + first])) // 2)
            mode, l, r = hmm.climb_mode(switch[low : high + 1], at - low)  # noqa: E741
            basin = switch[low + l : low + r + 1]
            one, two = (low + l + hmm.mass_position(basin, q) for q in ((1 - mass) / 2, (1 + mass) / 2))
            top = low + mode
            ends = max(1, positions[one - 1]), min(sites - 1, positions[two] - 1)
            middle = min(max((positions[top - 1] + positions[top] - 2) // 2 + 1, 1), sites - 1)
            out.append((row.a, row.b, row.c, int(row.event[row.found[k]]), middle, float(row.g[k]), min(ends), max(ends), float(switch[top]), row.accuracy))
        return out

    refined = _mapped(spread(chains.join(edges, ["a", "b", "c", "blk"]), rows), run, REFINED)
    log_p = -F.col("g") / 2
    adjusted = F.exp(F.least(F.lit(0.0), log_p + F.ln(F.greatest(F.lit(1), F.col("_tests")))))
    return refined.crossJoin(F.broadcast(tests)).select("*", F.exp(log_p).alias("raw_p"), adjusted.alias("adjusted_p"), (-log_p / math.log(10)).alias("evidence")).drop("_tests")


def strength(evidence: Column, switch: Column) -> Column:
    """What one signal counts for: evidence above a floor, compressed, less where the chain doubts a switch."""
    # fixed values: 0.4, 0.6, 12 and 0.75, as in the score of a centre 1.5
    doubt = 0.4 + 0.6 * F.sqrt(F.least(F.greatest(switch, F.lit(0.0)), F.lit(1.0)))
    return F.log1p(F.greatest(F.lit(0.0), F.least(evidence, F.lit(12.0)) - 0.75)) * doubt


def centres(signals: DataFrame, bandwidth: int = 12) -> DataFrame:
    """breakpoint, triplets, score, low, high: kernel votes around each signal's site, placed at the median of the votes.

    A triplet votes once for a centre, by its heaviest signal within ``bandwidth`` sites. Centres with one median are one,
    the best of them. Sites meet in bins, so each signal is compared with those of three bins.
    """
    s = signals.withColumn("_w", strength(F.col("evidence"), F.col("switch"))).withColumn("_bin", F.floor(F.col("breakpoint") / (bandwidth + 1)))
    votes = s.withColumn("_bin", F.explode(F.array(F.col("_bin") - 1, F.col("_bin"), F.col("_bin") + 1)))
    at = s.select(F.col("breakpoint").alias("centre"), "_bin").distinct()
    u = F.abs(F.col("breakpoint") - F.col("centre")) / F.lit(float(bandwidth + 1))
    near = at.join(votes, "_bin").filter(F.abs(F.col("breakpoint") - F.col("centre")) <= bandwidth).withColumn("_v", F.col("_w") * (1 - u * u))
    first = F.row_number().over(Window.partitionBy("centre", "a", "b", "c").orderBy(F.desc("_v"), "breakpoint", "event"))
    one = near.withColumn("_r", first).filter("_r = 1").withColumn("_m", F.greatest("_v", F.lit(1e-9)))
    whole, upto = Window.partitionBy("centre"), Window.partitionBy("centre").orderBy("breakpoint", "a", "b", "c").rowsBetween(Window.unboundedPreceding, 0)
    half = one.withColumn("_half", F.sum("_m").over(upto) >= F.sum("_m").over(whole) / 2)
    made = half.groupBy("centre").agg(
        F.min(F.when(F.col("_half"), F.col("breakpoint"))).alias("breakpoint"), F.count(F.lit(1)).alias("triplets"),
        (F.sum("_v") + 1.5 * F.log1p(F.count(F.lit(1)))).alias("score"), F.min("interval_low").alias("low"), F.max("interval_high").alias("high"),
    )
    best = made.groupBy("breakpoint").agg(F.max_by(F.struct("triplets", "score", "low", "high"), F.struct(F.round("score", 9), -F.col("centre"))).alias("m"))
    return best.select("breakpoint", "m.*")


def spaced(points: DataFrame, apart: int, block: int = 4096) -> DataFrame:
    """breakpoint of the set with the largest sum of ``weight`` (a whole number) whose members are ``apart`` from each other.

    points: breakpoint, weight, one row for each place. Blocks of places are folded to max-plus matrices; a row for each block
    meets the others in one task; then all blocks choose at once, from the right, as ``hmm.weighted_intervals`` does.
    """
    block = max(block, apart)
    rows = points.filter("weight > 0").select(F.floor(F.col("breakpoint") / block).alias("blk"), F.struct(F.col("breakpoint").cast("long").alias("at"), "weight").alias("x"))
    blocks = rows.groupBy("blk").agg(F.sort_array(F.collect_list("x")).alias("x"))
    blocks = kept(blocks.select("blk", F.col("x.at").alias("at"), F.col("x.weight").alias("weight")))

    def fold(row) -> list[tuple]:
        return [(row.blk, hmm.spaced_fold(np.asarray(row.at), np.asarray(row.weight), row.blk * block, block, apart).ravel())]

    def enter(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("blk", ignore_index=True)
        at, last, out = np.zeros(apart, np.int64), None, []
        for blk, m in zip(rows["blk"], rows["m"], strict=True):
            if last is not None and blk > last + 1:
                at = np.full(apart, at[0])
            out.append(at)
            at, last = (at[:, None] + np.asarray(m).reshape(apart, apart)).max(0), blk
        return rows[["blk"]].assign(entered=out)

    def ways(row) -> list[tuple]:
        found = hmm.spaced_walk(np.asarray(row.at), np.asarray(row.weight), row.blk * block, block, apart, np.asarray(row.entered), list(range(apart)))
        return [(row.blk, [limit for _, limit in found])]

    def limits(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("blk", ascending=False, ignore_index=True)
        at, last, out = 0, None, []
        for blk, way in zip(rows["blk"], rows["way"], strict=True):
            if last is not None and blk < last - 1:
                at = 0
            out.append(at)
            at, last = int(way[at]), blk
        return rows[["blk"]].assign(limit=np.array(out, np.int32))

    def choose(row) -> list[tuple]:
        taken, _ = hmm.spaced_walk(np.asarray(row.at), np.asarray(row.weight), row.blk * block, block, apart, np.asarray(row.entered), [row.limit])[0]
        return [(int(x),) for x in taken]

    def together(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        return df.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda rows: fn(rows.drop(columns="_all")), schema)

    entered = kept(blocks.join(together(_mapped(blocks, fold, "blk long, m array<long>"), enter, "blk long, entered array<long>"), "blk"))
    left = together(_mapped(entered, ways, "blk long, way array<int>"), limits, "blk long, limit int")
    return _mapped(entered.join(left, "blk"), choose, "breakpoint int")


def merged(signals: DataFrame, sites: int, bandwidth: int = 12, apart: int = 15, most: int | None = None, penalty: float = 2.5) -> DataFrame:
    """rank and the columns of ``centres``: of those ``apart`` from each other and from both ends, the set with the largest sum of score less penalty.

    ``most``: how many at most; by default as many as find room. With it, the centres of one alignment come together in the last
    step, which holds ``most`` numbers for each; without it, blocks of sites choose on their own (``spaced``).
    """
    held = centres(signals, bandwidth).filter(F.col("breakpoint").between(apart, sites - apart))
    if most is None and apart > 0:
        held = kept(held)
        # the score has nine digits
        weight = F.round((F.round("score", 9) - penalty) * 1e9).cast("long")
        taken = kept(held.join(spaced(held.select("breakpoint", weight.alias("weight")), apart), "breakpoint"))
        # ranks in two levels: those of a range of scores are ordered in a task
        s = F.round("score", 9)
        binned = taken.withColumn("_bin", F.floor(s * 16))
        above = Window.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each range of scores
        before = binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n")).select("_bin", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_before"))
        rank = F.col("_before") + F.row_number().over(Window.partitionBy("_bin").orderBy(s.desc(), "breakpoint"))
        return binned.join(before, "_bin").select("breakpoint", "triplets", "score", "low", "high", rank.cast("int").alias("rank"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("breakpoint", ignore_index=True)
        at, s = rows["breakpoint"].to_numpy(), rows["score"].round(9).to_numpy()
        taken = hmm.weighted_intervals(at, at, s - penalty, apart, min(most or sites // max(apart, 1) + 1, len(at)))
        return rows.drop(columns="_all").iloc[sorted(taken, key=lambda k: (-s[k], at[k]))].assign(rank=np.arange(1, len(taken) + 1, dtype=np.int32))

    return held.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "breakpoint int, triplets long, score double, low int, high int, rank int")


def cuts(candidates: DataFrame, sites: int, most: int = 12, least: int = 30) -> DataFrame:
    """dataset, rank, breakpoint, score of the cuts between which trees are fitted, spread over the alignment first.

    Those that are spread are found first, one of every dataset in a pass over the candidates; they and the best ``2 * most``,
    all that the choice can fall on, then come together.
    """
    held = kept(candidates.filter((F.col("breakpoint") >= least) & (sites - F.col("breakpoint") >= least)).select("dataset", "breakpoint", "score"))
    apart, whole = max(least, sites // most), "dataset string, taken array<struct<breakpoint:int,score:double>>"
    taken = held.sparkSession.createDataFrame([], whole)
    for _ in range(most):
        # a few numbers for each dataset
        free = held.join(F.broadcast(taken), "dataset", "left").withColumn("taken", F.coalesce("taken", F.array().cast(taken.schema["taken"].dataType)))
        free = free.filter(F.forall("taken", lambda t: F.abs(F.col("breakpoint") - t["breakpoint"]) >= apart))
        best = free.groupBy("dataset").agg(F.max_by(F.struct(F.col("breakpoint").cast("int").alias("breakpoint"), F.col("score").cast("double").alias("score")), F.struct(F.col("score"), -F.col("breakpoint"))).alias("one"))
        if best.isEmpty():
            break
        both = taken.join(best, "dataset", "full")
        taken = kept(both.select("dataset", F.concat(F.coalesce("taken", F.array().cast(taken.schema["taken"].dataType)), F.when(F.col("one").isNull(), F.array().cast(taken.schema["taken"].dataType)).otherwise(F.array("one"))).alias("taken")))
    first = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("score"), "breakpoint"))
    strong = held.withColumn("_r", first).filter(F.col("_r") <= 2 * most).drop("_r")
    few = strong.unionByName(taken.select("dataset", F.inline("taken"))).distinct()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at, s = rows["breakpoint"].to_numpy(), rows["score"].to_numpy()
        taken = hmm.spread_cuts(at, s, sites, most, least)
        return pd.DataFrame({"dataset": key[0], "rank": np.arange(1, len(taken) + 1, dtype=np.int32), "breakpoint": at[taken].astype(np.int32), "score": s[taken]})

    return few.groupBy("dataset").applyInPandas(run, "dataset string, rank int, breakpoint int, score double")


def directional_gap(forward: DataFrame, backward: DataFrame, bit: int, opens: bool, price: float, best: Column | float = 0.0) -> DataFrame:
    """boundary, gap: least cost of masks that open (or close) a bit at a boundary, less the best cost, not below 0.

    forward and backward: (boundary, mask, cost) before and after each boundary; each other flipped bit costs ``price`` too.
    """
    was, now = (0, 1) if opens else (1, 0)
    f = forward.filter(F.expr(f"(mask >> {bit}) & 1 = {was}")).select("boundary", F.col("mask").alias("x"), F.col("cost").alias("before"))
    b = backward.filter(F.expr(f"(mask >> {bit}) & 1 = {now}")).select("boundary", F.col("mask").alias("y"), F.col("cost").alias("after"))
    whole = F.col("before") + F.col("after") + F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) * price
    forced = f.join(b, "boundary").groupBy("boundary").agg(F.min(whole).alias("forced"))
    return forced.select("boundary", F.greatest(F.col("forced") - best, F.lit(0.0)).alias("gap"))


def path_penalties(taxa: Column, sites: Column, given: dict[str, Column], window: Column) -> dict[str, Column]:
    """Penalties of the path search: what is given if above 0; 0 asks for one by the alignment's size; else fixed ones."""
    least = F.greatest(F.lit(16), F.round(F.coalesce(window, F.greatest(F.lit(64.0), F.least(F.lit(250.0), sites / 8)))))
    by_size = {"breakpoint": F.log2(sites + 1), "endpoint": F.greatest(F.lit(1.0), F.log2(taxa) / 2), "span": 1 / F.greatest(F.lit(80.0), least)}
    fixed = {"breakpoint": 4.0, "endpoint": 1.0, "span": 0.002}  # fixed values
    return {k: F.when(given[k] > 0, given[k]).when(given[k] == 0, by_size[k]).otherwise(fixed[k]) for k in fixed}
