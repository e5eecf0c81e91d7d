"""Settings of simulations as JSON texts, brought within their bounds, and draws from their distributions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..kernels.simulate import preset_curves

#: Defaults of the settings.
TREE = {"observedTips": 48, "initialTips": 3, "replicates": 4, "horizon": 20.0, "branchScale": 0.005, "hazardBins": 4096}
RECOMBINATION = {"eventRate": 0.004, "meanBreakpoints": 2.0, "meanTractCodons": 75.0, "hotspotCount": 3, "hotspotWidth": 12.0, "hotspotIntensity": 8.0, "carrierOversample": 2.5}
EXCHANGEABILITIES = [1, 2.186519, 0.489476, 0.855297, 2.077248, 0.564529]
F3X4 = [0.293117, 0.184379, 0.295274, 0.190878, 0.342317, 0.199907, 0.154328, 0.267101, 0.231987, 0.217801, 0.241637, 0.272234]
GAMMA = {"alpha": (1.0, 2.0), "omega": (0.55, 0.8), "eventRate": (12.0, 3.0), "equilibriumSigma": (2.2, 8.0), "mixingRate": (1.0, 3.0)}
SEED, CODONS = 20260814, 300

POINTS = "array<struct<time:double,value:double>>"


def _points(points: list[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(t)).alias("time"), F.lit(float(v)).alias("value")) for t, v in points])


def normalised(texts: DataFrame, text: str = "config") -> DataFrame:
    """texts with seed, simulate, tree, codon, recombination: every field of a settings text, or its default, within its bounds.

    Null and broken texts give the defaults, and so does a field that is missing or isn't a number. Numbers may be quoted.
    A distribution is fixed at its mean unless it says that it is gamma; those of a broken text are gamma.
    A curve needs two points, whose times are sorted, cut to the horizon and stretched to both ends.
    """
    raw = lambda path: F.get_json_object(text, f"$.{path}")

    broken = F.col(text).isNotNull() & F.try_parse_json(text).isNull()

    def number(path: str, default) -> Column:
        v = raw(path).try_cast("double")
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(default).cast("double")).otherwise(v)

    def least(path: str, default, low: float = 1e-8) -> Column:
        return F.greatest(number(path, default), F.lit(low))

    def whole(path: str, default, low, high) -> Column:
        return F.least(F.greatest(F.floor(number(path, default) + 0.5), F.lit(low)), F.lit(high) if not isinstance(high, Column) else high).cast("int")

    def marginal(path: str, read: Column | None = None) -> Column:
        mean, shape = GAMMA[path.split(".")[-1]]
        kind = raw(f"{path}.kind").eqNullSafe("gamma") | broken
        m, k = F.greatest(number(f"{path}.mean", mean), F.lit(0.0)), least(f"{path}.shape", shape, 0.03)
        if read is not None:
            kind, m, k = (kind & read) | broken, F.when(read, m).otherwise(mean), F.when(read, k).otherwise(shape)
        return F.struct(F.when(kind, "gamma").otherwise("fixed").alias("kind"), m.alias("mean"), F.when(kind, k).alias("shape"))

    def curve(path: str, default: list, positive: bool) -> Column:
        low, fallback = (1e-8, 1.0) if positive else (0.0, 0.0)
        kept = F.transform(F.from_json(raw(f"{path}.points"), POINTS), lambda p: F.struct(
            F.least(F.greatest(F.coalesce(p["time"], F.lit(0.0)), F.lit(0.0)), horizon).alias("time"), F.greatest(F.coalesce(p["value"], F.lit(fallback)), F.lit(low)).alias("value")))
        ordered = F.array_sort(kept, lambda x, y: F.when(x["time"] < y["time"], -1).when(x["time"] > y["time"], 1).otherwise(0))
        n = F.size(ordered)
        ends = F.transform(ordered, lambda p, k: F.struct(F.when(k == 0, 0.0).when(k == n - 1, horizon).otherwise(p["time"]).alias("time"), p["value"].alias("value")))
        space = F.when(raw(f"{path}.space") == "linear", "linear").otherwise("log")
        return F.when(n >= 2, F.struct(space.alias("space"), ends.alias("points"))).otherwise(F.struct(F.lit("log").alias("space"), _points(default).alias("points")))

    def numbers(path: str, n: int, default: list[float], fallback: float) -> Column:
        given = F.from_json(raw(path), "array<double>")
        return F.when(F.size(given) == n, F.transform(given, lambda v: F.greatest(F.coalesce(v, F.lit(fallback)), F.lit(1e-8)))).otherwise(F.array(*[F.lit(float(v)) for v in default]))

    horizon, tips = least("tree.horizon", TREE["horizon"], 0.1), whole("tree.observedTips", TREE["observedTips"], 2, 2000)
    shape = preset_curves("logistic", TREE["horizon"], TREE["observedTips"])
    tree = F.struct(
        tips.alias("observed_tips"), whole("tree.initialTips", TREE["initialTips"], 1, tips).alias("initial_tips"), whole("tree.replicates", TREE["replicates"], 1, 100).alias("replicates"),
        F.when(raw("tree.ploidy") == "2", 2).otherwise(1).alias("ploidy"), horizon.alias("horizon"), least("tree.branchScale", TREE["branchScale"], 1e-7).alias("branch_scale"),
        whole("tree.hazardBins", TREE["hazardBins"], 256, 32768).alias("hazard_bins"), curve("tree.population", shape["population"], True).alias("population"), curve("tree.sampling", shape["sampling"], False).alias("sampling"),
    )
    scuff = raw("codon.engine").eqNullSafe("scuff")
    only = lambda c: F.when(scuff, c)
    codon = F.struct(
        F.when(scuff, "scuff").otherwise("mg94").alias("engine"), whole("codon.sites", CODONS, 1, 10000).alias("sites"), whole("codon.geneticCodeId", 1, 1, 33).alias("genetic_code"),
        numbers("codon.gtr.exchangeabilities", 6, EXCHANGEABILITIES, 1.0).alias("exchangeabilities"), numbers("codon.gtr.f3x4", 12, F3X4, 0.25).alias("f3x4"),
        marginal("codon.alpha").alias("alpha"), F.when(~scuff, marginal("codon.omega", raw("codon.engine").eqNullSafe("mg94"))).alias("omega"),
        *[only(marginal(f"codon.{k}")).alias(k) for k in ("eventRate", "equilibriumSigma", "mixingRate")],
        only(F.greatest(number("codon.burninTime", 3), F.lit(0.0))).alias("burnin"), only(least("codon.diagnosticTime", 4, 0.01)).alias("diagnostic"),
    )
    r, d = "recombination.", RECOMBINATION
    recombination = F.struct(
        (raw(r + "enabled").isNotNull() & ~raw(r + "enabled").isin("false", "0", "", "null")).alias("enabled"), F.greatest(number(r + "eventRate", d["eventRate"]), F.lit(0.0)).alias("event_rate"),
        least(r + "meanBreakpoints", d["meanBreakpoints"]).alias("mean_breakpoints"), least(r + "meanTractCodons", d["meanTractCodons"]).alias("mean_tract_codons"),
        whole(r + "hotspotCount", d["hotspotCount"], 0, 100).alias("hotspot_count"), least(r + "hotspotWidth", d["hotspotWidth"]).alias("hotspot_width"),
        F.greatest(number(r + "hotspotIntensity", d["hotspotIntensity"]), F.lit(0.0)).alias("hotspot_intensity"),
        F.coalesce(F.transform(F.from_json(raw(r + "manualHotspots"), "array<double>"), lambda v: F.floor(F.coalesce(v, F.lit(1.0)) + 0.5).cast("int")), F.array().cast("array<int>")).alias("manual_hotspots"),
        F.least(F.greatest(number(r + "carrierOversample", d["carrierOversample"]), F.lit(1.0)), F.lit(20.0)).alias("carrier_oversample"),
    )
    seed, simulate = whole("seed", SEED, -2147483648, 2147483647), ~raw("simulateAlignment").eqNullSafe("false")
    return texts.select("*", seed.alias("seed"), simulate.alias("simulate"), tree.alias("tree"), codon.alias("codon"), recombination.alias("recombination"))


def carrier_tree(tree: str, carriers: Column) -> Column:
    """Settings of the tree of so many carriers: samples and first tips scaled by carriers over observed tips, the time kept."""
    t = F.col(tree)
    ratio = carriers / t["observed_tips"]
    first = F.when(t["initial_tips"] == t["observed_tips"], carriers).otherwise(F.greatest(F.lit(1), F.least(carriers, F.floor(t["initial_tips"] * ratio + 0.5))))
    points = F.transform(t["sampling"]["points"], lambda p: F.struct(p["time"].alias("time"), (p["value"] * ratio).alias("value")))
    scaled = t.withField("observed_tips", carriers.cast("int")).withField("initial_tips", first.cast("int"))
    return scaled.withField("sampling", F.struct(t["sampling"]["space"].alias("space"), points.alias("points")))


@pandas_udf(T.DoubleType())
def _gamma_at(p: pd.Series, mean: pd.Series, shape: pd.Series) -> pd.Series:
    from ..kernels.inference import gamma_quantiles

    q, m, k = p.to_numpy(float), mean.to_numpy(float), shape.fillna(1.0).to_numpy(float)
    out = np.full(len(q), np.nan)
    for one in np.unique(k):
        at = np.flatnonzero((k == one) & ~np.isnan(q) & ~np.isnan(m))
        out[at] = gamma_quantiles(q[at], float(one)) * m[at] / one
    return pd.Series([None if v else x for x, v in zip(out, np.isnan(out), strict=True)], dtype="float64")


def drawn(marginal: Column, *key: Column) -> Column:
    """A draw from a fixed or gamma distribution (kind, mean, shape) by its quantile at a hash of the key: reruns and retried tasks agree."""
    u = (F.pmod(F.xxhash64(*key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.when((marginal["kind"] == "fixed") | (marginal["mean"] == 0), marginal["mean"]).otherwise(_gamma_at(u, marginal["mean"], marginal["shape"]))
