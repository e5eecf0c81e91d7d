"""Queries of long chains, searches over their states, triplet plans and prices of intervals."""

from __future__ import annotations

import numpy as np

from ..operators import chains as C
from ..operators import path_search as S
from ..operators import triplets as P
from ..operators.subset_search import SubsetSearch
from .helpers import F, oracle, query, relation, rounded, table

#: Weights and rate of the reset chain that the queries follow.
_W, _Q = (0.4, 0.3, 0.2, 0.1), 0.1
_STATES = 4
#: Scores are whole fortieths, so that ties and sums are the same in any order.
_PRICE = 25


def _emission(spark, sf):
    return relation(spark, sf, "emission").select("site", F.col("tree_id").alias("state"), F.col("logl").alias("value"))


def _columns(make):
    return ", ".join(make(k) for k in range(_STATES))


_FORWARD = f"""em AS MATERIALIZED (SELECT site, MAX(logl) AS top, {_columns(lambda k: f"exp(MAX(logl) FILTER (tree_id = {k}) - MAX(logl)) AS e{k}")} FROM emission GROUP BY site),
    fw AS (SELECT site, {_columns(lambda k: f"a{k} / (a0 + a1 + a2 + a3) AS a{k}")}, top + ln(a0 + a1 + a2 + a3) AS ll FROM (SELECT site, top, {_columns(lambda k: f"{_W[k]} * e{k} AS a{k}")} FROM em WHERE site = 1)
      UNION ALL SELECT site, {_columns(lambda k: f"a{k} / (a0 + a1 + a2 + a3)")}, ll + top + ln(a0 + a1 + a2 + a3) FROM (SELECT em.site, em.top, fw.ll, {_columns(lambda k: f"({1 - _Q} * fw.a{k} + {_Q * _W[k]}) * em.e{k} AS a{k}")} FROM fw JOIN em ON em.site = fw.site + 1)),
    bw AS (SELECT site, {_columns(lambda k: f"1.0::DOUBLE AS b{k}")} FROM em WHERE site = (SELECT MAX(site) FROM em)
      UNION ALL SELECT site, {_columns(lambda k: f"({1 - _Q} * x{k} + z) / (x0 + x1 + x2 + x3)")} FROM (SELECT *, {" + ".join(f"{_Q * _W[k]} * x{k}" for k in range(_STATES))} AS z FROM (SELECT em.site - 1 AS site, {_columns(lambda k: f"bw.b{k} * em.e{k} AS x{k}")} FROM bw JOIN em ON em.site = bw.site WHERE em.site > 1)))"""


@query("chain_reset_posterior", oracle(f"""WITH RECURSIVE {_FORWARD}, j AS (SELECT site, {_columns(lambda k: f"a{k} * b{k} AS p{k}")} FROM fw JOIN bw USING (site))
    SELECT site, state, round(CASE state WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END / (p0 + p1 + p2 + p3), 6) AS posterior, round((SELECT ll FROM fw ORDER BY site DESC LIMIT 1), 4) AS total
    FROM j CROSS JOIN (SELECT unnest(range(4))::INT AS state)"""))
def reset_posterior(spark, sf):
    """Posterior of every state of a reset chain, by blocks of 128 sites."""
    found = C.Chains(_emission(spark, sf), [], {0: C.reset_model(np.array(_W), _Q)}, block=128, fan=8).decode()
    cells = found.select("site", "total", F.posexplode("posterior").alias("state", "posterior"))
    return cells.select("site", "state", F.round("posterior", 6).alias("posterior"), F.round("total", 4).alias("total"))


_BEST = f"""WITH RECURSIVE em AS MATERIALIZED (SELECT site, list(round(logl * 40)::BIGINT ORDER BY tree_id) AS e FROM emission GROUP BY site),
    fw(site, v, back) AS (SELECT site, e, [0, 0, 0, 0]::BIGINT[] FROM em WHERE site = 1
      UNION ALL SELECT site, list_transform(range(1, 5), lambda j: e[j] + list_max(x[j])), list_transform(range(1, 5), lambda j: list_position(x[j], list_max(x[j]))::BIGINT)
        FROM (SELECT em.site, em.e, list_transform(range(1, 5), lambda j: list_transform(range(1, 5), lambda i: v[i] - CASE WHEN i = j THEN 0 ELSE {_PRICE} END)) AS x FROM fw JOIN em ON em.site = fw.site + 1)),
    held AS MATERIALIZED (SELECT * FROM fw),
    path(site, state) AS (SELECT site, list_position(v, list_max(v))::BIGINT FROM held WHERE site = (SELECT MAX(site) FROM held)
      UNION ALL SELECT h.site - 1, h.back[p.state] FROM path p JOIN held h ON h.site = p.site WHERE h.site > 1)
    SELECT site, (state - 1)::INT AS state, (SELECT list_max(v) FROM held ORDER BY site DESC LIMIT 1)::DOUBLE AS score FROM path"""


@query("chain_best_path", oracle(_BEST))
def best_path(spark, sf):
    """The best path where each change of state has a price, by blocks of 64 sites, and its score."""
    rows = _emission(spark, sf).withColumn("value", F.round(F.col("value") * 40))
    chains = C.Chains(rows, [], {0: C.switch_model(_STATES, _PRICE)}, block=64, fan=8)
    score = chains.totals("most").select("total")
    return chains.paths().select("site", "state").crossJoin(F.broadcast(score)).select("site", "state", F.col("total").alias("score"))


@query("chain_user_paths", oracle("""WITH RECURSIVE em AS MATERIALIZED (SELECT chain, pos, state, COUNT(*) OVER (PARTITION BY chain) AS n FROM events_chain),
    fw(chain, pos, n, v, back) AS (SELECT chain, pos, n, list_transform(range(4), lambda j: CASE WHEN j = state THEN 0 ELSE -3 END), [0, 0, 0, 0]::BIGINT[] FROM em WHERE pos = 1
      UNION ALL SELECT chain, pos, n, list_transform(range(1, 5), lambda j: CASE WHEN j - 1 = state THEN 0 ELSE -3 END + list_max(x[j])), list_transform(range(1, 5), lambda j: list_position(x[j], list_max(x[j]))::BIGINT)
        FROM (SELECT em.chain, em.pos, em.n, em.state, list_transform(range(1, 5), lambda j: list_transform(range(1, 5), lambda i: fw.v[i] - CASE WHEN i = j THEN 0 ELSE 2 END)) AS x FROM fw JOIN em ON em.chain = fw.chain AND em.pos = fw.pos + 1)),
    held AS MATERIALIZED (SELECT * FROM fw),
    path(chain, pos, state) AS (SELECT chain, pos, list_position(v, list_max(v))::BIGINT FROM held WHERE pos = n
      UNION ALL SELECT h.chain, h.pos - 1, h.back[p.state] FROM path p JOIN held h ON h.chain = p.chain AND h.pos = p.pos WHERE h.pos > 1)
    SELECT chain, pos::BIGINT AS pos, (state - 1)::INT AS state FROM path"""))
def user_paths(spark, sf):
    """Events of every user smoothed by the best path of a chain: a wrong state costs 3, a change 2; blocks of 32 events."""
    events = relation(spark, sf, "events_chain")
    rows = events.select("chain", "pos", F.array(*[F.when(F.col("state") == j, 0.0).otherwise(-3.0) for j in range(4)]).alias("values"))
    found = C.Chains(rows, ["chain"], {0: C.switch_model(4, 2)}, site="pos", values="values", block=32, fan=8).paths()
    return found.select("chain", F.col("site").alias("pos"), "state")


@query("chain_reset_weights", oracle("""WITH RECURSIVE n AS (SELECT COUNT(DISTINCT site) AS n FROM emission), rates AS (SELECT unnest([2.0, 8.0, 32.0])::DOUBLE AS expected),
    em AS MATERIALIZED (SELECT site, list(exp(logl - top) ORDER BY tree_id) AS e FROM (SELECT *, MAX(logl) OVER (PARTITION BY site) AS top FROM emission) GROUP BY site),
    fw(expected, q, site, a, s) AS (SELECT expected, least(0.5, expected / n), 1, list_transform(e, lambda x: x / list_sum(e)), list_sum(e) / 4 FROM rates, n, em WHERE site = 1
      UNION ALL SELECT expected, q, site, list_transform(x, lambda y: y / list_sum(x)), list_sum(x) FROM (SELECT fw.expected, fw.q, em.site, list_transform(range(1, 5), lambda i: ((1 - fw.q) * fw.a[i] + fw.q / 4) * em.e[i]) AS x FROM fw JOIN em ON em.site = fw.site + 1)),
    held AS MATERIALIZED (SELECT * FROM fw),
    bw(expected, site, b, drawn) AS (SELECT expected, h.site, [1.0, 1.0, 1.0, 1.0]::DOUBLE[], list_transform(em.e, lambda x: q / 4 * x / s) FROM held h JOIN em USING (site) WHERE h.site = (SELECT MAX(site) FROM em)
      UNION ALL SELECT y.expected, y.site, y.b, CASE WHEN y.site = 1 THEN list_transform(range(1, 5), lambda i: y.b[i] * h.a[i]) ELSE list_transform(range(1, 5), lambda i: h.q / 4 * em.e[i] * y.b[i] / h.s) END
        FROM (SELECT expected, site - 1 AS site, list_transform(x, lambda v: ((1 - q) * v + q / 4 * list_sum(x)) / s) AS b FROM (SELECT bw.expected, bw.site, h.q, h.s, list_transform(range(1, 5), lambda i: bw.b[i] * em.e[i]) AS x FROM bw JOIN em ON em.site = bw.site JOIN held h ON h.site = bw.site AND h.expected = bw.expected WHERE bw.site > 1)) y
        JOIN em ON em.site = y.site JOIN held h ON h.site = y.site AND h.expected = y.expected),
    t AS (SELECT expected, state, SUM(drawn[state + 1]) + 0.05 AS w FROM bw CROSS JOIN (SELECT unnest(range(4))::INT AS state) GROUP BY ALL)
    SELECT expected, state, round(w / SUM(w) OVER (PARTITION BY expected), 6) AS weight FROM t"""))
def reset_weights(spark, sf):
    """Weights of a reset chain after one step of EM from even ones, for three expected numbers of resets in one job."""
    expected = [2.0, 8.0, 32.0]
    weights, _, _ = C.fit_resets(_emission(spark, sf), _STATES, expected, steps=1, block=128, fan=8)
    return rounded(spark.createDataFrame([(expected[r], k, float(x)) for r, w in weights.items() for k, x in enumerate(w)], "expected double, state int, weight double"))


@query("chain_subset_search", oracle("""WITH RECURSIVE em AS MATERIALIZED (SELECT site, list(logl ORDER BY tree_id) AS v FROM emission GROUP BY site), n AS (SELECT COUNT(*) AS n FROM em),
    subs AS MATERIALIZED (SELECT m AS mask, list_filter(range(4), lambda k: (m >> k) & 1 = 1) AS members FROM (SELECT unnest(range(1, 16)) AS m)),
    vals AS MATERIALIZED (SELECT mask, site, list_transform(members, lambda k: v[k + 1]) AS x FROM subs CROSS JOIN em),
    part AS MATERIALIZED (SELECT mask, site, list_max(x) AS top, x, list_transform(x, lambda y: exp(y - list_max(x))) AS l FROM vals),
    share AS (SELECT mask, slot, SUM(l[slot] / list_sum(l)) + 0.05 AS w FROM (SELECT *, unnest(range(1, len(l) + 1)) AS slot FROM part) GROUP BY ALL),
    wts AS MATERIALIZED (SELECT mask, list(w / total ORDER BY slot) AS w FROM (SELECT *, SUM(w) OVER (PARTITION BY mask) AS total FROM share) GROUP BY mask),
    tries AS MATERIALIZED (SELECT mask, w, expected, 1 - exp(-expected / (n - 1)) AS t FROM wts CROSS JOIN n CROSS JOIN (SELECT unnest([0, 0.25, 0.5, 1, 2, 4, 6, 8, 9])::DOUBLE AS expected)
      WHERE CASE WHEN len(w) = 1 THEN expected = 0 WHEN len(w) < 4 THEN expected <= 6 ELSE expected <= 9 AND expected <> 6 END),
    fw(mask, expected, t, w, site, a, ll) AS (SELECT g.mask, expected, t, w, 1, list_transform(range(1, len(w) + 1), lambda i: w[i] * l[i] / list_sum(list_transform(range(1, len(w) + 1), lambda j: w[j] * l[j]))), top + ln(list_sum(list_transform(range(1, len(w) + 1), lambda j: w[j] * l[j]))) FROM tries g JOIN part p ON p.mask = g.mask AND p.site = 1
      UNION ALL SELECT mask, expected, t, w, site, list_transform(x, lambda y: y / list_sum(x)), ll + top + ln(list_sum(x)) FROM (SELECT fw.mask, fw.expected, fw.t, fw.w, p.site, fw.ll, p.top, list_transform(range(1, len(fw.w) + 1), lambda i: ((1 - fw.t) * fw.a[i] + fw.t * fw.w[i]) * p.l[i]) AS x FROM fw JOIN part p ON p.mask = fw.mask AND p.site = fw.site + 1)),
    ends AS (SELECT mask, expected, ll FROM fw CROSS JOIN n WHERE site = n),
    best AS (SELECT mask, MAX(ll) AS logl, arg_max(expected, (round(ll, 9), -expected)) AS resets FROM ends GROUP BY mask),
    crit AS (SELECT array_to_string(members, ',') AS subset, len(members) AS states, logl, resets, CASE WHEN len(members) = 1 THEN 22 ELSE 8 + len(members) * 15 END AS k, n FROM best JOIN subs USING (mask) CROSS JOIN n),
    aicc AS (SELECT *, 2 * k - 2 * logl + 2.0 * k * (k + 1) / (n - k - 1) AS criterion FROM crit)
    SELECT subset, states::INT AS states, round(logl, 4) AS logl, round(criterion, 4) AS criterion, k::INT AS parameters, resets, criterion = MIN(criterion) OVER () AS chosen FROM aicc"""))
def subset_search(spark, sf):
    """All subsets of states that the search scores, and the one it ends at: with a beam of six over four states, all of them."""
    search = SubsetSearch(_emission(spark, sf), _STATES, taxa=8, block=256, fan=8)
    return rounded(search.hypotheses(search.run(beam=6)), 4)


_THIRD = "CASE WHEN h + (h >= p)::INT >= q THEN h + (h >= p)::INT + 1 ELSE h + (h >= p)::INT END"
_CHOSEN = f"""WITH n AS (SELECT COUNT(*)::BIGINT AS n, (COUNT(*) * (COUNT(*) - 1) * (COUNT(*) - 2) // 6)::BIGINT AS total FROM supplier),
    t AS MATERIALIZED (SELECT a, b, c, row_number() OVER (ORDER BY a, b, c) - 1 AS rank FROM n, (SELECT unnest(range(n)) AS a FROM n), (SELECT unnest(range(n)) AS b FROM n), (SELECT unnest(range(n)) AS c FROM n) WHERE a < b AND b < c),
    pairs AS (SELECT p, q, {_THIRD} AS r FROM (SELECT p, q, xor((p + 1) * 2654435761 % 4294967296, (q + 1) * 2246822519 % 4294967296) % (n - 2) AS h FROM n, (SELECT unnest(range(n)) AS p FROM n), (SELECT unnest(range(n)) AS q FROM n) WHERE p < q AND n > 2)),
    cover AS MATERIALIZED (SELECT DISTINCT t.rank FROM pairs JOIN t ON t.a = least(p, q, r) AND t.c = greatest(p, q, r) AND t.b = p + q + r - least(p, q, r) - greatest(p, q, r)),
    g AS (SELECT total, least(total, greatest(least(total, 6000), (SELECT COUNT(*) FROM cover))) AS target, (SELECT COUNT(*) FROM cover) AS size FROM n),
    spaced AS MATERIALIZED (SELECT rank FROM (SELECT rank, row_number() OVER (ORDER BY id) AS k, room FROM (SELECT least(total - 1, floor((id + 0.5::DOUBLE) * total / target))::BIGINT AS rank, MIN(id) AS id, any_value(target - size) AS room FROM g, (SELECT unnest(range((SELECT target FROM g))) AS id) GROUP BY 1) WHERE rank NOT IN (SELECT rank FROM cover)) WHERE k <= room),
    held AS MATERIALIZED (SELECT rank FROM cover UNION ALL SELECT rank FROM spaced),
    low AS (SELECT rank FROM (SELECT rank, row_number() OVER (ORDER BY rank) AS k FROM t WHERE rank NOT IN (SELECT rank FROM held)) WHERE k <= (SELECT target FROM g) - (SELECT COUNT(*) FROM held))
    SELECT rank, a, b, c FROM t JOIN (SELECT rank FROM held UNION ALL SELECT rank FROM low) USING (rank)"""


def _plan(spark, sf):
    taxa = table(spark, sf, "supplier").count()
    return P.plan(spark, taxa, 6000), taxa


@query("triplet_plan", oracle(_CHOSEN))
def triplet_plan(spark, sf):
    """Triplets of suppliers to scan within a budget of 6,000: all if they fit, else a cover of all pairs, filled up."""
    return _plan(spark, sf)[0]


@query("triplet_plan_pairs", "SELECT a.k AS p, b.k AS q FROM (SELECT row_number() OVER () - 1 AS k FROM supplier) a JOIN (SELECT row_number() OVER () - 1 AS k FROM supplier) b ON a.k < b.k")
def triplet_plan_pairs(spark, sf):
    """The pairs of taxa that the plan's triplets hold: all of them, whatever the budget."""
    return P.pairs_held(*_plan(spark, sf))


#: Costs in whole fortieths; six candidates, each without cost in one of six stretches of every 300 sites.
_CANDIDATE = "CASE WHEN (site // 50) % 6 = c THEN 0 ELSE e[c % 4 + 1] + 20 END"
_INTERVALS = f"""WITH RECURSIVE em AS MATERIALIZED (SELECT site, list(round(-logl * 40)::BIGINT ORDER BY tree_id) AS e FROM emission GROUP BY site), n AS (SELECT MAX(site) AS n FROM em),
    fw(site, v) AS (SELECT site, e FROM em WHERE site = 1
      UNION ALL SELECT em.site, list_transform(range(1, 5), lambda j: em.e[j] + list_min(list_transform(range(1, 5), lambda i: fw.v[i] + CASE WHEN i = j THEN 0 ELSE 30 + 5 * abs(i - j) END))) FROM fw JOIN em ON em.site = fw.site + 1),
    bw(site, v) AS (SELECT site, e FROM em, n WHERE site = n
      UNION ALL SELECT em.site, list_transform(range(1, 5), lambda j: em.e[j] + list_min(list_transform(range(1, 5), lambda i: bw.v[i] + CASE WHEN i = j THEN 0 ELSE 30 + 5 * abs(i - j) END))) FROM bw JOIN em ON em.site = bw.site - 1),
    cand AS (SELECT c, list_transform(range(4), lambda s: 1 + abs(s - c % 4)) AS d FROM (SELECT unnest(range(6)) AS c)),
    own AS (SELECT c, site, {_CANDIDATE} AS own, COALESCE((SELECT list_min(list_transform(range(1, 5), lambda s: fw.v[s] + 30 + 5 * d[s])) FROM fw WHERE fw.site = em.site - 1), 0) AS enter,
      COALESCE((SELECT list_min(list_transform(range(1, 5), lambda s: bw.v[s] + 30 + 5 * d[s])) FROM bw WHERE bw.site = em.site + 1), 0) AS leave FROM em CROSS JOIN cand),
    p AS (SELECT *, SUM(own) OVER (PARTITION BY c ORDER BY site ROWS UNBOUNDED PRECEDING) AS p FROM own),
    m AS (SELECT c, MIN(start + p + leave) AS best FROM (SELECT *, MIN(enter - (p - own)) OVER (PARTITION BY c ORDER BY site ROWS UNBOUNDED PRECEDING) AS start FROM p) GROUP BY c)
    SELECT c::INT AS candidate, ((SELECT list_min(v) FROM fw, n WHERE site = n) - best)::DOUBLE AS gain FROM m"""


@query("interval_prices", oracle(_INTERVALS))
def interval_prices(spark, sf):
    """What six candidate states would save along the emission's best path in one interval each, by blocks of 128 sites."""
    k = np.arange(4)
    away = np.abs(k[:, None] - k[None, :]).astype(float)
    model = (np.zeros(4), np.where(np.eye(4, dtype=bool), 0.0, -(30 + 5 * away)))
    rows = _emission(spark, sf).withColumn("value", F.round(F.col("value") * 40))
    chains = C.Chains(rows, [], {0: model}, block=64, fan=8)
    margins = chains.margins().select("site", *[F.transform(x, lambda v: -v).alias(x) for x in ("upto", "onward")])
    objective = -chains.totals("most").first()["total"]
    own = rows.crossJoin(F.broadcast(spark.range(6).select(F.col("id").cast("int").alias("candidate")))).filter("state = candidate % 4")
    scores = own.select("candidate", "site", F.when(F.expr("(site div 50) % 6 = candidate"), 0.0).otherwise(20 - F.col("value")).alias("score"))
    away = {c: [1.0 + abs(s - c % 4) for s in range(4)] for c in range(6)}
    return S.interval_prices(margins, scores, away, dict.fromkeys(range(6), 0.0), objective, 30.0, 5.0, block=128)


@query("rooted_path", oracle("SELECT 1::BIGINT AS first, MAX(site)::BIGINT AS last, 0::BIGINT AS gaps, true AS falls, COUNT(DISTINCT site)::BIGINT AS sites FROM aln"))
def rooted_path(spark, sf):
    """Trees along the alignment of eight taxa, by a short search; what every path must be: whole, in order, and no costlier round by round."""
    search = S.PathSearch(relation(spark, sf, "aln"), 8, S.Settings(states=12, rounds=2, screen=24, block=512))
    found = search.run((((("0", "1"), "2"), "3"), ((("4", "5"), "6"), "7")))
    runs = search.runs(found)
    gaps = runs.select((F.col("end") + 1).alias("start")).join(runs.select("start"), "start", "left_anti")
    costs = [r[1] for r in found.rounds]
    falls = all(b <= a + 1e-9 for a, b in zip(costs, costs[1:], strict=False))
    whole = runs.agg(F.min("start").alias("first"), F.max("end").alias("last"), F.sum(F.col("end") - F.col("start") + 1).alias("sites"))
    return whole.crossJoin(gaps.agg((F.count(F.lit(1)) - 1).alias("gaps"))).select("first", "last", "gaps", F.lit(falls).alias("falls"), "sites")
