"""Kernels against brute force, analytic values and invariances."""

import itertools
import math

import numpy as np
import pytest

from treeline.kernels import align, codon, hmm, inference, simulate, topology
from treeline.sources.parsers import parse_newick


def paths(k, n):
    return itertools.product(range(k), repeat=n)


def test_decode_matches_enumeration():
    rng = np.random.default_rng(0)
    e, init, t = rng.normal(size=(5, 3)), np.log(np.full(3, 1 / 3)), np.log(rng.dirichlet(np.ones(3), 3))
    scores = {p: init[p[0]] + sum(e[i, s] for i, s in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths(3, 5)}
    found = hmm.decode(e, init, t)
    assert found["logl"] == pytest.approx(np.logaddexp.reduce(list(scores.values())))
    assert tuple(found["path"]) == max(scores, key=scores.get)
    assert found["posterior"].sum(1) == pytest.approx(np.ones(5))


def test_reset_chain_is_the_dense_chain():
    rng = np.random.default_rng(1)
    e, w, q = rng.normal(size=(6, 4)), rng.dirichlet(np.ones(4)), 0.2
    dense = hmm.decode(e, np.log(w), np.log((1 - q) * np.eye(4) + q * w[None, :]))
    fast = hmm.reset_chain(e, w, q)
    assert fast["logl"] == pytest.approx(dense["logl"])
    assert fast["posterior"] == pytest.approx(dense["posterior"])
    assert (hmm.reset_viterbi(e, w, q) == dense["path"]).all()


def test_tree_chain_finds_a_planted_switch():
    rng = np.random.default_rng(2)
    e = rng.normal(size=(80, 3))
    e[:40, 0] += 2
    e[40:, 2] += 2
    fit = hmm.fit_trees(e, [1, 3])
    assert fit["states"] == (0, 2)
    assert abs(int((fit["path"] == 0).sum()) - 40) <= 3


def test_semi_markov_matches_enumeration():
    rng = np.random.default_rng(3)
    cost, jump, least = rng.random((7, 2)), np.array([[0, 0.3], [0.2, 0]]), 2

    def price(p):
        runs = [len(list(g)) for _, g in itertools.groupby(p)]
        if min(runs) < least:
            return math.inf
        return sum(cost[i, s] for i, s in enumerate(p)) + sum(jump[a, b] for a, b in zip(p, p[1:], strict=False) if a != b)

    path, total = hmm.semi_markov(cost, jump, least)
    best = min(paths(2, 7), key=price)
    assert total == pytest.approx(price(best))
    assert price(tuple(path)) == pytest.approx(total)


def test_mask_path_matches_dense_min_plus():
    rng = np.random.default_rng(4)
    cost, price = rng.random((5, 8)), np.array([0.1, 0.2, 0.4])
    step = np.array([[sum(price[b] for b in range(3) if (x ^ y) >> b & 1) for y in range(8)] for x in range(8)])
    at = cost[0]
    for t in range(1, 5):
        at = (at[:, None] + step).min(0) + cost[t]
    path, total = hmm.mask_path(cost, 3, price)
    assert total == pytest.approx(at.min())
    assert sum(cost[i, s] for i, s in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:], strict=False)) == pytest.approx(total)


def test_graph_path_matches_enumeration():
    rng = np.random.default_rng(5)
    cost = rng.random((4, 3)) * 3
    path, total = hmm.graph_path(cost, [(0, 1), (1, 2)], 0.5)
    hops = np.array([[0, 1, 2], [1, 0, 1], [2, 1, 0]]) * 0.5
    price = lambda p: sum(cost[i, s] for i, s in enumerate(p)) + sum(hops[a, b] for a, b in zip(p, p[1:], strict=False))
    assert total == pytest.approx(min(map(price, paths(3, 4))))
    assert price(tuple(path)) == pytest.approx(total)


def test_interval_scheduling_matches_brute_force():
    rng = np.random.default_rng(6)
    s = rng.integers(0, 40, 8)
    e, w = s + rng.integers(1, 8, 8), rng.random(8)
    best = 0.0
    for n in range(4):
        for pick in itertools.combinations(range(8), n):
            ok = all(e[a] + 2 <= s[b] or e[b] + 2 <= s[a] for a, b in itertools.combinations(pick, 2))
            best = max(best, sum(w[list(pick)])) if ok else best
    assert sum(w[hmm.weighted_intervals(s, e, w, 2, 3)]) == pytest.approx(best)


def test_breakpoint_matching():
    assert hmm.match_breakpoints([10, 52, 90], [12, 50, 55], 5) == (2, 4)
    assert hmm.match_breakpoints([], [3], 5) == (0, 0)


def test_short_runs_go():
    e = np.zeros((9, 2))
    e[:, 0] = 0.1
    assert (hmm.merge_short_runs(np.array([0, 0, 0, 0, 1, 0, 0, 0, 0]), e, 3) == 0).all()


def model():
    return codon.CodonModel(np.array([1, 2, 1, 1, 2, 1.0]), np.array([[0.3, 0.2, 0.2, 0.3], [0.25] * 4, [0.2, 0.3, 0.3, 0.2]]))


def test_eigen_transition_is_uniformisation():
    m = model()
    q = m.generator(0.8, 0.3)
    p = m.transition(0.8, 0.3, 0.7)
    assert p.sum(1) == pytest.approx(np.ones(len(p)))
    assert p == pytest.approx(codon.uniformised(q, 0.7, np.eye(len(q))), abs=1e-10)
    assert m.pi @ q == pytest.approx(np.zeros(len(q)), abs=1e-12)


def test_zero_lengths_give_equilibrium():
    m = model()
    tree = codon.Tree(parse_newick("(a:0,b:0,c:0);"))
    same = np.array([[3, 5], [3, 5], [3, -1]])
    assert codon.grid_likelihood(tree, m, same, np.array([1.0]), np.array([1.0]))[0] == pytest.approx(np.log(m.pi[[3, 5]]))


def test_batched_grid_is_the_plain_pruning():
    m = model()
    tree = codon.Tree(parse_newick("((a:0.1,b:0.3):0.2,c:0.4,d:0.1);"))
    rng = np.random.default_rng(14)
    states = rng.integers(-1, len(m.pi), (4, 9))
    a, b = np.array([0.2, 0.5, 1.0, 2.0, 1.0]), np.array([0.3, 0.4, 1.0, 0.2, 5.0])
    tips = {k: codon.tip_vectors(states[i], len(m.pi)) for i, k in enumerate(tree.tips)}
    got = codon.grid_likelihood(tree, m, states, a, b, block=2)
    for c in range(5):
        assert got[c] == pytest.approx(codon.prune(tree, tips, lambda k: m.transition(a[c], b[c], float(tree.length[k])), m.pi), abs=1e-6)  # noqa: B023


def test_pruning_matches_enumeration_and_messages():
    rates, pi = np.array([1, 2, 1, 1, 3, 1.0]), np.array([0.4, 0.2, 0.1, 0.3])
    system = codon.Reversible(codon.gtr_matrix(rates, pi), pi)
    tree = codon.Tree(parse_newick("((a:0.1,b:0.3):0.2,c:0.4,d:0.2);"))
    states = np.array([[0, 1], [0, 2], [1, -1], [3, 3]])
    tips = {k: codon.tip_vectors(states[i], 4) for i, k in enumerate(tree.tips)}
    p = lambda k: system.p(tree.length[k])
    got = codon.prune(tree, tips, p, pi)
    inner = next(k for k in range(1, len(tree.nodes)) if tree.children[k])
    want = []
    for s in range(2):
        total = 0.0
        for root, mid in itertools.product(range(4), repeat=2):
            v = pi[root] * p(inner)[root, mid]
            for k in tree.tips:
                v *= p(k)[mid if tree.parent[k] == inner else root] @ tips[k][:, s]
            total += v
        want.append(np.log(total))
    assert got == pytest.approx(want)
    down, up, logl = codon.messages(tree, tips, p, pi)
    assert logl == pytest.approx(want)
    for k in range(1, len(tree.nodes)):
        assert np.log((up[k] * (p(k) @ down[k])).sum(0)) == pytest.approx(want)


def test_em_and_samplers_agree():
    rng = np.random.default_rng(7)
    truth = rng.choice(3, 400, p=[0.6, 0.3, 0.1])
    l = np.full((3, 400), 0.05)  # noqa: E741
    l[truth, np.arange(400)] = 1
    l /= l.sum(0)
    em = inference.dirichlet_em(l)
    assert em.sum() == pytest.approx(1)
    for sampler in (inference.gibbs, inference.gibbs_rejection):
        assert sampler(l, draws=300, burn=50)[0] == pytest.approx(em, abs=0.03)
    assert inference.gibbs_collapsed(l[:, :150], draws=80, burn=20)[0] == pytest.approx(inference.dirichlet_em(l[:, :150]), abs=0.06)
    assert set(inference.sparse_dirichlet(np.vstack([l, np.full((1, 400), 1e-9)]))[0]) == {0, 1, 2}


def test_gamma_functions():
    assert inference.gamma_p(1.0, 2.0) == pytest.approx(1 - math.exp(-2))
    assert inference.gamma_p(3.0, inference.gamma_quantile(0.3, 3.0) * 3.0) == pytest.approx(0.3)
    assert np.mean(inference.gamma_slices(4, 0.5)) == pytest.approx(1)
    parts = inference.split_slices(4, 0.7, 0.8)
    assert sum(w for _, w in parts) == pytest.approx(1)
    assert sum(r * w for r, w in parts) == pytest.approx(0.8)
    assert inference.digamma(1.0) == pytest.approx(-0.5772156649, abs=1e-7)


def test_optimisers():
    assert inference.golden(lambda x: -((x - 1.3) ** 2), 0, 3)[0] == pytest.approx(1.3, abs=1e-4)
    f = lambda x: -((x[0] - 1) ** 2) - 3 * (x[1] + 0.5) ** 2
    assert inference.lbfgs(f, np.zeros(2))[0] == pytest.approx([1, -0.5], abs=1e-2)
    assert inference.nelder_mead(f, np.zeros(2), steps=120)[0] == pytest.approx([1, -0.5], abs=1e-2)


def test_interpolants():
    x = np.arange(4.0)
    z = np.add.outer(x**2, x)
    b = inference.Bicubic(x, x, z)
    assert b(2.0, 1.0) == pytest.approx(z[2, 1])
    y = inference.pchip(x, np.array([0, 1, 1, 4.0]), np.linspace(0, 3, 50))
    assert (np.diff(y) >= -1e-12).all()


def test_neighbour_joining_recovers_an_additive_tree():
    tree = topology.nested(parse_newick("((a:1,b:2):1,(c:3,d:1):2,e:1);"))
    names = list("abcde")
    d = np.array([[0, 3, 7, 5, 3], [3, 0, 8, 6, 4], [7, 8, 0, 4, 6], [5, 6, 4, 0, 4], [3, 4, 6, 4, 0.0]])
    assert topology.rf(topology.nested(topology.neighbour_joining(names, d)), tree) == 0


def test_spr_moves_invert():
    tree = topology.canonical((("a", "b"), (("c", "d"), "e")))
    for moved, _, after in itertools.islice(topology.spr_moves(tree), 15):
        assert topology.rooted_signature(topology.spr_apply(after, *topology.spr_invert(tree, moved))) == topology.rooted_signature(tree)
    assert len(topology.unrooted_neighbours((("a", "b"), "c", ("d", "e")))) == 12
    assert topology.spr_path(tree, topology.canonical((("a", "c"), (("b", "d"), "e"))))[-1] == topology.canonical((("a", "c"), (("b", "d"), "e")))


def test_distances_ignore_order_and_root():
    a, b = (("a", "b"), "c", ("d", "e")), ("e", "d", ("c", ("b", "a")))
    assert topology.rf(a, b) == 0
    assert len(topology.rootings(a)) == 7


def test_network_displays_and_time():
    net = {"a": ("u", None), "b": ("#r", None), "#r": ("u", "v"), "c": ("v", None), "u": ("root", None), "v": ("root", None)}
    assert topology.display(net, "root", 0, ["#r"]) == topology.canonical((("a", "b"), "c"))
    assert topology.display(net, "root", 1, ["#r"]) == topology.canonical(("a", ("b", "c")))
    assert topology.temporally_feasible(net)
    assert not topology.temporally_feasible(net | {"v": ("u", None)})


def best_alignment(scores, opening, extension):
    """Affine alignment by trying every path."""
    def whole(i, j, after):
        """Best score of prefixes; after: the layer of the step that follows, which pays for its own gap."""
        if i == 0 and j == 0:
            return 0.0
        out = []
        if i and j:
            out.append(whole(i - 1, j - 1, "m") + scores[i - 1][j - 1])
        for n in range(1, max(i, j) + 1):
            cost = opening + extension * (n - 1)
            if i >= n and after != "x":
                out.append(whole(i - n, j, "x") + cost)
            if j >= n and after != "y":
                out.append(whole(i, j - n, "y") + cost)
        return max(out) if out else -1e9

    return whole(len(scores), len(scores[0]), "m")


def test_alignment_matches_brute_force():
    rng = np.random.default_rng(13)
    for _ in range(12):
        scores = rng.integers(-3, 4, (int(rng.integers(1, 5)), int(rng.integers(1, 5)))).astype(float)
        got, pairs = align.align(scores, -2.5, -0.5)
        assert got == pytest.approx(best_alignment(scores.tolist(), -2.5, -0.5))
        assert [i for i, _ in pairs if i is not None] == list(range(len(scores)))
        local, part = align.align(scores, -2.5, -0.5, local=True)
        assert local >= max(0, scores.max()) - 1e-9 and all(i is None or j is None or scores[i, j] > -4 for i, j in part)
    x, y, s = align.align_text("ACGTT", "ACTT")
    assert x.replace("-", "") == "ACGTT" and y.replace("-", "") == "ACTT" and s == pytest.approx(2 * 4 - 4)
    left, right = align.seeded("ACGTTGCA" * 20 + "GGG", "ACGTTGCA" * 20)
    assert left.replace("-", "") == "ACGTTGCA" * 20 + "GGG" and len(left) == len(right)
    assert (align.blosum() == align.blosum().T).all() and align.blosum()[0, 0] == 4


def test_simulation_is_seeded_and_sane():
    a, b = simulate.dataset(5, 6, 30, events=1), simulate.dataset(5, 6, 30, events=1)
    assert a == b and {len(s) for s in a["sequences"]} == {90} and len(a["regions"]) == 2
    rng = np.random.default_rng(8)
    heights = []
    for _ in range(300):
        node, h = simulate.coalescent(2, rng), 0.0
        h = node.children[0].length
        heights.append(h)
    assert np.mean(heights) == pytest.approx(1.0, abs=0.2)


def planted_mosaic(sites=60):
    """Columns that favour ((a,b),(c,d),e) and then a moved to c."""
    half = sites // 2
    text = {"a": "A" * sites, "b": "A" * half + "C" * half, "c": "C" * half + "A" * half, "d": "C" * sites, "e": "C" * sites}
    return {n: np.array([1 << "ACGT".index(c) for c in s]) for n, s in text.items()}


def test_network_search_finds_a_planted_event():
    from treeline.kernels import network

    tree = ((("a", "b"), ("c", "d")), "e")
    net, root, path, total = network.search(tree, planted_mosaic(), 3.0, 3.0, 1)
    assert len(network.reticulations(net)) == 1
    assert total < network.score(*network.from_tree(tree), planted_mosaic(), 3.0, 3.0)[0]
    (bit, start, end), *_ = network.occurrences(path, 1)
    assert bit == 0 and (abs(start - 31) <= 2 or abs(end - 30) <= 2)
    assert len(network.displays(net, root)) == 2


def test_stepwise_partition():
    from treeline.kernels import network

    x = np.array([0.0] * 20 + [5.0] * 20)
    cost = lambda a, b: ((x[a - 1 : b] - x[a - 1 : b].mean()) ** 2).sum()
    assert network.stepwise(cost, 40, 3, 1.0) == [(1, 20), (21, 40)]
    assert network.stepwise(cost, 40, 3, 1e9) == [(1, 40)]


def test_linked_lengths():
    from treeline.kernels.linked import LinkedTrees

    rng = np.random.default_rng(12)
    pi = np.array([0.3, 0.2, 0.2, 0.3])
    system = codon.Reversible(codon.gtr_matrix(np.array([1, 2, 1, 1, 2, 1.0]), pi), pi)
    texts = ("((a:1,b:1):1,c:1,d:1);", "((a:1,c:1):1,b:1,d:1);")
    trees = [codon.Tree(parse_newick(t)) for t in texts]
    name = {"a": 0, "b": 1, "c": 2, "d": 3, "": 4}
    atoms = [[[] if k == 0 else [name[n.name]] if n.name else [4, 5][: 1 + i] for k, n in enumerate(t.nodes)] for i, t in enumerate(trees)]
    truth = np.array([0.1, 0.2, 0.3, 0.15, 0.1, 0.08])
    states = []
    for tree, own in zip(trees, atoms, strict=True):
        at = {0: rng.choice(4, 3000, p=pi)}
        for k in range(1, len(tree.nodes)):
            p = system.p(sum(truth[a] for a in own[k]))
            at[k] = np.array([rng.choice(4, p=p[s] / p[s].sum()) for s in at[tree.parent[k]]])
        states.append(np.stack([at[k] for k in tree.tips]))
    linked = LinkedTrees(trees, states, atoms, system, pi)
    x = np.full(6, 0.2)
    value, gradient = linked.evaluate(x)
    for k in range(6):
        e = np.eye(6)[k] * 1e-5
        assert gradient[k] == pytest.approx((linked.evaluate(x + e)[0] - linked.evaluate(x - e)[0]) / 2e-5, rel=1e-3)
    fitted, best = linked.fit(x)
    assert best > value and np.abs(fitted - truth).max() < 0.05


def test_transition_table_is_close():
    from treeline.kernels.linked import TransitionTable

    pi = np.array([0.3, 0.2, 0.2, 0.3])
    parts = [(w, codon.Reversible(codon.gtr_matrix(np.ones(6), pi) * r, pi)) for w, r in ((0.6, 0.5), (0.4, 1.7))]
    table = TransitionTable(parts, pi)
    for t in (0.0, 0.013, 0.4, 1.234):
        assert table.p(t) == pytest.approx(sum(w * s.p(t) for w, s in parts), abs=2e-3)
    assert table.p(9.0) == pytest.approx(np.tile(pi, (4, 1)))


def test_stacked_grids_against_pruning_of_each_category():
    """Ratios by branch class and mixtures of slices, from stacked operators, against one pruning for each category."""
    rng = np.random.default_rng(21)
    root = parse_newick("((a{G1}:0.1,b{G1}:0.2){G1}:0.15,(c{G2}:0.3,d:0.12):0.2,e:0.4);")
    tree = codon.Tree(root)
    model = codon.CodonModel(np.array([1.0, 2.0, 0.7, 1.1, 2.4, 0.9]), rng.dirichlet(np.ones(4) * 9, 3))
    states = rng.integers(-1, len(model.pi), (5, 9))
    states[:, 0] = states[0, 0]
    tips = {k: codon.tip_vectors(states[i], len(model.pi)) for i, k in enumerate(tree.tips)}
    group = [{"G1": 0, "G2": 1}.get(n.tag, 2) for n in tree.nodes]
    omegas = [[0.1, 1.0, 3.0], [0.5, 2.0], [0.3, 0.9]]
    got = codon.class_grid_likelihood(tree, model, states, group, 0.7, omegas, block=4)
    assert got.shape == (3, 2, 2, 9)
    for i, j, k in np.ndindex(3, 2, 2):
        w = (omegas[0][i], omegas[1][j], omegas[2][k])
        want = codon.prune(tree, tips, lambda n: model.transition(0.7, 0.7 * w[group[n]], float(tree.length[n])), model.pi)  # noqa: B023
        assert np.allclose(got[i, j, k], want, atol=1e-9)
    mixtures, alphas = [np.array([0.1, 0.5, 2.0, 1.0]), np.array([1.0, 1.0, 0.3, 1.0])], [0.4, 1.5]
    got = codon.slice_mixture_likelihood(tree, model, states, alphas, mixtures, block=5)
    for i, j in np.ndindex(2, 2):
        want = codon.mixture_likelihood(tree, model, states, [(0.25, alphas[j], alphas[j] * w) for w in mixtures[i]])
        assert np.allclose(got[i, j], want, atol=1e-8)
    a, b = np.array([0.2, 1.0, 3.0]), np.array([0.5, 1.0, 0.05])
    got = codon.grid_likelihood(tree, model, states, a, b, block=2)
    for i in range(3):
        assert np.allclose(got[i], codon.prune(tree, tips, lambda n: model.transition(a[i], b[i], float(tree.length[n])), model.pi), atol=1e-9)  # noqa: B023
