"""Tree building and rearrangement: neighbour joining, splits, SPR moves, parsimony, networks."""

from __future__ import annotations

import hashlib
import itertools
from collections import deque

import numpy as np

from ..sources.parsers import Node, write_newick

Nested = str | tuple  # a tip's name, or a tuple of subtrees


def neighbour_joining(names: list[str], distances: np.ndarray) -> Node:
    """Q-criterion agglomeration, ties by name; ends in a node of three branches (or two)."""
    nodes = [Node(n) for n in names]
    keys = list(names)
    d = distances.astype(float).copy()
    while len(nodes) > 3:
        n = len(nodes)
        r = d.sum(1)
        q = (n - 2) * d - r[:, None] - r[None, :]
        best = min(((q[i, j], keys[i], keys[j], i, j) for i in range(n) for j in range(i + 1, n)), key=lambda x: (round(x[0], 12), min(x[1], x[2]), max(x[1], x[2])))
        i, j = best[3], best[4]
        li = d[i, j] / 2 + (r[i] - r[j]) / (2 * (n - 2))
        nodes[i].length, nodes[j].length = max(0.0, li), max(0.0, d[i, j] - li)
        joined = Node(children=[nodes[i], nodes[j]])
        new = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(n) if k not in (i, j)]
        d = np.block([[d[np.ix_(keep, keep)], new[keep][:, None]], [new[keep][None, :], np.zeros((1, 1))]])
        key = min(keys[i], keys[j])
        nodes, keys = [nodes[k] for k in keep] + [joined], [keys[k] for k in keep] + [key]
    if len(nodes) == 3:
        for i, j, k in ((0, 1, 2), (1, 0, 2), (2, 0, 1)):
            nodes[i].length = max(0.0, (d[i, j] + d[i, k] - d[j, k]) / 2)
    elif len(nodes) == 2:
        nodes[0].length = nodes[1].length = d[0, 1] / 2
    return Node(children=nodes) if len(nodes) > 1 else nodes[0]


def jc_distances(sequences: list[str]) -> np.ndarray:
    m = np.array([["ACGT".find(c) for c in s] for s in sequences])
    n = len(m)
    d = np.zeros((n, n))
    for i in range(n):
        for j in range(i):
            ok = (m[i] >= 0) & (m[j] >= 0)
            p = min(0.74, (m[i][ok] != m[j][ok]).mean()) if ok.any() else None
            d[i, j] = d[j, i] = 1.0 if p is None else -0.75 * np.log(1 - 4 * p / 3)
    return d


def nj_tree(names: list[str], sequences: list[str]) -> Node:
    return neighbour_joining(names, jc_distances(sequences))


def seed_trees(names: list[str], sequences: list[str], least: int = 60, levels: int = 3) -> list[Node]:
    """Trees of the whole alignment and of halving, half-overlapping windows, one for each topology."""
    sites = len(sequences[0])
    found: dict[str, Node] = {}
    for level in range(levels):
        width = sites >> level
        if width < least and level:
            break
        for start in range(0, sites - width + 1, max(1, width // 2)):
            tree = nj_tree(names, [s[start : start + width] for s in sequences])
            found.setdefault(signature(nested(tree)), tree)
    return list(found.values())


def nested(node: Node) -> Nested:
    return node.name if not node.children else tuple(nested(c) for c in node.children)


def tips(tree: Nested) -> frozenset[str]:
    return frozenset([tree]) if isinstance(tree, str) else frozenset().union(*map(tips, tree))


def canonical(tree: Nested) -> Nested:
    """Children in order of their texts; nodes of one child taken out."""
    if isinstance(tree, str):
        return tree
    kids = tuple(sorted(map(canonical, tree), key=str))
    return kids[0] if len(kids) == 1 else kids


def rooted_signature(tree: Nested) -> str:
    return str(canonical(tree))


def splits(tree: Nested) -> frozenset[frozenset[str]]:
    """Smaller sides of the non-trivial bipartitions; of equal sides the one with the first tip."""
    every = tips(tree)
    first, found = min(every), set()

    def walk(t: Nested) -> frozenset[str]:
        if isinstance(t, str):
            return frozenset([t])
        below = frozenset().union(*map(walk, t))
        if 2 <= len(below) <= len(every) - 2:
            other = every - below
            side = below if (len(below), first not in below) < (len(other), first not in other) else other
            found.add(side)
        return below

    walk(tree)
    return frozenset(found)


def signature(tree: Nested) -> str:
    return ";".join(sorted(",".join(sorted(s)) for s in splits(tree)))


def rf(a: Nested, b: Nested) -> int:
    return len(splits(a) ^ splits(b))


def clades(tree: Nested) -> frozenset[frozenset[str]]:
    if isinstance(tree, str):
        return frozenset()
    return frozenset([tips(tree)]).union(*map(clades, tree))


def clade_distance(a: Nested, b: Nested) -> int:
    return len(clades(a) ^ clades(b))


def rootings(tree: Nested) -> list[Nested]:
    """All placements of the root on the branches of an unrooted tree."""
    found: dict[str, Nested] = {}

    def walk(t: Nested, rest: tuple) -> None:
        if rest:
            up = rest[0] if len(rest) == 1 else rest
            r = canonical((t, up))
            found.setdefault(str(r), r)
        if not isinstance(t, str):
            for k, child in enumerate(t):
                walk(child, tuple(x for i, x in enumerate(t) if i != k) + ((rest[0] if len(rest) == 1 else rest,) if rest else ()))

    walk(tree, ())
    return list(found.values())


def prune_subtree(tree: Nested, moved: frozenset[str]) -> Nested | None:
    if isinstance(tree, str):
        return None if tree in moved else tree
    kids = [k for k in (prune_subtree(c, moved) for c in tree) if k is not None]
    return None if not kids else kids[0] if len(kids) == 1 else tuple(kids)


def find_clade(tree: Nested, members: frozenset[str]) -> Nested | None:
    if tips(tree) == members:
        return tree
    if isinstance(tree, str):
        return None
    return next((f for c in tree if members <= tips(c) and (f := find_clade(c, members)) is not None), None)


def graft(tree: Nested, target: frozenset[str], piece: Nested) -> Nested:
    if tips(tree) == target:
        return (tree, piece)
    if isinstance(tree, str):
        return tree
    return tuple(graft(c, target, piece) for c in tree)


def spr_apply(tree: Nested, moved: frozenset[str], target: frozenset[str]) -> Nested:
    """The clade ``moved`` taken off and put onto the branch above the clade ``target`` of what is left."""
    piece = find_clade(tree, moved)
    rest = prune_subtree(tree, moved)
    if piece is None or rest is None or find_clade(rest, target) is None:
        raise ValueError("the move names no clade of the tree")
    return canonical(graft(rest, target, piece))


def spr_moves(tree: Nested):
    """(moved, target, result) of every rooted move to another tree, each result once."""
    here = rooted_signature(tree)
    seen = {here}
    every = tips(tree)
    for moved in sorted([frozenset([t]) for t in every] + [c for c in clades(tree) if c != every], key=lambda c: (len(c), sorted(c))):
        rest = prune_subtree(tree, moved)
        if rest is None:
            continue
        for target in sorted([frozenset([t]) for t in tips(rest)] + list(clades(rest)), key=lambda c: (len(c), sorted(c))):
            after = spr_apply(tree, moved, target)
            if (s := rooted_signature(after)) not in seen:
                seen.add(s)
                yield moved, target, after


def spr_invert(tree: Nested, moved: frozenset[str]) -> tuple[frozenset[str], frozenset[str]]:
    """The move that puts a clade back where it is in ``tree``."""

    def sibling(t: Nested) -> Nested | None:
        if isinstance(t, str):
            return None
        for k, c in enumerate(t):
            if tips(c) == moved:
                rest = tuple(x for i, x in enumerate(t) if i != k)
                return rest[0] if len(rest) == 1 else rest
        return next((f for c in t if (f := sibling(c)) is not None), None)

    return moved, tips(sibling(tree))


def unrooted_neighbours(tree: Nested) -> list[Nested]:
    """One tree for each topology one unrooted move away."""
    found = {signature(tree): None}
    for root in rootings(tree):
        for _, _, after in spr_moves(root):
            found.setdefault(signature(after), after)
    return [t for t in found.values() if t is not None]


def fitch(tree: Nested, masks: dict[str, np.ndarray]) -> np.ndarray:
    """Parsimony cost of each site; a missing mask (0) allows all bases."""
    cost = 0

    def walk(t: Nested) -> np.ndarray:
        nonlocal cost
        if isinstance(t, str):
            return np.where(masks[t] == 0, 15, masks[t])
        at = walk(t[0])
        for c in t[1:]:
            m = walk(c)
            both = at & m
            cost = cost + (both == 0).astype(int)
            at = np.where(both == 0, at | m, both)
        return at

    walk(tree)
    return np.asarray(cost) * np.ones(len(next(iter(masks.values()))), int)


def spr_path(start: Nested, goal: Nested, most: int = 3, width: int = 64) -> list[Nested] | None:
    """A short chain of rooted moves from one tree to another: a beam by clade distance, to so many moves."""
    goal_sig, front = rooted_signature(goal), [[canonical(start)]]
    if rooted_signature(start) == goal_sig:
        return front[0]
    for _ in range(most):
        step: dict[str, list[Nested]] = {}
        for path in front:
            for _, _, after in spr_moves(path[-1]):
                step.setdefault(rooted_signature(after), [*path, after])
        if goal_sig in step:
            return step[goal_sig]
        front = sorted(step.values(), key=lambda p: (clade_distance(p[-1], goal), rooted_signature(p[-1])))[:width]
    return None


def search_parsimony(start: Nested, masks: dict[str, np.ndarray], most: int = 20) -> tuple[Nested, int]:
    """Steepest descent over SPR neighbours."""
    at, cost = canonical(start), int(fitch(start, masks).sum())
    for _ in range(most):
        best = min(((int(fitch(t, masks).sum()), rooted_signature(t), t) for _, _, t in spr_moves(at)), default=None, key=lambda x: x[:2])
        if best is None or best[0] >= cost:
            break
        cost, at = best[0], best[2]
    return at, cost


def display(parents: dict[str, tuple[str, str | None]], root: str, mask: int, reticulations: list[str]) -> Nested:
    """The tree that a network shows for a mask: bit k takes the second parent of reticulation k."""
    children: dict[str, list[str]] = {}
    for child, (first, second) in sorted(parents.items()):
        k = reticulations.index(child) if child in reticulations else -1
        parent = second if k >= 0 and mask >> k & 1 and second is not None else first
        children.setdefault(parent, []).append(child)

    def walk(n: str) -> Nested | None:
        if n not in children:
            return n if not n.startswith("#") else None
        kids = [w for c in children[n] if (w := walk(c)) is not None]
        return None if not kids else kids[0] if len(kids) == 1 else tuple(kids)

    return canonical(walk(root))


def network_hash(parents: dict[str, tuple[str, str | None]]) -> str:
    return hashlib.sha256(repr(sorted(parents.items())).encode()).hexdigest()


def temporally_feasible(parents: dict[str, tuple[str, str | None]]) -> bool:
    """Both parents of a reticulation live at one time: contract them, then the rest must be acyclic."""
    group: dict[str, str] = {}

    def find(x: str) -> str:
        while group.get(x, x) != x:
            x = group[x]
        return x

    for first, second in parents.values():
        if second is not None:
            group[find(first)] = find(second)
    after: dict[str, set[str]] = {}
    degree: dict[str, int] = {}
    for child, both in parents.items():
        for p in both:
            if p is None:
                continue
            a, b = find(p), find(child)
            if a == b:
                return False
            if b not in after.setdefault(a, set()):
                after[a].add(b)
                degree[b] = degree.get(b, 0) + 1
    todo = deque(sorted(set(map(find, parents)) | set(after) - set(degree)))
    todo = deque(x for x in todo if not degree.get(x))
    seen = 0
    while todo:
        x = todo.popleft()
        seen += 1
        for y in after.get(x, ()):
            degree[y] -= 1
            if not degree[y]:
                todo.append(y)
    return seen == len({find(x) for x in itertools.chain(parents, (p for both in parents.values() for p in both if p is not None))})


def to_node(tree: Nested, length: float | None = None) -> Node:
    return Node(tree, length) if isinstance(tree, str) else Node("", length, None, [to_node(c, length) for c in tree])


def unit_newick(tree: Nested) -> str:
    return write_newick(to_node(tree), lengths=False)
