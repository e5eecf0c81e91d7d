"""Trees as node relations (node_id, parent_id, name, length, depth) and graphs as edge relations.

Trees are shallow against their size, so walks over them are loops over depth in the driver, each a
join of one level; paths of ancestors are arrays. Nothing of a tree reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chains import kept


def depth_of(tree: DataFrame) -> int:
    return int(tree.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0])


def ancestors(tree: DataFrame, levels: int | None = None) -> DataFrame:
    """node_id, path (node ids from the root down to it), distance (sum of lengths on it)."""
    levels = depth_of(tree) if levels is None else levels
    at = tree.filter("parent_id IS NULL").select("node_id", F.array("node_id").alias("path"), F.lit(0.0).alias("distance"))
    found = at
    for _ in range(levels):
        child = tree.alias("c").join(at.alias("p"), F.col("c.parent_id") == F.col("p.node_id"))
        at = child.select("c.node_id", F.concat("p.path", F.array("c.node_id")).alias("path"), (F.col("p.distance") + F.col("c.length")).alias("distance"))
        found = found.unionByName(at)
    return found


def order(tree: DataFrame) -> DataFrame:
    """node_id, pre, post: places in both traversals, children by node_id, by comparing padded paths."""
    key = F.array_join(F.transform("path", lambda x: F.lpad(x.cast("string"), 10, "0")), "/")
    paths = ancestors(tree).withColumn("key", key)
    pre = F.row_number().over(Window.orderBy("key"))
    sized = paths.select("node_id", "key", F.size("path").alias("level"), pre.alias("pre"))
    below = ancestors(tree).select(F.explode("path").alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    # every node before it in preorder, less its ancestors, plus all below it
    joined = sized.join(below, "node_id")
    return joined.select("node_id", "pre", (F.col("pre") - F.col("level") + F.col("n")).cast("int").alias("post"))


def tip_counts(tree: DataFrame) -> DataFrame:
    """node_id, tips below it, itself included if it is one."""
    tips = tree.join(tree.select(F.col("parent_id").alias("node_id")).distinct(), "node_id", "left_anti").select("node_id")
    paths = ancestors(tree).join(tips, "node_id").select(F.explode("path").alias("node_id"))
    return paths.groupBy("node_id").agg(F.count(F.lit(1)).alias("tips"))


def leaf_sets(tree: DataFrame) -> DataFrame:
    """node_id, tips: sorted names of the tips below each inner node."""
    tips = tree.join(tree.select(F.col("parent_id").alias("node_id")).distinct(), "node_id", "left_anti").select("node_id", "name")
    paths = ancestors(tree).join(tips, "node_id").select(F.explode("path").alias("above"), "node_id", "name").filter("above <> node_id")
    return paths.groupBy(F.col("above").alias("node_id")).agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("tips"))


def patristic(tree: DataFrame, tips: DataFrame) -> DataFrame:
    """a, b, distance of pairs of given tips: root distances less twice that of the last common ancestor."""
    paths = ancestors(tree)
    of = {r: paths.select(F.col("node_id").alias(r), F.col("path").alias(f"{r}_path"), F.col("distance").alias(f"{r}_d")) for r in "ab"}
    chosen = tips.select("node_id")
    pairs = of["a"].join(chosen.withColumnRenamed("node_id", "a"), "a").join(of["b"].join(chosen.withColumnRenamed("node_id", "b"), "b"), F.col("a") < F.col("b"))
    last = pairs.withColumn("lca", F.element_at(F.array_intersect("a_path", "b_path"), -1))
    return last.join(F.broadcast(paths.select(F.col("node_id").alias("lca"), F.col("distance").alias("l_d"))), "lca").select("a", "b", (F.col("a_d") + F.col("b_d") - 2 * F.col("l_d")).alias("distance"))


def prune_to(tree: DataFrame, tips: DataFrame) -> DataFrame:
    """node_id, parent_id, length of the tree of given tips: their ancestors, with nodes of one child taken out and lengths summed."""
    paths = ancestors(tree)
    keep = paths.join(tips.select("node_id"), "node_id")
    used = keep.select(F.explode("path").alias("node_id")).distinct()
    kids = tree.join(used, "node_id").groupBy(F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("kids")).filter("node_id IS NOT NULL")
    stay = used.join(kids, "node_id", "left").filter("kids IS NULL OR kids > 1").select("node_id")
    steps = paths.join(stay, "node_id").select("node_id", "distance", F.posexplode("path").alias("at", "above")).filter("above <> node_id")
    parents = steps.join(stay.withColumnRenamed("node_id", "above"), "above").groupBy("node_id", "distance").agg(F.max_by("above", "at").alias("parent_id"))
    up = parents.join(paths.select(F.col("node_id").alias("parent_id"), F.col("distance").alias("d")), "parent_id")
    inner = up.select("node_id", "parent_id", (F.col("distance") - F.col("d")).alias("length"))
    top = stay.join(inner.select("node_id"), "node_id", "left_anti").select("node_id", F.lit(None).cast("int").alias("parent_id"), F.lit(0.0).alias("length"))
    return top.unionByName(inner)


def newick(tree: DataFrame, lengths: bool = True) -> DataFrame:
    """One row: the Newick text, folded bottom-up by depth, children by name."""
    quoted = F.concat(F.lit("'"), F.replace("name", F.lit("'"), F.lit("''")), F.lit("'"))
    tail = F.concat(F.lit(":"), F.col("length").cast("string")) if lengths else F.lit("")
    levels = depth_of(tree)
    at = None
    for depth in range(levels, -1, -1):
        level = tree.filter(F.col("depth") == depth)
        if at is None:
            level = level.withColumn("text", F.lit(""))
        else:
            inner = at.groupBy(F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "text"))), lambda x: x["text"]), ",").alias("t"))
            level = level.join(inner, "node_id", "left").withColumn("text", F.when(F.col("t").isNotNull(), F.concat(F.lit("("), "t", F.lit(")"))).otherwise("")).drop("t")
        at = level.withColumn("text", F.concat("text", quoted, F.when(F.col("depth") > 0, tail).otherwise("")))
    return at.select(F.concat("text", F.lit(";")).alias("newick"))


def fitch(tree: DataFrame, tips: DataFrame, levels: int | None = None) -> DataFrame:
    """site, cost: parsimony cost of (node_id, site, mask) on a tree of any shape, folded by depth.

    An inner node keeps the bases that most of its children allow; each child that lacks them costs one.
    On binary nodes that is the intersection, or else the union at a cost of one.
    """
    levels = depth_of(tree) if levels is None else levels
    at = tree.select("node_id", "parent_id", "depth").join(tips, "node_id").select("parent_id", "depth", "site", "mask", F.lit(0).cast("long").alias("cost"))
    for depth in range(levels, 0, -1):
        here, rest = at.filter(F.col("depth") == depth), at.filter(F.col("depth") < depth)
        n = [F.sum(F.expr(f"(mask >> {b}) & 1")).alias(f"n{b}") for b in range(4)]
        folded = here.groupBy("parent_id", "site").agg(*n, F.count(F.lit(1)).alias("kids"), F.sum("cost").alias("cost"))
        top = F.greatest(*[F.col(f"n{b}") for b in range(4)])
        mask = sum((F.when(F.col(f"n{b}") == top, 1 << b).otherwise(0) for b in range(1, 4)), F.when(F.col("n0") == top, 1).otherwise(0))
        up = folded.select(F.col("parent_id").alias("node_id"), "site", mask.alias("mask"), (F.col("cost") + F.col("kids") - top).alias("cost"))
        at = rest.unionByName(tree.select("node_id", "parent_id", "depth").join(up, "node_id").select("parent_id", "depth", "site", "mask", "cost"))
    return at.groupBy("site").agg(F.sum("cost").alias("cost"))


def sankoff(tree: DataFrame, tips: DataFrame, transition: float, transversion: float, levels: int | None = None) -> DataFrame:
    """site, cost with unequal costs: min-plus over four states, folded by depth."""
    levels = depth_of(tree) if levels is None else levels
    big = 1e6
    own = [F.when(F.expr(f"(mask >> {b}) & 1") == 1, F.lit(0.0)).otherwise(F.lit(big)).alias(f"c{b}") for b in range(4)]
    at = tree.select("node_id", "parent_id", "depth").join(tips, "node_id").select("parent_id", "depth", "site", *own)
    price = lambda a, b: 0.0 if a == b else transition if (a + b) % 2 == 0 else transversion
    for depth in range(levels, 0, -1):
        here, rest = at.filter(F.col("depth") == depth), at.filter(F.col("depth") < depth)
        step = [F.sum(F.least(*[F.col(f"c{b}") + price(a, b) for b in range(4)])).alias(f"c{a}") for a in range(4)]
        folded = here.groupBy(F.col("parent_id").alias("node_id"), "site").agg(*step)
        at = rest.unionByName(tree.select("node_id", "parent_id", "depth").join(folded, "node_id").select("parent_id", "depth", "site", "c0", "c1", "c2", "c3"))
    return at.select("site", F.least("c0", "c1", "c2", "c3").alias("cost"))


def bfs(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """source, node, level: least number of steps from each start within ``most``, by expanding a frontier that is deduplicated at each step."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = start.select(F.col("node").alias("source"), "node", F.lit(0).alias("level"))
    at = seen
    for level in range(1, most + 1):
        step = at.join(both, at["node"] == both["a"]).select("source", F.col("b").alias("node")).distinct()
        at = kept(step.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("level", F.lit(level)))
        if at.isEmpty():
            break
        seen = seen.unionByName(at)
    return seen


def shortest_path(edges: DataFrame, start: int, goal: int, most: int) -> DataFrame:
    """path, alternatives: the first shortest path in order of nodes, and how many there are."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    at = edges.sparkSession.range(1).select(F.lit(start).alias("node"), F.array(F.lit(start)).alias("path"), F.lit(1).cast("long").alias("ways"))
    found = at.filter(F.col("node") == goal)
    for _ in range(most):
        step = at.join(both, at["node"] == both["a"]).filter(~F.array_contains("path", F.col("b")))
        # all paths to a node at one level are equally long: keep the first and count them
        at = step.select(F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"), "ways").groupBy("node").agg(F.min("path").alias("path"), F.sum("ways").alias("ways"))
        found = found.unionByName(at.filter(F.col("node") == goal))
    best = found.withColumn("n", F.size("path"))
    return best.orderBy("n").limit(1).select("path", F.col("ways").alias("alternatives"))


def medoid(distances: DataFrame, weight: DataFrame) -> DataFrame:
    """The node with the least sum of sqrt(occupancy) times distance to all others: node, total."""
    cost = distances.join(weight, distances["node"] == weight["state"]).groupBy("source").agg(F.sum(F.sqrt("occupancy") * F.col("level")).alias("total"))
    return cost.orderBy("total", "source").limit(1).select(F.col("source").alias("node"), "total")


def crossings(ranks: DataFrame) -> DataFrame:
    """Tip crossings of two orders (tip, r1, r2): pairs that the orders disagree on."""
    a, b = ranks.alias("a"), ranks.alias("b")
    n = a.join(b, (F.col("a.r1") < F.col("b.r1")) & (F.col("a.r2") > F.col("b.r2")))
    return n.agg(F.count(F.lit(1)).alias("crossings"))


def path_lengths(edges: DataFrame, lengths: DataFrame) -> DataFrame:
    """branch, length: sums of atomic lengths over each branch's list of atomic edges."""
    return edges.select("branch", F.explode("atoms").alias("atom")).join(F.broadcast(lengths), "atom").groupBy("branch").agg(F.sum("length").alias("length"))


def duplicate_columns(members: DataFrame) -> DataFrame:
    """signature, atoms of atomic edges that are in the same branches, if more than one."""
    sig = members.select("branch", F.explode("atoms").alias("atom")).groupBy("atom").agg(F.array_join(F.sort_array(F.collect_set(F.col("branch").cast("string"))), ",").alias("signature"))
    return sig.groupBy("signature").agg(F.sort_array(F.collect_list("atom")).alias("atoms")).filter("size(atoms) > 1")
