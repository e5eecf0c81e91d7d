"""Hidden Markov chains of any length: a parallel scan over blocks of sites.

Every block of sites is folded to one states x states matrix. Matrices are combined level by level,
``fan`` at a time, to one for each chain; on the way down each block gets the vectors that enter it
from both sides, and all blocks are decoded at once. Best paths need one more way up and down, for the
state that each block is left in. A task steps the blocks of a batch side by side, in parts of bounded size,
so numpy works on arrays of many blocks and Python's own work is a loop over the sites of one block.

The tables of a level are checkpointed into the shared folder, so a lost executor costs one level.
"""

from __future__ import annotations

import copy
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import scan

#: (log initial, log transition) of a chain.
Model = tuple[np.ndarray, np.ndarray]
_PRODUCTS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"plus": scan.plus, "most": scan.most}
_STEPS: dict[str, scan.Step] = {"plus": scan.sum_step, "most": scan.best_step}
#: Numbers that a part of a batch holds: bounds the arrays in memory.
_PART = 1 << 19


def kept(df: DataFrame) -> DataFrame:
    """Written into the shared checkpoint folder; into one of our own only on one machine that names none (tests)."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="treeline-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def spread(df: DataFrame, rows: int, each: int = 256) -> DataFrame:
    """Rows that hold blocks, dealt to tasks: at least one for each core, and no more than about ``each`` to a task, whatever their bytes."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def reset_model(weights: np.ndarray, q: float) -> Model:
    """The chain that stays with probability 1 - q and else draws its state by weight."""
    w = np.asarray(weights, float)
    with np.errstate(divide="ignore"):
        return np.log(w), np.log((1 - q) * np.eye(len(w)) + q * w[None, :])


def switch_model(states: int, price: float) -> Model:
    """Scores of a path that pays a price for each change of state."""
    return np.zeros(states), np.where(np.eye(states, dtype=bool), 0.0, -price)


def _rows(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``fn`` on each batch of rows, which hold blocks or the children of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all rows' lists, one after the other; length of each list). Null numbers are -inf."""
    column = batch.column(name)
    flat = column.flatten()
    if isinstance(flat, pa.ListArray):
        flat = flat.flatten()
    if flat.null_count:
        flat = flat.fill_null(float("-inf"))
    return flat.to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


def _lists(x: np.ndarray) -> pa.ListArray:
    """Rows of [n, ...] as lists."""
    width = int(np.prod(x.shape[1:]))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(x).ravel()))


def _parts(batch: pa.RecordBatch, column: str, each: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(model, rows of it): the rows with the longest lists first, in parts of bounded size, of which a row takes ``each`` numbers besides its list."""
    models, lengths = batch.column("_model").to_numpy(), batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for model in np.unique(models):
        rows = np.flatnonzero(models == model)
        rows = rows[np.argsort(-lengths[rows], kind="stable")]
        group = np.cumsum(lengths[rows] + each, dtype=np.int64) // _PART
        for part in np.split(rows, np.flatnonzero(np.diff(group)) + 1):
            yield int(model), batch.take(pa.array(part))


def _vectors(rows: pa.RecordBatch, name: str) -> np.ndarray:
    """A vector of each row."""
    return _flat(rows, name)[0].reshape(rows.num_rows, -1)


@dataclass
class _Laid:
    """Blocks side by side: their rows (the longest block first), sites, values of the sites and where a chain begins."""

    rows: pa.RecordBatch
    side: scan.Side
    sites: np.ndarray
    values: np.ndarray
    first: np.ndarray
    emitted: np.ndarray | None = None


class Chains:
    """Scores of states at the sites of many chains, cut into blocks.

    rows: ``keys``, site (whole numbers), state (0 to k - 1), value (log emission). A missing or null cell is an
    impossible state; a site without rows is not of the chain. With ``values``, the name of a column of arrays, a row is
    a whole site: its log emissions by state, or numbers from which ``emit`` makes them for many sites at once, [site, number] to [site, state].
    ``model`` names the column that says which of ``models`` a chain follows, the only one if there is none. With ``members``
    every chain is one of each model, over the states that are the model's members; they share their blocks. No rows give empty results.
    """

    def __init__(self, rows: DataFrame, keys: list[str], models: dict[int, Model], model: str | None = None, site: str = "site", state: str = "state", value: str = "value", block: int = 512, fan: int = 32, members: dict[int, tuple[int, ...]] | None = None, values: str | None = None, emit: Callable[[np.ndarray], np.ndarray] | None = None):
        self.keys, self.models, self.fan, self.members, self.wide, self.emit = [*keys, "_model"], models, fan, members, values is not None, emit
        which = F.col(model) if model else F.lit(next(iter(models)))
        own = [*keys, which.cast("int").alias("_model"), F.col(site).cast("long").alias("_site")]
        if self.wide:
            cells, parts = rows.select(*own, F.col(values).alias("_value")), {"_sites": "_site", "_values": "_value"}
        else:
            cells, parts = rows.select(*own, F.col(state).cast("int").alias("_state"), F.col(value).cast("double").alias("_value")), {"_sites": "_site", "_states": "_state", "_values": "_value"}
        # blocks begin at multiples of the block, so that rows are read once; they are numbered from their chain's first below
        tasks = max(3 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        cells = cells.withColumn("_idx", F.floor(F.col("_site") / block)).repartition(tasks, *self.keys, "_idx")  # not merged: blocks are small, their work is not
        packed = cells.groupBy(*self.keys, "_idx").agg(F.collect_list(F.struct(*parts.values())).alias("c"))
        packed = kept(packed.select(*self.keys, "_idx", *[(F.flatten(f"c.{x}") if self.wide and name == "_values" else F.col(f"c.{x}")).alias(name) for name, x in parts.items()]))
        low = packed.groupBy(*self.keys).agg(F.min("_idx").alias("_low"), F.max("_idx").alias("_high"))
        if keys:
            low = kept(low)
            self.blocks = packed.join(low.drop("_high"), self.keys).withColumn("_idx", F.col("_idx") - F.col("_low")).drop("_low")
            last = low.agg(F.max(F.col("_high") - F.col("_low"))).first()[0] or 0
        else:
            found = low.collect()  # a row for each model
            lows = F.coalesce(*[F.when(F.col("_model") == r["_model"], F.lit(r["_low"])) for r in found], F.lit(0))
            self.blocks = packed.withColumn("_idx", F.col("_idx") - lows)
            last = max((r["_high"] - r["_low"] for r in found), default=0)
        self.depth = 1
        while fan**self.depth <= last:
            self.depth += 1
        types = {f.name: f for f in self.blocks.schema.fields}
        self.key_fields = [types[k] for k in self.keys]

    def again(self, models: dict[int, Model], members: dict[int, tuple[int, ...]] | None = None, emit: Callable[[np.ndarray], np.ndarray] | None = None) -> Chains:
        """The same blocks under other models, which keep the numbers of these unless there are members."""
        other = copy.copy(self)
        other.models, other.members, other.emit = models, members, emit or self.emit
        return other

    def _schema(self, ddl: str) -> T.StructType:
        return T.StructType([*self.key_fields, *T.StructType.fromDDL(ddl).fields])

    def _each(self) -> int:
        """Numbers that stepping a block's matrix takes."""
        return max(len(m[0]) for m in self.models.values()) ** 3

    def _keyed(self) -> Callable[..., pa.RecordBatch]:
        keys = self.keys

        def keyed(rows: pa.RecordBatch, columns: list[pa.Array], at: np.ndarray | None = None, model: int | None = None) -> pa.RecordBatch:
            """The rows' keys, each taken as ``at`` says, beside the columns."""
            own = {k: rows.column(k) if at is None else rows.column(k).take(pa.array(at)) for k in keys}
            if model is not None:
                own["_model"] = pa.array(np.full(rows.num_rows, model, np.int32))
            return pa.RecordBatch.from_arrays([*own.values(), *columns], names=[str(k) for k in range(len(own) + len(columns))])

        return keyed

    def _named(self, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], df: DataFrame, ddl: str) -> DataFrame:
        schema = self._schema(ddl)
        names = schema.names
        return _rows(df, lambda batch: (x.rename_columns(names) for x in fn(batch)), schema)

    def _lay(self) -> Callable[[pa.RecordBatch], _Laid]:
        wide = self.wide

        def lay(rows: pa.RecordBatch) -> _Laid:
            sites, counts = _flat(rows, "_sites")
            values, _ = _flat(rows, "_values")
            block = np.repeat(np.arange(rows.num_rows), counts)
            if wide:
                order = np.lexsort((sites, block))
                sites, values = sites[order], values.reshape(len(sites), -1)[order]
            else:
                states, _ = _flat(rows, "_states")
                order = np.lexsort((values, states, sites, block))
                sites, block, states, values = sites[order], block[order], states[order], values[order]
                new = np.concatenate([[True], (sites[1:] != sites[:-1]) | (block[1:] != block[:-1])])
                cells = np.full((int(new.sum()), int(states.max()) + 1), -np.inf)
                cells[np.cumsum(new) - 1, states] = values
                sites, block, values = sites[new], block[new], cells
                counts = np.bincount(block, minlength=rows.num_rows)
            order = np.argsort(-counts, kind="stable")
            if (order[1:] < order[:-1]).any():
                at = np.argsort(np.argsort(order)[block], kind="stable")
                rows, counts, sites, values = rows.take(pa.array(order)), counts[order], sites[at], values[at]
            return _Laid(rows, scan.Side(counts), sites, values, rows.column("_idx").to_numpy() == 0)

        return lay

    def _emission(self) -> Callable[[_Laid, int], np.ndarray]:
        """[site, block, state] of a model."""
        models, members, emit = self.models, self.members, self.emit

        def emission(laid: _Laid, model: int) -> np.ndarray:
            if laid.emitted is None:  # once for all models
                laid.emitted = emit(laid.values) if emit else laid.values
            values = laid.emitted
            k = len(models[model][0]) if members is None else 1 + max(members[model])
            if values.shape[1] < k:  # states that no cell of these blocks names
                values = np.concatenate([values, np.full((len(values), k - values.shape[1]), -np.inf)], 1)
            elif values.shape[1] > k and members is None:
                raise ValueError("a state is not of the model")
            return laid.side.lay(values if members is None else values[:, list(members[model])], -np.inf)

        return emission

    def _up(self, nodes: DataFrame, payload: list[str], merge: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], ddl: str) -> list[DataFrame]:
        """The children of each node, from the parents of the blocks to the top."""
        levels, keys = [], self.keys
        for level in range(self.depth):
            kids = nodes.groupBy(*keys, F.floor(F.col("_idx") / self.fan).alias("_idx")).agg(F.sort_array(F.collect_list(F.struct(F.col("_idx").alias("i"), *payload))).alias("c"))
            levels.append(kept(kids.select(*keys, "_idx", F.col("c.i").alias("_child"), *[F.col(f"c.{p}").alias(p) for p in payload])))
            if level + 1 < self.depth:
                nodes = self._named(merge, levels[-1], f"_idx long, {ddl}")
        return levels

    def _down(self, levels: list[DataFrame], hand: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
        """What reaches each block: ``hand`` gives what the children of a node get, from what it got (nothing at the top)."""
        got = self._named(hand, levels[-1], f"_idx long, {ddl}")
        for level in reversed(levels[:-1]):
            got = self._named(hand, level.join(got, [*self.keys, "_idx"]), f"_idx long, {ddl}")
        return got

    def _matrices(self, products: tuple[str, ...]) -> Callable[[pa.RecordBatch], Iterator[tuple[pa.RecordBatch, scan.Side, np.ndarray]]]:
        """(nodes, where their children lie, [child, product, node, k, k]) for the parts of a batch; what a node lacks is a matrix that changes nothing."""
        models, each, fan = self.models, self._each(), self.fan

        def matrices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, scan.Side, np.ndarray]]:
            for model, rows in _parts(batch, "_child", each * fan * len(products)):
                k = len(models[model][0])
                side = scan.Side(rows.column("_child").value_lengths().to_numpy(zero_copy_only=False))
                nothing = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)
                yield rows, side, side.lay(_flat(rows, "_m")[0].reshape(-1, len(products), k, k), nothing)

        return matrices

    def folded(self, products: tuple[str, ...] = ("plus", "most")) -> list[DataFrame]:
        """Children of each node with their matrices: ``_m`` has those of all products, flat."""
        lay, emission, matrices, keyed, models, each = self._lay(), self._emission(), self._matrices(products), self._keyed(), self.models, self._each()
        members = self.members

        def fold(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for own, rows in _parts(batch, "_sites", each):
                laid = lay(rows)
                for model in [own] if members is None else members:
                    e = emission(laid, model)
                    found = [scan.fold_blocks(laid.side, e, *models[model], laid.first, _STEPS[p]) for p in products]
                    yield keyed(laid.rows, [laid.rows.column("_idx"), _lists(np.stack(found, 1))], model=model)

        def merge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for rows, _, every in matrices(batch):
                yield keyed(rows, [rows.column("_idx"), _lists(np.stack([scan.fold(every[:, :, p], _PRODUCTS[product]) for p, product in enumerate(products)], 1))])

        return self._up(self._named(fold, self.blocks, "_idx long, _m array<double>"), ["_m"], merge, "_m array<double>")

    def totals(self, product: str = "plus") -> DataFrame:
        """keys, total of each chain: the log likelihood of all paths (plus) or the score of the best (most)."""
        matrices, keyed = self._matrices((product,)), self._keyed()

        def total(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for rows, _, every in matrices(batch):
                whole = scan.fold(every[:, :, 0], _PRODUCTS[product])[:, 0]
                yield keyed(rows, [pa.array(scan.log_sum(whole, 1) if product == "plus" else whole.max(1))])

        return self._named(total, self.folded((product,))[-1], "total double")

    def _entering(self, products: tuple[str, ...]) -> DataFrame:
        """keys, _idx and, of each block, by product: _before (forward), _after (backward), _total; _best (best scores so far), _rest (best scores to come)."""
        matrices, keyed = self._matrices(products), self._keyed()
        names = {"plus": ("_before", "_after"), "most": ("_best", "_rest")}

        def hand(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for rows, side, every in matrices(batch):
                columns = [pa.array(_flat(rows, "_child")[0])]
                for p, product in enumerate(products):
                    m, shape = every[:, :, p], every.shape[:2] + every.shape[-1:]
                    join = scan.log_sum if product == "plus" else np.max
                    top = names[product][0] not in batch.schema.names
                    before, after = (scan.enter(*shape[1:]), np.zeros(shape[1:])) if top else (_flat(rows, c)[0].reshape(shape[1:]).copy() for c in names[product])
                    got = np.empty(shape), np.empty(shape)
                    for c in range(len(m)):
                        got[0][c] = before
                        before = join(before[:, :, None] + m[c], 1)
                    for c in range(len(m) - 1, -1, -1):
                        got[1][c] = after
                        after = join(m[c] + after[:, None, :], 2)
                    columns += [_lists(side.flat(x)) for x in got]
                    if product == "plus":
                        total = scan.log_sum(before, 1) if top else rows.column("_total").to_numpy()
                        columns.append(pa.array(total[side.block]))
                yield keyed(rows, columns, side.block)

        ddl = {"plus": "_before array<double>, _after array<double>, _total double", "most": "_best array<double>, _rest array<double>"}
        return self._down(self.folded(products), hand, ", ".join(ddl[p] for p in products))

    def _entered(self, products: tuple[str, ...]) -> DataFrame:
        """Blocks with what enters them; one row for each model that a block is of."""
        found = self._entering(products)
        if self.members is None:
            return self.blocks.join(found, [*self.keys, "_idx"])
        return self.blocks.drop("_model").join(found, [*self.keys[:-1], "_idx"])

    def _ends(self, entered: DataFrame) -> DataFrame:
        """keys, _idx, _end: the state in which the best path leaves each block."""
        lay, emission, keyed, models, each, fan = self._lay(), self._emission(), self._keyed(), self.models, self._each(), self.fan

        def steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for model, rows in _parts(batch, "_sites", each):
                laid = lay(rows)
                back, end = scan.best_steps(laid.side, emission(laid, model), *models[model], laid.first, _vectors(laid.rows, "_best"))
                yield keyed(laid.rows, [laid.rows.column("_idx"), _lists(scan.entrance(laid.side, back).astype(np.int32)), pa.array(end.astype(np.int32))])

        def ways(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, scan.Side, np.ndarray]]:
            for model, rows in _parts(batch, "_child", each * fan):
                side, k = scan.Side(rows.column("_child").value_lengths().to_numpy(zero_copy_only=False)), len(models[model][0])
                yield rows, side, side.lay(_flat(rows, "_way")[0].reshape(-1, k), np.arange(k, dtype=np.int32))

        def last(rows: pa.RecordBatch, side: scan.Side) -> np.ndarray:
            return _flat(rows, "_last")[0][np.cumsum(side.counts) - 1]

        def merge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for rows, side, way in ways(batch):
                yield keyed(rows, [rows.column("_idx"), _lists(scan.entrance(side, way).astype(np.int32)), pa.array(last(rows, side))])

        def hand(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for rows, side, way in ways(batch):
                end = rows.column("_end").to_numpy() if "_end" in batch.schema.names else last(rows, side)
                yield keyed(rows, [pa.array(_flat(rows, "_child")[0]), pa.array(side.flat(scan.trace(side, way, end)))], side.block)

        nodes = self._named(steps, entered, "_idx long, _way array<int>, _last int")
        return self._down(self._up(nodes, ["_way", "_last"], merge, "_way array<int>, _last int"), hand, "_end int")

    def _with_ends(self, products: tuple[str, ...]) -> DataFrame:
        entered = kept(self._entered(products))
        return entered.join(self._ends(entered), [*self.keys, "_idx"])

    def _path(self) -> Callable[[_Laid, np.ndarray, int], np.ndarray]:
        models = self.models

        def path(laid: _Laid, e: np.ndarray, model: int) -> np.ndarray:
            """The best path's state at each site, flat."""
            back, _ = scan.best_steps(laid.side, e, *models[model], laid.first, _vectors(laid.rows, "_best"))
            return laid.side.flat(scan.trace(laid.side, back, laid.rows.column("_end").to_numpy()))

        return path

    def paths(self) -> DataFrame:
        """keys, site, state of the best path; the first of equals."""
        lay, emission, path, keyed, each = self._lay(), self._emission(), self._path(), self._keyed(), self._each()

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for model, rows in _parts(batch, "_sites", each):
                laid = lay(rows)
                yield keyed(laid.rows, [pa.array(laid.sites), pa.array(path(laid, emission(laid, model), model))], laid.side.block)

        return self._named(run, self._with_ends(("most",)), "site long, state int")

    def _posterior(self, resets: dict[int, tuple[np.ndarray, float]] | None) -> Callable[[_Laid, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        models = self.models

        def posterior(laid: _Laid, e: np.ndarray, model: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(posterior, switch, resets) of each site, flat."""
            side, (initial, transition) = laid.side, models[model]
            prior, forward = scan.forward(side, e, initial, transition, laid.first, _vectors(laid.rows, "_before"), scan.sum_step)
            rest = scan.backward(side, e, transition, _vectors(laid.rows, "_after"), scan.sum_step)
            prior, onward, forward, rest = (side.flat(x) for x in (prior, e + rest, forward, rest))
            total, head = laid.rows.column("_total").to_numpy()[side.block][:, None], laid.first[side.block] & (side.at == 0)
            found = np.exp(forward + rest - total)
            switch = np.clip(1 - np.exp(prior + np.diag(transition) + onward - total).sum(1), 0, 1)
            drawn = np.zeros_like(found)
            if resets is not None:
                w, q = resets[model]
                with np.errstate(divide="ignore"):
                    drawn = np.exp(scan.log_sum(prior, 1)[:, None] + np.log(q * np.asarray(w)) + onward - total)
            switch[head], drawn[head] = 0.0, found[head]
            return found, switch, drawn

        return posterior

    def decode(self, resets: dict[int, tuple[np.ndarray, float]] | None = None) -> DataFrame:
        """keys, site, posterior (of all states), state (of the best path; the first of equals), switch (probability that the state changed), total.

        resets: (weights, q) of each model that is a reset chain; adds resets, the expected number of draws of each state at the site.
        """
        lay, emission, path, posterior, keyed, each = self._lay(), self._emission(), self._path(), self._posterior(resets), self._keyed(), self._each()

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for model, rows in _parts(batch, "_sites", each):
                laid = lay(rows)
                e, block = emission(laid, model), laid.side.block
                found, switch, drawn = posterior(laid, e, model)
                total = laid.rows.column("_total").take(pa.array(block))
                yield keyed(laid.rows, [pa.array(laid.sites), _lists(found), pa.array(path(laid, e, model)), pa.array(switch), _lists(drawn), total], block)

        out = self._named(run, self._with_ends(("plus", "most")), "site long, posterior array<double>, state int, switch double, resets array<double>, total double")
        return out if resets is not None else out.drop("resets")

    def draws(self, resets: dict[int, tuple[np.ndarray, float]]) -> DataFrame:
        """keys, resets: expected numbers of draws of each state, as decode has them for each site, summed over the sites of a block; a row for each block."""
        lay, emission, posterior, keyed, each = self._lay(), self._emission(), self._posterior(resets), self._keyed(), self._each()

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for model, rows in _parts(batch, "_sites", each):
                laid = lay(rows)
                drawn = laid.side.lay(posterior(laid, emission(laid, model), model)[2], 0.0).sum(0)
                yield keyed(laid.rows, [_lists(drawn)])

        return self._named(run, self._entered(("plus",)), "resets array<double>")

    def _margin(self) -> Callable[[_Laid, np.ndarray, int], tuple[np.ndarray, np.ndarray]]:
        models = self.models

        def margin(laid: _Laid, e: np.ndarray, model: int) -> tuple[np.ndarray, np.ndarray]:
            _, upto = scan.forward(laid.side, e, *models[model], laid.first, _vectors(laid.rows, "_best"), scan.best_step)
            return upto, e + scan.backward(laid.side, e, models[model][1], _vectors(laid.rows, "_rest"), scan.best_step)

        return margin

    def margins(self) -> DataFrame:
        """keys, site, upto, onward: for each state the best score of paths from the chain's start to it, and of paths from it to the end; both with its own emission."""
        lay, emission, margin, keyed, each = self._lay(), self._emission(), self._margin(), self._keyed(), self._each()

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for model, rows in _parts(batch, "_sites", each):
                laid = lay(rows)
                yield keyed(laid.rows, [pa.array(laid.sites), *[_lists(laid.side.flat(x)) for x in margin(laid, emission(laid, model), model)]], laid.side.block)

        return self._named(run, self._entered(("most",)), "site long, upto array<double>, onward array<double>")

    def intervals(self, cost: Callable[[np.ndarray], np.ndarray], moved: np.ndarray) -> DataFrame:
        """keys, candidate, cost: the least cost (less is better, so scores count negative) of the chain if the candidate takes one interval of sites.

        cost makes the candidates' costs at sites from the sites' values; moved[candidate, state] is what a move
        between them costs, either way. At the ends of the chain there is none.
        """
        lay, emission, margin, keyed, each = self._lay(), self._emission(), self._margin(), self._keyed(), self._each() + 512 * len(moved)

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for model, rows in _parts(batch, "_sites", each):
                laid = lay(rows)
                upto, onward = margin(laid, emission(laid, model), model)
                before = np.concatenate([_vectors(laid.rows, "_best")[None], upto[:-1]])
                # the least over states of what the path costs so far, or from here on, and the move
                enter, leave = (-scan.best_step(x, -moved.T) for x in (before, onward))
                enter[0, laid.first] = 0.0
                found = scan.best_intervals(laid.side, laid.side.lay(cost(laid.values), 0.0), enter, leave)
                n = len(moved)
                yield keyed(laid.rows, [laid.rows.column("_idx").take(pa.array(np.repeat(np.arange(laid.rows.num_rows), n))), pa.array(np.tile(np.arange(n, dtype=np.int32), laid.rows.num_rows)), *[pa.array(x.ravel()) for x in found]], np.repeat(np.arange(laid.rows.num_rows), n))

        blocks = self._named(run, self._entered(("most",)), "_idx long, candidate int, total double, low double, high double, within double")
        own = Window.partitionBy(*self.keys, "candidate")
        earlier = own.orderBy("_idx").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.withColumn("_o", F.coalesce(F.sum("total").over(earlier), F.lit(0.0))).withColumn("_start", F.col("low") - F.col("_o"))
        blocks = blocks.withColumn("_e", F.coalesce(F.min("_start").over(earlier), F.lit(float("inf"))))
        ends = F.least("within", F.col("_e") + F.col("_o") + F.col("high"))
        return blocks.groupBy(*self.keys, "candidate").agg(F.least(F.min(ends), F.min("_start") + F.sum("total")).alias("cost"))


def fit_resets(rows: DataFrame, states: int, expected: list[float], steps: int = 50, pseudo: float = 0.05, tolerance: float = 1e-6, **sizes: int) -> tuple[dict[int, np.ndarray], dict[int, float], Chains]:
    """(weights, log likelihood of each rate, their chains) of a reset chain over all rows, by EM for all expected numbers of resets at once.

    rows: site, state, value of one chain. All steps and rates share the chain's blocks; each step sums over all rates' blocks in one job, and
    the driver sees states x rates numbers.
    """
    members = {r: tuple(range(states)) for r in range(len(expected))}
    chains = Chains(rows, [], {r: reset_model(np.full(states, 1 / states), 0.5) for r in members}, members=members, **sizes)
    n = chains.blocks.agg(F.sum(F.size(F.array_distinct("_sites"))).alias("n")).first()["n"] or 0
    q = {r: min(0.5, e / max(n, 1)) for r, e in enumerate(expected)}
    w = {r: np.full(states, 1 / states) for r in q}
    for _ in range(steps):
        chains = chains.again({r: reset_model(w[r], q[r]) for r in q}, members)
        found = chains.draws({r: (w[r], q[r]) for r in q})
        drawn = found.select("_model", F.posexplode("resets").alias("state", "n")).groupBy("_model", "state").agg(F.sum("n").alias("n")).collect()
        after = {r: np.full(states, pseudo) for r in q}
        for row in drawn:
            after[row["_model"]][row["state"]] += row["n"]
        after = {r: v / v.sum() for r, v in after.items()}
        moved = max(float(np.abs(after[r] - w[r]).max()) for r in q)
        w = after
        if moved < tolerance:
            break
    chains = chains.again({r: reset_model(w[r], q[r]) for r in q}, members)
    return w, {r["_model"]: r["total"] for r in chains.totals().collect()}, chains


def rate_average(rows: DataFrame, states: int, expected: list[float], **fit: float) -> DataFrame:
    """site, posterior: the states' probabilities, averaged over the rates by their evidence."""
    _, totals, chains = fit_resets(rows, states, expected, **fit)
    top = max(totals.values())
    share = {r: float(np.exp(t - top)) for r, t in totals.items()}
    whole = sum(share.values())
    weight = F.create_map(*[x for r, s in share.items() for x in (F.lit(r), F.lit(s / whole))])
    cells = chains.decode().select("site", (weight[F.col("_model")]).alias("w"), F.posexplode("posterior").alias("state", "p"))
    return cells.groupBy("site", "state").agg(F.sum(F.col("w") * F.col("p")).alias("posterior"))
