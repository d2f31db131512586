"""Random forests over counted cells, one Spark pass a level.

A forest that splits at bin edges sees of a row only its bins and its class. So rows are binned once (at most
``BINS`` bins a feature) and equal ones become one cell with a count; a bootstrap's Poisson(1) for each row of a
cell is Poisson(count) for the cell. Few features make few cells, however long the table; with many features
cells are as many as rows, and a pass over them is cheap: tasks hold blocks of cells, draw the counts of a tree
again from block and tree, follow only cells whose node is still open, and add them up by node, feature, bin and
class. The sums of a tree meet in one group, which finds the best splits. The driver holds the trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize, ship

#: Bins of a feature, as MLlib has them; ranks asked for to find their edges; cells of a block.
BINS, RANKS, BLOCK = 32, 1024, 1 << 16
#: Most bytes of one pass' sums in a task; trees whose open nodes need more go in several passes.
PASS_BYTES = 1 << 26
#: Chances of Poisson(1) to be below 1, 2, ..., in units of 2^-32.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])
_POISSON = np.minimum(_POISSON * 2.0**32, 2.0**32 - 1).astype(np.uint32)


# -- bins and cells -----------------------------------------------------------------------


def _spread(rows: DataFrame) -> DataFrame:
    """rows over at least as many partitions as there are cores; a small table is read as one."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def edges(rows: DataFrame, features: Sequence[str], label: str) -> list[np.ndarray]:
    """Cuts of each feature from all rows: between any two values if there are at most ``BINS``, else at even
    ranks, where both classes weigh the same in all."""
    inputs = rows.select(label, *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    ranks = [i / RANKS for i in range(RANKS + 1)]
    found = [inputs.where(F.col(label) == y).approxQuantile(inputs.columns[1:], ranks, 0.25 / RANKS) for y in (0, 1)]
    cuts = []
    for own in zip(*found, strict=True):
        at = np.sort(np.concatenate([np.asarray(x, dtype=np.float64) for x in own]))
        at = at[np.isfinite(at)]
        values, last = np.unique(at[::-1], return_index=True)
        below = len(at) - last  # how many ranks do not exceed each value
        wanted = np.arange(1, BINS) * len(at) / BINS
        low = np.arange(len(values)) if len(values) <= BINS else np.unique(np.abs(below[:, None] - wanted).argmin(axis=0))
        low = low[low < len(values) - 1]
        cuts.append(values[low] + (values[low + 1] - values[low]) / 2)
    return cuts


def codes(columns: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of rows (rows x features): how many cuts lie below; NaN and null lie above all."""
    return np.stack([np.searchsorted(c, np.asarray(x, dtype=np.float64), side="left") for x, c in zip(columns, cuts, strict=True)], axis=1).astype(np.uint8)


def cells(rows: DataFrame, features: Sequence[str], label: str, cuts: Sequence[np.ndarray]) -> DataFrame:
    """code, label, n: the distinct binned rows of each class, and how many rows each stands for."""
    width = len(features)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = codes([b.column(i).to_numpy(zero_copy_only=False) for i in range(width)], cuts)
            packed = pa.Array.from_buffers(pa.binary(width), len(code), [None, pa.py_buffer(code.tobytes())])
            yield pa.RecordBatch.from_arrays([packed.cast(pa.binary()), b.column(width)], names=["code", "label"])

    inputs = rows.select(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f"x{i}") for i, f in enumerate(features)], F.col(label).cast("int").alias("label"))
    return inputs.mapInArrow(binned, "code binary, label int").groupBy("code", "label").agg(F.count(F.lit(1)).alias("n"))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows by ``BLOCK`` at most."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            part, b = b.slice(0, BLOCK - n), b.slice(BLOCK - n)
            held.append(part)
            n += part.num_rows
            if n == BLOCK:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def blocks(found: DataFrame, size: int) -> DataFrame:
    """block, marks (cells x features: 2 x bin + class), counts: cells by at most ``BLOCK``, over about as many
    equal files as there are cores, or a multiple."""
    cores = found.sparkSession.sparkContext.defaultParallelism
    files = cores * math.ceil(size / (cores * 4 * BLOCK)) if size > 1024 * cores else math.ceil(size / 1024)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for part in _whole(batches):
            code = np.frombuffer(b"".join(part.column("code").to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1)
            marks = 2 * code + part.column("label").to_numpy().astype(np.uint8)[:, None]
            columns = [marks.tobytes(), part.column("n").to_numpy().astype(np.int64).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[pa.array([c], pa.binary()) for c in columns]], names=["block", "marks", "counts"])
            number += 1

    dealt = found.repartition(max(files, 1), "code", "label").sortWithinPartitions("code", "label")
    return dealt.mapInArrow(packed, "block long, marks binary, counts binary")


# -- one level ----------------------------------------------------------------------------


def drawn(counts: np.ndarray, seed: int, tree: int, block: int) -> np.ndarray:
    """How often each cell is in the tree's bootstrap; the same at every call."""
    dice = np.random.Generator(np.random.SFC64([seed, tree, block]))
    one = dice.integers(0, 1 << 32, size=len(counts), dtype=np.uint32)
    times = np.zeros(len(counts), dtype=np.uint8)
    for chance in _POISSON:
        times += one >= chance
    many = counts > 1
    if many.any():
        times = times.astype(np.int64)
        times[many] = dice.poisson(counts[many])
    return times


@dataclass
class Tree:
    """Nodes as columns. child: the left one (the right one follows), or -1; c0, c1: bootstrapped rows by class."""

    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [0])
    child: list[int] = field(default_factory=lambda: [-1])
    c0: list[int] = field(default_factory=lambda: [0])
    c1: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    open: list[int] = field(default_factory=lambda: [0])

    def walk(self) -> tuple[np.ndarray, ...]:
        """feature, cut (as a mark: of the last bin on the left and class 1), child, slot among the open nodes."""
        slot = np.full(len(self.child), -1, dtype=np.int32)
        slot[self.open] = np.arange(len(self.open))
        return np.array(self.feature, dtype=np.int32), np.array(self.cut, dtype=np.uint8) * np.uint8(2) + np.uint8(1), np.array(self.child, dtype=np.int32), slot


def counted(batches: Iterator[pa.RecordBatch], trees: dict[int, tuple], level: int, width: int, seed: int) -> Iterator[pa.RecordBatch]:
    """tree, sums: bootstrapped rows of a task's blocks by tried feature, open node, bin and class."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for block, held, counts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            mark, count = np.frombuffer(held, dtype=np.uint8), np.frombuffer(counts, dtype=np.int64)
            for tree, ((feature, cut, child, slot), tried) in trees.items():
                times = drawn(count, seed, tree, block)
                row = np.flatnonzero(times)
                weights = times[row].astype(np.float64)
                row *= width  # where the cell's marks begin
                node = np.zeros(len(row), dtype=np.int32)
                for _ in range(level):
                    node = child[node] + (mark[row + feature[node]] > cut[node])
                    alive = np.flatnonzero((child[node] >= 0) | (slot[node] >= 0))
                    row, node, weights = row[alive], node[alive], weights[alive]
                at, size = slot[node], len(tried) * 2 * BINS
                if tree not in sums:
                    sums[tree] = np.zeros((tried.shape[1], size))
                for j in range(tried.shape[1]):
                    sums[tree][j] += np.bincount(at * (2 * BINS) + mark[row + tried[at, j]], weights, minlength=size)
    for tree, own in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([own.astype(np.int64).tobytes()], pa.binary())], names=["tree", "sums"])


def best_splits(sums: np.ndarray, weights: tuple[float, float], leaf: int) -> dict[str, np.ndarray]:
    """Of each open node (nodes x features x bins x classes): its rows by class, and the cut with most Gini gain.

    Both sides need ``leaf`` rows; equal gains go to the first feature and cut. gain is weighted by the node's rows; 0: no split.
    """
    total = sums[:, 0].sum(axis=1)
    left = sums.cumsum(axis=2)[:, :, :-1]
    right = total[:, None, None, :] - left

    def spoiled(counts: np.ndarray) -> np.ndarray:
        a, b = counts[..., 0] * weights[0], counts[..., 1] * weights[1]
        return 2 * a * b / np.maximum(a + b, 1e-300)

    gain = spoiled(total)[:, None, None] - spoiled(left) - spoiled(right)
    enough = (left.sum(axis=-1) >= leaf) & (right.sum(axis=-1) >= leaf)
    # gains that differ by rounding only are equal, and none at all isn't a split
    gain = np.where(enough & (gain > 1e-12 * spoiled(total)[:, None, None]), gain, 0.0).reshape(len(sums), -1)
    best = gain.argmax(axis=1)
    nodes = np.arange(len(sums))
    which, cut = best // (BINS - 1), best % (BINS - 1)
    side = left[nodes, which, cut]
    return {"slot": nodes, "which": which, "cut": cut, "gain": gain[nodes, best], "c0": total[:, 0], "c1": total[:, 1], "l0": side[:, 0], "l1": side[:, 1]}


def _level(table: DataFrame, trees: dict[int, tuple], level: int, width: int, seed: int, weights: tuple[float, float], leaf: int) -> pd.DataFrame:
    sc = table.sparkSession.sparkContext
    shared = sc.broadcast(trees)
    m = next(iter(trees.values()))[1].shape[1]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for b in batches:
            for tree, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                whole[tree] = whole.get(tree, 0) + np.frombuffer(part, dtype=np.int64)
        for tree, own in whole.items():
            best = best_splits(own.reshape(m, -1, BINS, 2).swapaxes(0, 1), weights, leaf)
            yield pa.RecordBatch.from_pydict({"tree": np.full(len(best["slot"]), tree), **best})

    partial = table.mapInArrow(lambda batches: counted(batches, shared.value, level, width, seed), "tree int, sums binary")
    dealt = partial.repartition(min(sc.defaultParallelism, len(trees)), "tree")
    found = dealt.mapInArrow(split, "tree long, slot long, which long, cut long, gain double, c0 long, c1 long, l0 long, l1 long").toPandas()
    shared.destroy()
    return found.sort_values(["tree", "slot"])


# -- the forest ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    """Fitted trees: (feature, cut, child, chance of label 1) by node, and each feature's importance."""

    features: tuple[str, ...]
    cuts: tuple[np.ndarray, ...]
    trees: tuple[tuple[np.ndarray, ...], ...]
    importances: np.ndarray

    def of_codes(self, code: np.ndarray) -> np.ndarray:
        """Mean chance over the trees, for binned rows."""
        total = np.zeros(len(code))
        for feature, cut, child, chance in self.trees:
            node, row = np.zeros(len(code), dtype=np.int32), np.arange(len(code))
            while len(row):
                row = row[child[node[row]] >= 0]
                now = node[row]
                node[row] = child[now] + (code[row, feature[now]] > cut[now])
            total += chance[node]
        return total / len(self.trees)

    def of_columns(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """The same for rows; those of equal bins are scored once."""
        code = codes(columns, self.cuts)
        keys, back = np.unique(np.ascontiguousarray(code).view(f"V{code.shape[1]}").ravel(), return_inverse=True)
        return self.of_codes(keys.view(np.uint8).reshape(-1, code.shape[1]))[back]

    def score(self, rows: DataFrame) -> Column:
        spark = rows.sparkSession
        ship(spark)
        shared = spark.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def scored(*columns: pd.Series) -> pd.Series:
            return pd.Series(shared.value.of_columns([c.to_numpy(dtype=np.float64, na_value=np.nan) for c in columns]))

        return scored(*[F.col(f).cast("double") for f in self.features])


def _waves(open_nodes: dict[int, int], node_bytes: int) -> Iterator[list[int]]:
    wave, held = [], 0
    for tree, nodes in open_nodes.items():
        if wave and held + nodes * node_bytes > PASS_BYTES:
            yield wave
            wave, held = [], 0
        wave.append(tree)
        held += nodes * node_bytes
    if wave:
        yield wave


def fit(train: DataFrame, features: Sequence[str], label: str, trees: int, depth: int, leaf: int, seed: int) -> Forest:
    """Balanced classes, bootstraps of all rows, and the root of the features tried at each node (all, by one tree)."""
    ship(train.sparkSession)
    width = len(features)
    rows = _spread(train.select(*features, label))
    cuts = edges(rows, features, label)
    found = materialize(cells(rows, features, label, cuts), "forest-cells")
    sizes = {r["label"]: (r["cells"], r["n"]) for r in found.groupBy("label").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n")).collect()}
    if not sizes:
        raise ValueError("a forest needs training rows")
    n = sum(rows for _, rows in sizes.values())
    weights = tuple(n / (2.0 * max(sizes.get(y, (0, 0))[1], 1)) for y in (0, 1))
    table = materialize(blocks(found, sum(c for c, _ in sizes.values())), "forest-blocks")
    grown = {t: Tree() for t in range(trees)}
    m = width if trees == 1 else math.ceil(math.sqrt(width))
    for level in range(depth):
        going = {t: len(x.open) for t, x in grown.items() if x.open}
        for wave in _waves(going, m * BINS * 2 * 8):
            dice = np.random.Generator(np.random.SFC64([seed, level, wave[0], 1 << 40]))
            tried = {t: np.sort(dice.random((going[t], width)).argsort(axis=1)[:, :m], axis=1).astype(np.int32) for t in wave}
            best = _level(table, {t: (grown[t].walk(), tried[t]) for t in wave}, level, width, seed, weights, leaf)
            for t, own in best.groupby("tree"):
                _grow(grown[t], own, tried[t], weights, leaf, last=level == depth - 1)
    discard(found, table)
    return _finished(grown, features, cuts, weights)


def _grow(tree: Tree, best: pd.DataFrame, tried: np.ndarray, weights: tuple[float, float], leaf: int, last: bool) -> None:
    was, tree.open = tree.open, []
    for slot, which, cut, gain, c0, c1, l0, l1 in best[["slot", "which", "cut", "gain", "c0", "c1", "l0", "l1"]].itertuples(index=False):
        node = was[slot]
        tree.c0[node], tree.c1[node] = c0, c1
        if gain <= 0:
            continue
        tree.feature[node], tree.cut[node], tree.child[node], tree.gain[node] = int(tried[slot, which]), cut, len(tree.child), gain
        for a, b in ((l0, l1), (c0 - l0, c1 - l1)):
            if not last and a and b and a + b >= 2 * leaf:
                tree.open.append(len(tree.child))
            for column, value in ((tree.feature, 0), (tree.cut, 0), (tree.child, -1), (tree.c0, a), (tree.c1, b), (tree.gain, 0.0)):
                column.append(value)


def _finished(grown: dict[int, Tree], features: Sequence[str], cuts: list[np.ndarray], weights: tuple[float, float]) -> Forest:
    done, importance = [], np.zeros(len(features))
    for t in sorted(grown):
        feature, cut, child = (np.array(x) for x in (grown[t].feature, grown[t].cut, grown[t].child))
        a, b = np.array(grown[t].c0) * weights[0], np.array(grown[t].c1) * weights[1]
        own = np.bincount(feature, np.array(grown[t].gain), minlength=len(features))
        importance += own / own.sum() if own.sum() > 0 else 0.0
        done.append((feature.astype(np.int32), cut.astype(np.uint8), child.astype(np.int32), b / np.maximum(a + b, 1e-300)))
    return Forest(tuple(features), tuple(cuts), tuple(done), importance / max(importance.sum(), 1e-300))
