"""Connected components of an edge table by alternating large and small stars.

Edges never meet on the driver: it sees one count a round. Each round is written to the
shared folder, so lineage stays short and a lost executor costs one round at most. Edges are
contracted within each partition at first and on both sides of a round's last shuffle, which
leaves at most one edge for each node that a task holds at once. Once no more than SMALL edges are
left, whatever the table, one task contracts them. A round's tables go once the next is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import discard, materialize, small_batches

#: Nodes a task holds at once while it contracts edges.
HELD = 1_000_000
#: Edges that are contracted at once, if their nodes are no more than a task holds.
SMALL = 250_000


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _contract(batches: Iterator[pa.RecordBatch], sorted_by_a: bool = False) -> Iterator[pa.RecordBatch]:
    """Each node but the roots with its root, of the edges of a task. Where they are sorted by a,
    a node's edges stay linked also if they lie on both sides of a chunk's end."""
    forest, last = Forest(), None

    def tree_edges() -> pa.RecordBatch:
        nodes = [x for x in forest.up if forest.find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64())], names=["a", "b"])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            forest.join(x, y)
            last = x
        if len(forest.up) >= HELD:
            yield tree_edges()
            before, forest = forest, Forest()
            if sorted_by_a:
                forest.join(last, before.find(last))
    yield tree_edges()


def _least(edges: DataFrame) -> DataFrame:
    """a, m, top, d for each node: the least of it and its neighbours, the largest neighbour, its edges."""
    return _both(edges).groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.max("b").alias("top"), F.count("b").alias("d"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _round(edges: DataFrame, least: DataFrame) -> DataFrame:
    """One large star and one small star, written. edges: a > b; least: of them, written.

    Both sides of the join are read anew, so that Spark can split a hub with very many edges
    over tasks. For the small star a node's edges meet in one task, at most one from each task
    before, and are contracted there with all others of that task. Neighbours of a component's
    smallest node stay such, and while there are other nodes, each round makes some of them so.
    """
    large = _both(edges).join(least.select("a", "m"), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    met = large.mapInArrow(_contract, "a long, b long").repartition("a").sortWithinPartitions("a")
    found = materialize(met.mapInArrow(lambda batches: _contract(batches, True), "a long, b long"), "edges")
    discard(least, edges)
    return found


def _at_once(edges: DataFrame, least: DataFrame) -> DataFrame:
    """The stars of a bounded number of edges, written."""
    found = materialize(edges.coalesce(1).mapInArrow(_contract, "a long, b long"), "edges")
    discard(least, edges)
    return found


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """node, root for every node of the edges: root is the smallest node it is linked with.

    Edges with a null end or two equal ends are left out; repeated edges count once.
    """
    small_batches(edges.sparkSession)
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").mapInArrow(_contract, "a long, b long")
    found = materialize(e, "edges")
    for _ in range(rounds):
        least = materialize(_least(found), "least")
        # all are stars once no node but a smallest one has another neighbour than its least
        open_nodes, ends = least.agg(F.count_if(F.expr("m < a AND m <> top")), F.sum("d")).first()
        if not open_nodes:
            discard(found)
            return least.select(F.col("a").alias("node"), F.col("m").alias("root"))
        found = _at_once(found, least) if ends <= min(2 * SMALL, HELD - 1) else _round(found, least)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
