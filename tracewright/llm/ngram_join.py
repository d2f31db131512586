"""Jaccard self-join of word n-gram sets by prefix trees.

Two documents link when their sets' Jaccard similarity reaches a bound. The result is one
row per document with its connected component; links are never listed for whole groups.

1.  In one pass over all texts each becomes a sorted set of 64-bit n-gram hashes. Documents with
    equal sets are one class; only classes are joined, and copies within a task go no further.
2.  Prefix filter over a global order (the hash): linked classes share a number of n-grams
    within their extended prefixes. Prefix n-grams meet in one shuffle, and a class stays
    only if enough of its own are held by another class. Of those it keeps the rarest, as
    many as the bound needs; classes with a kept n-gram in common form a candidate group.
3.  Within a group the sets are stored in a trie, in the same global order, so that alike sets
    share the start of their path. A set is compared with all others in one traversal, which
    adds up overlaps shared by all sets below a node and leaves out subtrees that, by
    the lengths that remain, can't reach the bound.
4.  A group of more than a FEW classes is parted first: of whole sets, in the order of
    the n-grams' numbers of classes in the group, a class stays only if others hold as many
    of its n-grams as any partner has, and meets them by the rarest of these alone. So classes that
    share a common passage, but not most of their text, come apart.
5.  A group larger than one task should hold is dealt into tiles, which share a few classes.
    Each tile is joined by itself first; then only classes outside the group's largest
    component are compared across tiles, so a large group of near copies costs little beyond
    its first pass.

N-grams in very many documents (counted over all documents, in bounded chunks) are known
beforehand to be shared, so they are counted without being shuffled.

All decisions are exact but for collisions of 64-bit hashes (odds of 2^-64 for any two
n-grams).

Defined results: null, empty and blank texts have an empty set, link with nothing and are
their own component; rows with a null id link with nothing and have no component; rows with
the same id and text are alike, and rows of one id with different texts are documents of
their own; an empty table gives an empty result; other columns are ignored. Texts are taken
whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shingles import PIECE, finish, ngram_sets
from .util import discard, materialize, small_batches, unused

#: A link needs den * intersection >= num * union.
NUM, DEN = 3, 4
#: Prefixes are extended by 1/EXTEND of a set.
EXTEND = 8
#: An n-gram counts as frequent if a chunk of prefixes holds it so often, and all chunks together so often.
CHUNK, IN_CHUNK, IN_ALL, MOST_FREQUENT = 1_000_000, 16, 64, 16384
#: Tokens and classes of a tile, and the classes that all tiles of a group share.
TILE_TOKENS, TILE_SETS, PIVOTS = 500_000, 512, 8
#: Classes of a group that are compared as they are.
FEW = 32
#: Classes a task remembers so as to leave out their copies.
REMEMBERED = 500_000



# -- sets -------------------------------------------------------------------------------


def class_of(s: np.ndarray) -> int | None:
    """The class key of a set: equal for equal sets; None for the empty set."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)) if len(s) else None


def least_overlap(n: int) -> int:
    """Elements a set of n shares at least with any set it links with."""
    return -(-NUM * n // DEN)


def prefix_and_need(n: int) -> tuple[int, int]:
    """Length of the extended prefix, and how many of it any partner has in its own.

    With prefixes of n - overlap + 1 + e elements, linked sets share 1 + min(e, e') of them;
    the partner's e' is at least that of the smallest set that can link.
    """
    return min(n, n - least_overlap(n) + 1 + n // EXTEND), 1 + least_overlap(n) // EXTEND


# -- the trie ---------------------------------------------------------------------------


class Trie:
    """Sets of int ranks as a path-compressed prefix tree in arrays, children side by side."""

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        rows = [sets[i] for i in self.order]
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        # nodes as (first set, last set, depth where its segment begins, depth where it ends)
        shared = [0] + [self._common(rows[i - 1], rows[i]) for i in range(1, len(rows))]
        first, last, begin, end, parent = [], [], [], [], []
        todo = [(0, len(rows), 0, -1)] if rows else []
        head = 0
        while head < len(todo):
            lo, hi, depth, up = todo[head]
            head += 1
            if up >= 0 or head > 1:
                stop = int(sizes[lo]) if hi - lo == 1 else min(int(sizes[lo]), min(shared[lo + 1 : hi]))
                first.append(lo), last.append(hi), begin.append(depth), end.append(stop), parent.append(up)
                me, depth = len(first) - 1, stop
                start = lo + (int(sizes[lo]) == stop)
            else:
                me, start = -1, lo
            i = start
            while i < hi:
                j = i + 1
                while j < hi and shared[j] > depth:
                    j += 1
                todo.append((i, j, depth, me))
                i = j
        self.first, self.last = np.array(first, dtype=np.int64), np.array(last, dtype=np.int64)
        self.depth, self.length = np.array(end, dtype=np.int64), np.array(end, dtype=np.int64) - np.array(begin, dtype=np.int64)
        self.parent = np.array(parent, dtype=np.int64)
        self.tail = np.array([rows[lo][e - 1] for lo, e in zip(first, end, strict=True)], dtype=np.int64)
        segments = [rows[lo][b:e] for lo, b, e in zip(first, begin, end, strict=True)]
        self.tokens = np.concatenate(segments) if segments else np.empty(0, np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)])[:-1] if segments else np.empty(0, np.int64)
        self.ends = np.where(sizes[self.first] == self.depth, self.first, -1) if segments else np.empty(0, np.int64)
        self.least = np.array([sizes[a:b].min() for a, b in zip(first, last, strict=True)], dtype=np.int64)
        self.most = np.array([sizes[a:b].max() for a, b in zip(first, last, strict=True)], dtype=np.int64)
        count = np.bincount(self.parent + 1, minlength=len(first) + 1)
        self.child = np.concatenate([[0], np.cumsum(count)])  # children of node i (or of the root, -1): child[i+1] to child[i+2]
        self.sizes, self.rows = sizes, rows

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def partners(self, probe: int, flags: np.ndarray) -> np.ndarray:
        """Places of the sets after ``probe`` (in trie order) that link with it."""
        row, n = self.rows[probe], int(self.sizes[probe])
        flags[row] = True
        nodes, overlap, found = np.arange(self.child[0], self.child[1]), np.zeros(int(self.child[1] - self.child[0]), np.int64), []
        while len(nodes):
            near = (self.last[nodes] > probe + 1) & (DEN * self.most[nodes] >= NUM * n) & (NUM * self.least[nodes] <= DEN * n)
            nodes, overlap = nodes[near], overlap[near]
            if not len(nodes):
                break
            length = self.length[nodes]
            stop = np.cumsum(length)
            where = np.arange(stop[-1]) + np.repeat(self.at[nodes] - (stop - length), length)
            hits = np.concatenate([[0], np.cumsum(flags[self.tokens[where]])])
            overlap = overlap + hits[stop] - hits[stop - length]
            ends = self.ends[nodes]
            linked = (ends > probe) & ((NUM + DEN) * overlap >= NUM * (n + self.sizes[ends]))
            found.append(ends[linked])
            left = np.minimum(n - np.searchsorted(row, self.tail[nodes], "right"), self.most[nodes] - self.depth[nodes])
            alive = (NUM + DEN) * (overlap + left) >= NUM * (n + self.least[nodes])
            nodes, overlap = nodes[alive], overlap[alive]
            low, high = self.child[nodes + 1], self.child[nodes + 2]
            width = high - low
            if not width.sum():
                break
            stop = np.cumsum(width)
            nodes, overlap = np.arange(stop[-1]) + np.repeat(low - (stop - width), width), np.repeat(overlap, width)
        flags[row] = False
        return np.concatenate(found) if found else np.empty(0, np.int64)


def linked_pairs(sets: list[np.ndarray], known: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs of places that span the components of the links of sorted sets. Sets of one
    ``known`` component count as linked already."""
    if len(sets) < 2:
        return []
    distinct, rank = np.unique(np.concatenate(sets), return_inverse=True)
    trie = Trie(np.split(rank, np.cumsum([len(s) for s in sets])[:-1]))
    _, root = np.unique(np.array(known), return_inverse=True) if known is not None else (None, np.arange(len(sets)))
    root = root[np.array(trie.order)]
    flags, pairs = np.zeros(len(distinct), dtype=bool), []
    for probe in range(len(sets)):
        partners = trie.partners(probe, flags)
        other = partners[root[partners] != root[probe]]
        if not len(other):
            continue
        _, pick = np.unique(root[other], return_index=True)
        for p in other[pick]:
            pairs.append((trie.order[probe], trie.order[int(p)]))
            root[root == root[p]] = root[probe]
    return pairs


# -- Spark ------------------------------------------------------------------------------


def _batch(names: list[str], kinds: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _raw(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.binary()).to_pylist()


def _is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def describe(rows: DataFrame) -> DataFrame:
    """The one pass over all texts. rows: doc_id, digest, text.

    Gives doc_id, digest, n, cls for each row, with the extended prefix at the first row of a
    class in a task (copies carry none), and (token, seen) rows of n-grams frequent in a chunk.
    """
    names = ["doc_id", "digest", "n", "cls", "prefix", "token", "seen"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        known: set[int] = set()

        def frequent() -> pa.RecordBatch:
            token, seen = np.unique(np.concatenate(held), return_counts=True)
            token, seen = token[seen >= IN_CHUNK].view(np.int64), seen[seen >= IN_CHUNK]
            held.clear()
            return _batch(names, kinds, [*[pa.nulls(len(token), k) for k in kinds[:5]], token, seen])

        waiting = 0
        for b in batches:
            sizes, classes, prefixes = [], [], []
            for s in ngram_sets(_raw(b.column(2))):
                cls, prefix = class_of(s), None
                if cls is not None and cls not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known.add(cls)
                    head = s[: prefix_and_need(len(s))[0]]
                    held.append(head)
                    waiting += len(head)
                    prefix = head.tobytes()
                sizes.append(len(s)), classes.append(cls), prefixes.append(prefix)
            none = pa.nulls(b.num_rows, pa.int64())
            yield _batch(names, kinds, [b.column(0), b.column(1), sizes, classes, prefixes, none, none])
            if waiting >= CHUNK:
                yield frequent()
                waiting = 0
        if held:
            yield frequent()

    return rows.mapInArrow(run, "doc_id long, digest long, n long, cls long, prefix binary, token long, seen long")


def prefixes(heads: DataFrame, frequent: np.ndarray) -> DataFrame:
    """token, cls, need: extended prefixes (n, cls, prefix) without frequent n-grams.

    need is what the class still needs besides its frequent ones. Where they suffice, one
    row with need 0 and a token of its own says so.
    """
    names, kinds = ["token", "cls", "need"], [pa.int64(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cls = b.column(0).to_numpy(), b.column(1).to_numpy()
            each = [np.frombuffer(p, np.uint64) for p in b.column(2).to_pylist()]
            row = np.repeat(np.arange(len(each)), [len(p) for p in each])
            token = np.concatenate(each) if each else np.empty(0, np.uint64)
            hot = _is_in(token, frequent)
            need = np.array([prefix_and_need(int(x))[1] for x in n], np.int64) - np.bincount(row[hot], minlength=len(n))
            sure = need <= 0
            row, token = row[~hot], token[~hot]
            own = finish(cls[sure].view(np.uint64) ^ np.uint64(len(names)))
            tokens = np.concatenate([own, token]).view(np.int64)
            needs = np.concatenate([np.zeros(len(own), np.int64), np.maximum(1, need)[row]])
            yield _batch(names, kinds, [tokens, np.concatenate([cls[sure], cls[row]]), needs])

    return heads.mapInArrow(run, "token long, cls long, need int")


def survivors(heads: DataFrame) -> DataFrame:
    """cls, keys: classes that share enough of their prefix, and the n-grams they meet by.

    The windows by n-gram aren't long: those in very many prefixes were set apart, and beyond
    the MOST_FREQUENT an n-gram has less than 1/MOST_FREQUENT of all prefix rows.
    """
    sql = F.expr
    seen = heads.selectExpr(
        "token", "cls", "need", "count(*) OVER (PARTITION BY token) AS df", "min(cls) OVER (PARTITION BY token) AS low", "max(cls) OVER (PARTITION BY token) AS high"
    ).where("need = 0 OR low <> high")
    held = seen.groupBy("cls").agg(
        sql("collect_set(CASE WHEN need > 0 THEN struct(df, token) END)").alias("held"),
        sql("coalesce(min(CASE WHEN need > 0 THEN need END), 1)").alias("need"),
        sql("min(need) = 0").alias("sure"),
    )
    kept = held.where("sure OR size(held) >= need")
    return kept.select("cls", sql("transform(slice(array_sort(held), 1, greatest(0, size(held) - need + 1)), x -> x.token)").alias("keys"))


def sets_of(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """cls, n, tokens, hot: the sets of texts (cls, text), and the frequent n-grams to meet by."""
    names, kinds = ["cls", "n", "tokens", "hot"], [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for b in batches:
            out: list[list] = [[], [], [], []]
            for cls, s in zip(b.column(0).to_pylist(), ngram_sets(_raw(b.column(1))), strict=True):
                if cls in known:
                    continue
                if len(known) >= REMEMBERED:
                    known.clear()
                known.add(cls)
                length, need = prefix_and_need(len(s))
                hot = s[:length][_is_in(s[:length], frequent)]
                keep = max(0, len(hot) - need + 1)
                for column, value in zip(out, (cls, len(s), s.tobytes(), hot[:keep].view(np.int64).tolist()), strict=True):
                    column.append(value)
            yield _batch(names, kinds, out)

    return texts.mapInArrow(run, "cls long, n long, tokens binary, hot array<long>")


def _held(member: DataFrame) -> DataFrame:
    """key, cls, least: each n-gram of each class of member (grp, cls, tokens). key stands for the
    n-gram within the group; least is how many of a class's n-grams any partner has."""
    names, kinds = ["key", "cls", "least"], [pa.int64(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[tuple[np.ndarray, int]] = []
            waiting = 0
            for i, (grp, cls, tokens) in enumerate(zip(*[c.to_pylist() for c in b.columns], strict=True), 1):
                s = np.frombuffer(tokens, np.uint64)
                held.append((finish(s ^ finish(np.array([grp], np.int64).view(np.uint64))), cls))
                waiting += len(s)
                if waiting >= PIECE or i == b.num_rows:
                    sizes = [len(s) for s, _ in held]
                    key = np.concatenate([s for s, _ in held]).view(np.int64)
                    yield _batch(names, kinds, [key, np.repeat([c for _, c in held], sizes), np.repeat([least_overlap(n) for n in sizes], sizes)])
                    held, waiting = [], 0

    return member.select("grp", "cls", "tokens").mapInArrow(run, "key long, cls long, least int")


def closer(member: DataFrame) -> DataFrame:
    """member (cls, n, tokens, grp) with smaller groups that part no linked classes; classes that
    can't link are left out.

    Linked classes share ``least`` n-grams at least, all of which two classes or more of the group hold. In
    an order of these, here by the number of classes, the first shared one is among the first
    held - least + 1 of either. Common n-grams are counted before they are shuffled, and the join
    may be split where one is hot.
    """
    shared = _held(member).groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.min("cls").alias("low")).where("df > 1")
    seen = _held(member).join(shared, "key").groupBy("cls").agg(F.first("least").alias("least"), F.collect_list(F.struct("df", "key", "low")).alias("held"))
    hubs = "array_distinct(slice(array_sort(held), 1, size(held) - least + 1).low)"
    kept = materialize(seen.where("size(held) >= least").selectExpr("cls", f"{hubs} AS hubs"), "join-keys", release=True)
    found = components(kept.selectExpr("cls AS a", "explode(hubs) AS b"))
    grouped = kept.select("cls").join(found.selectExpr("node AS cls", "root AS grp"), "cls")
    parted = materialize(member.select("cls", "n", "tokens").join(grouped, "cls"), "join-closer", release=True)
    discard(kept)
    return parted


def place(member: DataFrame) -> DataFrame:
    """cls, n, tokens, grp, tiles, tile of the classes whose group has another, once groups of
    many are parted."""

    def sized(classes: DataFrame) -> DataFrame:
        size = classes.groupBy("grp").agg(F.sum("n").alias("ns"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
        tiles = F.greatest(F.ceil(F.col("ns") / TILE_TOKENS), F.ceil(F.col("sets") / TILE_SETS)).cast("int")
        return classes.join(materialize(size.select("grp", "sets", tiles.alias("tiles")), "join-tiles"), "grp")

    every = sized(member)
    large = every.where(F.col("sets") > FEW)
    if not large.isEmpty():
        every = every.where(F.col("sets") <= FEW).unionByName(sized(closer(large.select(*member.columns))))
    return every.drop("sets").withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))


def _join_tiles(rows: DataFrame, *keys: str) -> DataFrame:
    """a, b: links that span the components of each tile. rows: keys, cls, known, tokens.

    Tiles are dealt over tasks whole and follow each other there, so a task holds one at a time.
    """

    def links(tile: dict[int, tuple[int, bytes]]) -> list[tuple[int, int]]:
        cls = list(tile)
        found = linked_pairs([np.frombuffer(t, np.uint64) for _, t in tile.values()], [k for k, _ in tile.values()])
        return [(cls[i], cls[j]) for i, j in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile = None, {}
        for b in batches:
            found: list[tuple[int, int]] = []
            columns = [c.to_pylist() for c in b.columns]
            for *key, cls, known, tokens in zip(*columns, strict=True):
                if key != now:
                    found += links(tile)
                    now, tile = key, {}
                tile[cls] = known, tokens
            yield _batch(["a", "b"], [pa.int64()] * 2, [[x for x, _ in found], [y for _, y in found]])
        found = links(tile)
        yield _batch(["a", "b"], [pa.int64()] * 2, [[x for x, _ in found], [y for _, y in found]])

    dealt = rows.select(*keys, "cls", "known", "tokens").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a long, b long")


def within_tiles(placed: DataFrame) -> DataFrame:
    """Links within tiles. placed: cls, grp, tiles, tile, tokens.

    All tiles of a group share PIVOTS of its classes, so what is alike them becomes one
    component over all tiles at once.
    """
    large = placed.where(f"tiles > 1 AND tile < {PIVOTS}")
    pivots = large.groupBy("grp", "tile").agg(F.min("cls").alias("cls"), F.first("tiles").alias("tiles"))
    seats = pivots.select("grp", "cls", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    shared = seats.join(placed.select("cls", "tokens"), "cls")
    every = placed.select("grp", "tile", "cls", "tokens").unionByName(shared.select("grp", "tile", "cls", "tokens"))
    return _join_tiles(every.withColumn("known", F.col("cls")), "grp", "tile")


def across_tiles(placed: DataFrame, links: DataFrame) -> DataFrame:
    """Links between tiles of the groups that have more than one.

    placed: cls, grp, tiles, tokens. Classes of a group's largest component so far (its
    core) needn't be compared with each other.
    """
    found = components(links)
    large = placed.where("tiles > 1").select("cls", "grp", "n").join(found.withColumnRenamed("node", "cls"), "cls", "left")
    large = materialize(large.select("cls", "grp", "n", F.coalesce("root", "cls").alias("known")), "join-large")
    by_part = large.groupBy("grp", "known").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("ns"))
    core = by_part.groupBy("grp").agg(F.max_by("known", F.struct("sets", "known")).alias("core"), F.max_by("ns", F.struct("sets", "known")).alias("core_n"), F.max("sets").alias("core_sets"), F.sum("ns").alias("all_n"), F.sum("sets").alias("all_sets"))
    tiles = lambda n, sets: F.greatest(F.ceil(2 * n / TILE_TOKENS), F.ceil(2 * sets / TILE_SETS), F.lit(1)).cast("int")
    core = core.where("all_sets > core_sets").select("grp", "core", tiles(F.col("core_n"), F.col("core_sets")).alias("core_tiles"), tiles(F.col("all_n") - F.col("core_n"), F.col("all_sets") - F.col("core_sets")).alias("rest_tiles"))
    core = materialize(core, "join-core")
    side = large.join(core, "grp").withColumn("inner", F.col("known") == F.col("core"))
    side = side.withColumn("own", F.pmod(F.xxhash64("cls"), F.when(F.col("inner"), F.col("core_tiles")).otherwise(F.col("rest_tiles"))).cast("int"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    seats = F.when(F.col("inner"), F.transform(every(F.col("rest_tiles")), lambda j: F.struct(j.alias("x"), F.lit(-1).alias("y"), F.col("own").alias("z")))).otherwise(
        F.concat(
            F.transform(every(F.col("core_tiles")), lambda j: F.struct(F.col("own").alias("x"), F.lit(-1).alias("y"), j.alias("z"))),
            F.transform(every(F.col("rest_tiles")), lambda j: F.struct(F.least(j, F.col("own")).alias("x"), F.greatest(j, F.col("own")).alias("y"), F.lit(-1).alias("z"))),
        )
    )
    seated = side.select("cls", "grp", "known", F.explode(seats).alias("s")).join(placed.select("cls", "tokens"), "cls")
    return _join_tiles(seated.select("grp", "s.x", "s.y", "s.z", "cls", "known", "tokens"), "grp", "x", "y", "z")


def join_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes) of docs (doc_id, digest, text): doc_id, digest, n, cls of each row; cls,
    root (a class that stands for its component) and component_id (its smallest id) of each class."""
    small_batches(docs.sparkSession)
    described = materialize(describe(docs), "join-docs")
    rows = materialize(described.where("token IS NULL").select("doc_id", "digest", "n", "cls"), "join-rows")
    top = described.where("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= IN_ALL)
    frequent = np.sort(np.array([r["token"] for r in top.orderBy(F.desc("seen"), "token").limit(MOST_FREQUENT).collect()], dtype=np.int64).view(np.uint64))
    known = docs.where("doc_id IS NOT NULL")
    classes = rows.where("doc_id IS NOT NULL AND cls IS NOT NULL").groupBy("cls").agg(F.min(F.struct("doc_id", "digest")).alias("m"))
    classes = materialize(classes.select("cls", "m.doc_id", "m.digest"), "join-classes", release=True)

    alive = materialize(survivors(prefixes(described.where("prefix IS NOT NULL").select("n", "cls", "prefix"), frequent)), "join-survivors", release=True)
    discard(described)
    texts = alive.select("cls").join(classes, "cls").join(known, ["doc_id", "digest"]).select("cls", "text")
    sets = materialize(sets_of(texts, frequent), "join-sets", release=True)
    rare = alive.select("cls", F.explode("keys").alias("token")).selectExpr("cls AS a", "min(cls) OVER (PARTITION BY token) AS b")
    hot = sets.select("cls", F.explode("hot").alias("token"))
    hubs = hot.groupBy("token").agg(F.min("cls").alias("b"))  # at most MOST_FREQUENT rows
    edges = rare.unionByName(hot.join(F.broadcast(hubs), "token").select(F.col("cls").alias("a"), "b"))
    groups = materialize(components(edges), "join-groups")

    member = sets.select("cls", "n", "tokens").join(groups.select(F.col("node").alias("cls"), F.col("root").alias("grp")), "cls")
    member = materialize(member.dropDuplicates(["cls"]), "join-members", release=True)
    discard(alive, sets, groups)
    placed = place(member)
    links = materialize(within_tiles(placed), "join-links", release=True)
    if not placed.where("tiles > 1").isEmpty():
        links = links.unionByName(materialize(across_tiles(placed, links), "join-across", release=True))
    found = components(links).withColumnRenamed("node", "cls")
    joined = materialize(classes.join(found, "cls", "left").select("cls", "doc_id", F.coalesce("root", "cls").alias("root")), "join-roots")
    discard(member)
    least = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows, joined.join(least, "root").select("cls", "root", "component_id")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links) of each row."""
    rows, classes = join_classes(_keyed(docs, id_col, text_col))
    # documents without words are many null keys, which a join would send to one task
    found = rows.where("cls IS NOT NULL").join(materialize(classes, "join-result", release=True), "cls", "left").select("doc_id", "n", "component_id")
    found = found.unionByName(rows.where("cls IS NULL").select("doc_id", "n", F.lit(None).cast("long").alias("component_id")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id, and of those of the smallest
    digest of the text. Rows of the same id and text count as one; rows with a null id stay."""
    rows, classes = join_classes(_keyed(docs, id_col, text_col))
    same = rows.where("doc_id IS NOT NULL").groupBy("doc_id", "digest", "cls").agg(F.count(F.lit(1)).alias("copies"))
    joined = same.where("cls IS NOT NULL").join(materialize(classes, "join-result", release=True), "cls")
    heads = joined.groupBy("root").agg(F.min(F.struct("doc_id", "digest", "copies")).alias("m")).select("m.*")
    heads = heads.unionByName(same.where("cls IS NULL").select("doc_id", "digest", "copies"))
    key, digest, copies = (unused(docs, c) for c in ("head_id", "head_digest", "head_copies"))
    heads = materialize(heads.toDF(key, digest, copies), "join-heads", release=True)
    own = F.xxhash64(F.col(text_col))
    kept = docs.join(heads, (F.col(id_col).cast("long") == F.col(key)) & (own == F.col(digest)))
    repeated = kept.where(F.col(copies) > 1).dropDuplicates([key, digest])
    found = kept.where(F.col(copies) == 1).unionByName(repeated).drop(key, digest, copies)
    return found.unionByName(docs.where(F.col(id_col).isNull()))
