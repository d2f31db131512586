"""Prefix trie of conversations that are rebuilt from a base conversation's head and their own rest.

Conversation c is rebuilt as the first h turns of its base (c - c % group), followed by its own
turns after its first h; h is the CRC-32 of c's decimal digits modulo ``heads``. Nodes of the trie
are the distinct sequences of first turns. Rebuilt texts are never made:

1.  Order. Turns are sorted over all conversations at once, so that one with very many turns is
    spread over tasks, and numbered by blocks. Every turn becomes a reference: an exact code of
    its role and text, and its code points.
2.  Fingerprints. A run of turns is an element (B^length, value) of a monoid, the product of
    (m, v) and (n, w) is (m n, v + m w). Running values of the stored conversations are all that
    is computed; a prefix of a rebuilt one is the product of two of them, the base's head and
    the own turns up to some place without their first h, by arithmetic alone.
3.  Proof. Prefixes with one fingerprint are one node only if they end in one turn code and
    continue one fingerprint; so, from the root down, they are the same turns. Should any group
    fail that, all is done again with other bases.
4.  Subtrees. A node is represented by its smallest member. What a node adds to all nodes
    above it is put on its representative's place and summed along that conversation; the sums
    of a node's members are then the sums over its subtree, without a step for each depth.

Defined results: a null role or text is empty; turns stand by turn (null first), then role, then
text, and repeated rows are turns of their own; rows with a null conv_id belong to no conversation
and are left out; an empty table gives no nodes, not even a root; other columns are ignored.
Texts are compared whole, whatever their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import running_by_key
from .util import discard, materialize, small_batches

GROUP, HEADS = 100, 6
#: Rows of a conversation that a window holds at once, and member ids in one piece of a list.
BLOCK, PIECE = 1 << 14, 4096
#: Three primes below 2^31, so that products fit a long.
PRIMES = (2147483647, 2147483629, 2147483587)
DIGIT = 6
Residues = tuple[Column, ...]
KEY = ("depth", "k1", "k2")


def _bases(attempt: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{attempt}.{i}".encode()).digest()[:8]) % (p - 2) + 2 for i, p in enumerate(PRIMES)]


def _power(base: int, prime: int, exponent: Column) -> Column:
    """base^exponent modulo prime, by the exponent's digits to the base 64."""
    found = F.lit(1).cast("long")
    for low in range(0, 60, DIGIT):
        powers = F.array(*[F.lit(pow(base, d << low, prime)).cast("long") for d in range(1 << DIGIT)])
        digit = F.shiftright(exponent, low).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int")
        found = found * F.get(powers, digit) % prime
    return found


def _packed(residues: Residues) -> tuple[Column, Column]:
    return F.shiftleft(residues[0], 31).bitwiseOR(residues[1]), residues[2]


def _code(role: Column, text: Column) -> Column:
    return F.xxhash64(role, text)


def _variants(rows: DataFrame) -> DataFrame | None:
    """Numbers of turns whose different texts share a hash, mostly none: hash, role, text, variant."""
    texts = rows.select("hash", "role", "text").distinct()
    shared = materialize(texts.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "clashes")
    if shared.isEmpty():
        discard(shared)
        return None
    order = Window.partitionBy("hash").orderBy("role", "text")
    return texts.join(shared, "hash").withColumn("variant", F.row_number().over(order).cast("long"))


def ordered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, at (from 0), hash and variant (the turn's exact code), chars."""
    c = F.col
    rows = conversations.where(c(conv).isNotNull()).select(
        c(conv).cast("long").alias("conv"), c(turn).alias("turn"), F.coalesce(c(role), F.lit("")).alias("role"), F.coalesce(c(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("salt")
    )
    rows = rows.withColumn("hash", _code(c("role"), c("text")))
    variants = _variants(rows)
    rows = rows.withColumn("variant", F.lit(0).cast("long")) if variants is None else rows.join(variants, ["hash", "role", "text"], "left").fillna(0, ["variant"])
    # the salt lets equal rows be split over tasks
    rows = rows.sort("conv", F.asc_nulls_first("turn"), "role", "text", "salt").select("conv", F.monotonically_increasing_id().alias("place"), "hash", "variant", F.length("text").cast("long").alias("chars"))
    placed = materialize(rows, "turns")
    numbered = running_by_key(placed, ["conv"], {"n": ("sum", F.lit(1).cast("long"))}, ["place"], block=F.floor(c("place") / BLOCK))
    return numbered.select("conv", (c("n") - 1).alias("at"), "hash", "variant", "chars")


def _prefixes(turns: DataFrame, bases: list[int]) -> DataFrame:
    """turns with a0, a1, a2: the values of their conversations up to and with them; b0, b1, b2: before them."""
    terms = {f"t{i}": F.pmod(F.xxhash64("hash", "variant", F.lit(i)), F.lit(p)) * _power(bases[i], p, F.col("at")) % p for i, p in enumerate(PRIMES)}
    rows = turns.withColumns(terms)
    sums = running_by_key(rows, ["conv"], {f"s{i}": ("sum", F.col(f"t{i}")) for i in range(len(PRIMES))}, ["at"], block=F.floor(F.col("at") / BLOCK))
    return sums.select(
        *turns.columns, *[(F.col(f"s{i}") % p).alias(f"a{i}") for i, p in enumerate(PRIMES)], *[F.pmod(F.col(f"s{i}") - F.col(f"t{i}"), F.lit(p)).alias(f"b{i}") for i, p in enumerate(PRIMES)]
    )


def _plan(prefixes: DataFrame, group: int, heads: int) -> DataFrame:
    """A row for each conversation: conv, base, h, n (own turns), k (turns of the head), and the
    values of its head (h0..) and of its own first h turns (c0..)."""
    c = F.col
    sizes = prefixes.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    h = F.pmod(F.crc32(c("conv").cast("string").cast("binary")), F.lit(heads))
    own = sizes.select("conv", (c("conv") - c("conv") % group).alias("base"), h.alias("h"), "n")
    own = own.join(sizes.select(c("conv").alias("base"), c("n").alias("nb")), "base", "left").withColumn("k", F.least("h", F.coalesce("nb", F.lit(0)))).drop("nb")
    early = prefixes.where(c("at") < heads - 1)
    values = lambda out, key, at: early.select(c("conv").alias(key), (c("at") + 1).alias(at), *[c(f"a{i}").alias(f"{out}{i}") for i in range(len(PRIMES))])
    own = own.join(values("h", "base", "k"), ["base", "k"], "left").join(values("c", "conv", "h"), ["conv", "h"], "left")
    return own.fillna(0, [f"{x}{i}" for x in "hc" for i in range(len(PRIMES))])


def _members(prefixes: DataFrame, plan: DataFrame, bases: list[int], heads: int) -> DataFrame:
    """A row for each prefix of each rebuilt conversation: conv, depth, its fingerprint (k1, k2),
    that of the prefix before (q1, q2), the last turn (hash, variant, chars), and whether it is the whole."""
    c, out = F.col, ["conv", "depth", "hash", "variant", "chars", "whole"]

    def row(df: DataFrame, value: Residues, before: Residues) -> DataFrame:
        (k1, k2), (q1, q2) = _packed(value), _packed(before)
        return df.select(*out, k1.alias("k1"), k2.alias("k2"), q1.alias("q1"), q2.alias("q2"))

    each = range(len(PRIMES))
    none = tuple(F.lit(0).cast("long") for _ in each)
    root = plan.select(
        "conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("hash"), F.lit(0).cast("long").alias("variant"), F.lit(0).cast("long").alias("chars"), ((c("k") == 0) & (c("n") <= c("h"))).alias("whole")
    )
    taken = prefixes.where(c("at") < heads - 1).withColumnRenamed("conv", "base").join(plan.select("conv", "base", "h", "k", "n"), "base").where(c("at") < c("k"))
    taken = taken.withColumns({"depth": c("at") + 1, "whole": (c("at") + 1 == c("k")) & (c("n") <= c("h"))})
    own = prefixes.join(plan, "conv").where(c("at") >= c("h")).withColumns({"depth": c("at") - c("h") + c("k") + 1, "whole": c("at") + 1 == c("n")})

    def product(i: int, value: str) -> Column:
        """Head times own turns: their value without the first h, moved from place h to place k."""
        p, b = PRIMES[i], bases[i]
        back, forth = (F.array(*[F.lit(pow(b, s * d, p)).cast("long") for d in range(heads)]) for s in (-1, 1))
        moved = F.pmod(c(f"{value}{i}") - c(f"c{i}"), F.lit(p)) * F.get(back, c("h").cast("int")) % p * F.get(forth, c("k").cast("int")) % p
        return (c(f"h{i}") + moved) % p

    values = lambda name: tuple(c(f"{name}{i}") for i in each)
    found = row(root, none, none).unionByName(row(taken, values("a"), values("b")))
    return found.unionByName(row(own, tuple(product(i, "a") for i in each), tuple(product(i, "b") for i in each)))


def _nodes(members: DataFrame) -> DataFrame:
    same = ("q1", "q2", "hash", "variant")
    every = members.groupBy(*KEY).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), *[F.min(s).alias(s) for s in same], *[F.max(s).alias(f"_{s}") for s in same]
    )
    differs = F.lit(False)
    for s in same:
        differs = differs | (F.col(s) != F.col(f"_{s}"))
    return every.withColumn("mixed", differs).drop(*[f"_{s}" for s in same])


def fingerprinted(turns: DataFrame, group: int, heads: int, attempts: int = 8) -> tuple[DataFrame, DataFrame]:
    """Members and proven nodes, both written."""
    for attempt in range(attempts):
        bases = _bases(attempt)
        prefixes = materialize(_prefixes(turns, bases), "prefixes")
        plan = materialize(_plan(prefixes, group, heads), "plan")
        members = materialize(_members(prefixes, plan, bases, heads), "members")
        nodes = materialize(_nodes(members), "nodes")
        discard(prefixes, plan)
        if nodes.where("mixed").isEmpty():
            return members, nodes.drop("mixed")
        discard(members, nodes)
    raise RuntimeError(f"fingerprints of different prefixes met with {attempts} sets of bases")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, which come in order; only the open key's state is held."""
    key, state = None, None

    def closed() -> pa.RecordBatch:
        columns = [pa.array([x], pa.int64()) for x in key] + [pa.array([state.hexdigest()])]
        return pa.RecordBatch.from_arrays(columns, names=[*KEY, "ends_sha256"])

    for b in batches:
        for *own, ids in zip(*(b.column(n).to_pylist() for n in (*KEY, "ids")), strict=True):
            if own != key:
                if key is not None:
                    yield closed()
                key, state = own, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if key is not None:
        yield closed()


def end_digests(members: DataFrame) -> DataFrame:
    """KEY, ends_sha256 of the ids of the conversations that end in a node, ascending and joined by commas.

    A digest must be taken in order, so a node's ids meet in one task; they come there as text in
    pieces of PIECE ids at most, and are read as a stream.
    """
    small_batches(members.sparkSession)
    pieces = members.where("whole").groupBy(*KEY, F.floor(F.col("conv") / PIECE).alias("piece")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"))
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS, **names: str) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (over its subtree) and ends_sha256."""
    c = F.col
    turns = materialize(ordered_turns(conversations, **names), "ordered")
    members, nodes = fingerprinted(turns, group, heads)
    children = nodes.where("depth > 0").groupBy((c("depth") - 1).alias("depth"), c("q1").alias("k1"), c("q2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(children, [*KEY], "left").fillna(0, ["n_children"]), "counted")
    # each node's own share, on its representative's place, and summed over that place and all below it
    shares = nodes.select(c("conv_id").alias("conv"), "depth", ((c("n_convs") - 1) * c("chars")).alias("saved"), (c("n_children") == 0).cast("long").alias("leaf"))
    placed = members.select("conv", *KEY).join(shares, ["conv", "depth"], "left").withColumn("up", -c("depth"))
    below = running_by_key(placed, ["conv"], {"s": ("sum", c("saved")), "l": ("sum", c("leaf"))}, ["up"], block=F.floor(c("up") / BLOCK))
    sums = below.groupBy(*KEY).agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    found = materialize(nodes.join(sums, [*KEY]).join(end_digests(members), [*KEY], "left"), "summed")
    # children of the root share one parent, which is one row; all others look theirs up
    top = nodes.where("depth = 0").select(c("conv_id").alias("root"))
    first = found.where("depth <= 1").crossJoin(F.broadcast(top)).withColumn("parent_conv_id", F.when(c("depth") == 1, c("root"))).drop("root")
    above = nodes.where("depth > 0").select((c("depth") + 1).alias("depth"), c("k1").alias("q1"), c("k2").alias("q2"), c("conv_id").alias("parent_conv_id"))
    rest = found.where("depth > 1").join(above, ["depth", "q1", "q2"])
    out = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    return first.select(*out).unionByName(rest.select(*out))
