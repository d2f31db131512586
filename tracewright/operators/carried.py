"""Rules whose state hangs on earlier decisions, cut so that no key is a task of its own.

Each rule is sequential by nature: what was sent decides what is sent next, what was forgotten
decides what is new, the clock's jumps decide which write a report meets. Rows are dealt into
blocks; either a block's effect on the state is a small function that can be composed with those
of other blocks, or blocks begin where the state is known whatever came before.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship
from . import ordering
from .ordering import exact_key, running_by_key, running_values


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Sorted rows in groups of equal keys: (keys, columns); a group is held whole."""
    held: dict[str, list] = {}
    now: tuple | None = None
    for b in batches:
        columns = {n: b.column(n).to_pylist() for n in b.schema.names}
        marks = list(zip(*(columns[k] for k in keys), strict=True))
        low = 0
        for high in [i for i in range(1, len(marks) + 1) if i == len(marks) or marks[i] != marks[i - 1]]:
            part = {n: c[low:high] for n, c in columns.items()}
            if marks[low] == now:
                for n, c in part.items():
                    held[n] += c
            else:
                if now is not None:
                    yield now, held
                now, held = marks[low], part
            low = high
    if now is not None:
        yield now, held


def _mapped(rows: DataFrame, keys: list[str], order: list[str], body: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kinds: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(body, kinds)


def _batch(kinds: str, *columns: list) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    names, own = zip(*(x.strip().split(" ") for x in kinds.split(",")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, t in zip(columns, own, strict=True)], names=list(names))


# -- the last one sent --------------------------------------------------------------------


def chain_ends(us: np.ndarray, quiet: int) -> np.ndarray:
    """For each row of a block, the time of the last one sent if that row is sent."""
    n = len(us)
    ends, values = us.tolist(), us.tolist()
    if (np.diff(us) >= 0).all():
        nexts = np.searchsorted(us, us + quiet, "left").tolist()
        for e in range(n - 1, -1, -1):
            if nexts[e] < n:
                ends[e] = ends[nexts[e]]
        return np.array(ends, np.int64)
    below: list[int] = []  # rows ahead that exceed all before them, nearest last, by falling time
    at: list[int] = []
    for e in range(n - 1, -1, -1):
        found = bisect_right(below, -(values[e] + quiet)) - 1
        if found >= 0:
            ends[e] = ends[at[found]]
        while below and -below[-1] <= values[e]:
            below.pop(), at.pop()
        below.append(-values[e]), at.append(e)
    return np.array(ends, np.int64)


def block_function(us: np.ndarray, quiet: int) -> tuple[list[int], list[int]]:
    """What a block makes of the time last sent before it: the first bound not below that time +
    quiet says the time last sent after it; above all bounds it stays. Steps of one end are one."""
    records = np.flatnonzero(us > np.concatenate([[np.iinfo(np.int64).min], np.maximum.accumulate(us)[:-1]]))
    ends = chain_ends(us, quiet)[records]
    last = np.append(np.flatnonzero(np.diff(ends)), len(ends) - 1)
    return us[records][last].tolist(), ends[last].tolist()


def quiet_repeats(rows: DataFrame, quiet_us: int) -> DataFrame:
    """line of the rows (key, line, us, none of them null) that come within quiet_us of their key's last one sent.

    Every block of a key becomes a step function from the time last sent before it to that
    after it; a key's functions, one row a block, are run through in order; then each block is
    read again with its own start.
    """
    ship(rows.sparkSession)
    kinds, carried = "key string, block long, bounds array<long>, ends array<long>", "key string, block long, sent long"
    own = materialize(rows.select("key", ordering.line_block().alias("block"), "line", "us"), "alerts")

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, block), part in _groups(batches, "key", "block"):
            bounds, ends = block_function(np.array(part["us"], np.int64), quiet_us)
            yield _batch(kinds, [key], [block], [bounds], [ends])

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sent = None, None
        for b in batches:
            found = []
            for key, bounds, ends in zip(*(b.column(n).to_pylist() for n in ("key", "bounds", "ends")), strict=True):
                if key != now:
                    now, sent = key, None
                found.append(sent)
                i = 0 if sent is None else int(np.searchsorted(bounds, sent + quiet_us, "left"))
                sent = ends[i] if i < len(ends) else sent
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("block"), pa.array(found, pa.int64())], names=["key", "block", "sent"])

    def hushed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sent = None, None
        for b in batches:
            found = []
            for key, block, line, us, start in zip(*(b.column(n).to_pylist() for n in ("key", "block", "line", "us", "sent")), strict=True):
                if (key, block) != now:
                    now, sent = (key, block), None
                if line is None:
                    sent = start
                elif sent is not None and us - sent < quiet_us:
                    found.append(line)
                else:
                    sent = us
            yield _batch("line long", found)

    tables = _mapped(own, ["key", "block"], ["line"], functions, kinds)
    begun = _mapped(tables, ["key"], ["block"], starts, carried)
    both = own.withColumn("sent", F.lit(None).cast("long")).unionByName(begun.where("sent IS NOT NULL"), allowMissingColumns=True)
    return _mapped(both, ["key", "block"], ["line"], hushed, "line long")


# -- a memory of so many values -------------------------------------------------------------


def forgetful_repeats(rows: DataFrame, memory: int) -> DataFrame:
    """line, again: whether a row's value is among the last ``memory`` its key took in.

    rows: line, key, value (not null). A value is taken in where it isn't held; the oldest one taken
    in goes first, and meeting a held value again doesn't make it younger. Keys are cut at
    every so many rows where the ``memory`` rows before are all new to the key: whatever
    came earlier, these are what is held there, and they are handed over as that part's start.
    """
    ship(rows.sparkSession)
    size = max(ordering.BLOCK, memory)
    line, block = F.col("line"), ordering.line_block()
    keys = {"key": F.col("key"), "use": exact_key(F.col("key"), F.col("value"))}
    wanted = {"at": ("key", "sum", F.lit(1).cast("long"), True), "uses": ("use", "sum", F.lit(1).cast("long"), True)}
    placed = running_values(rows.select("line", "key", "value"), keys, wanted, (line,), line, block).withColumn("at", F.col("at") - 1)
    known = running_by_key(placed, ["key"], {"repeat": ("max", F.when(F.col("uses") > 1, F.col("at")))}, ["line"], inclusive=False)
    part = F.floor(F.col("at") / size)
    clean = (F.col("at") % size == 0) & ((part == 0) | (F.col("at") - 1 - F.coalesce("repeat", F.lit(-1)) >= memory))
    dealt = running_by_key(known, ["key"], {"part": ("max", F.when(clean, part))}, ["line"]).select("key", "part", "at", "line", "value")
    dealt = materialize(dealt, "dealt")
    ahead = dealt.where(F.col("at") % size >= size - memory).select("key", (part + 1).alias("part"), "at", F.lit(None).cast("long").alias("line"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for b in batches:
            lines, again = [], []
            for key, own, n, value in zip(*(b.column(c).to_pylist() for c in ("key", "part", "line", "value")), strict=True):
                if (key, own) != now:
                    now, held = (key, own), {}
                if n is not None:
                    lines.append(n)
                    again.append(value in held)
                if value not in held:
                    held[value] = None
                    if len(held) > memory:
                        del held[next(iter(held))]
            yield _batch("line long, again boolean", lines, again)

    return _mapped(dealt.unionByName(ahead), ["key", "part"], ["at", "line"], run, "line long, again boolean")


# -- the write a report answers ---------------------------------------------------------------


def _answers(match_us: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of sorted stretches, the reports with whether a write answers them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, recent = None, deque()
        for b in batches:
            out: tuple[list, list, list] = [], [], []
            for key, stretch, side, line, pos, us, was in zip(*(b.column(n).to_pylist() for n in ("key", "stretch", "side", "line", "pos", "us", "was")), strict=True):
                if (key, stretch) != now:
                    now, recent = (key, stretch), deque([] if was is None else [was])
                if side == 0:
                    recent.append(us)
                while recent and recent[0] < us - 3 * match_us:
                    recent.popleft()
                if side:
                    last = next((w for w in reversed(recent) if w <= us), None)
                    for column, value in zip(out, (line, pos, last is not None and us - last <= match_us), strict=True):
                        column.append(value)
            yield _batch("line long, pos long, answered boolean", *out)

    return run


def answered(rows: DataFrame, match_us: int) -> DataFrame:
    """line, pos, answered for the reports of keys whose times fall somewhere.

    rows: key, line, side (0 a write, 1 a report), pos, us, was (time of the key's last write before)
    and high (greatest time of the key before), no time null. A report is answered by the last
    write before it by line, of those no later by time, if that is within match_us. Where times
    rise that is the last write. Elsewhere a key is cut wherever no time before exceeds one after;
    the stretches between, whose length is that of the clock's disorder, are read as streams,
    each with the last write before it.
    """
    ship(rows.sparkSession)
    order = ("line", "side", "pos")
    astray = rows.where("us < high").select("key").distinct()
    own = rows.join(astray, "key", "left_semi").select("key", *order, "us", "was", "high", *[(-F.col(c)).alias(f"_{c}") for c in order])
    own = materialize(own, "astray")
    low = running_by_key(own, ["key"], {"low": ("min", F.col("us"))}, [f"_{c}" for c in order], block=-ordering.line_block())
    cut = F.coalesce(F.col("high") <= F.col("low"), F.lit(True)).cast("long")
    cuts = running_by_key(low, ["key"], {"stretch": ("sum", cut)}, order).withColumn("pos", F.col("pos").cast("long"))
    return _mapped(cuts.select("key", "stretch", *order, "us", "was"), ["key", "stretch"], list(order), _answers(match_us), "line long, pos long, answered boolean")
