"""Running values over one global order, or over keys of any size, without a window of a whole key.

Rows are dealt into blocks that follow the order (a block is a function of the ordering
value). A window runs within each block; the blocks' totals, a small table, are accumulated
by themselves and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 14
#: Rows that a task of running values sorts on the average, whatever the size of the table.
TASK_ROWS = 1 << 15


class Blocks(NamedTuple):
    """Blocks that follow an order, and the number of tasks they are dealt over."""

    column: Column
    tasks: int


def line_block(line: str = "line", size: int | None = None) -> Column:
    return F.floor(F.col(line) / (size or BLOCK))


def running_sums(df: DataFrame, sums: dict[str, str], order: Column, block: Column) -> DataFrame:
    """Add, for each (column, name), the sum of the column up to and with each row.

    order: a sort key without ties; block must not fall where it rises.
    """
    rows = df.withColumn("_block", block)
    totals = rows.groupBy("_block").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    prior = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_block", *[F.coalesce(F.sum(f"_t_{c}").over(prior), F.lit(0)).alias(f"_c_{c}") for c in sums])
    within = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.join(carried, "_block")
    for c, name in sums.items():
        found = found.withColumn(name, F.sum(c).over(within) + F.col(f"_c_{c}"))
    return found.drop("_block", *[f"_c_{c}" for c in sums])


def dense_numbers(df: DataFrame, out: str, order: Column, block: Column) -> DataFrame:
    """Number rows from 1 in a global order; ``order`` has no ties, ``block`` follows it."""
    return running_sums(df.withColumn("_one", F.lit(1).cast("bigint")), {"_one": out}, order, block).drop("_one")


_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def running_by_key(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, Column]], order: Sequence[str], inclusive: bool = True, block: Column | None = None) -> DataFrame:
    """Add running values of each key: name -> (sum, min, max or last, value).

    A window runs within a key's block of lines, so a key with a third of all rows is spread
    over as many tasks as it has blocks; what its earlier blocks say is joined back. Values
    are those up to the row, with itself if ``inclusive``. ``last`` is the last that isn't null.
    """
    rows = df.withColumn("_block", line_block() if block is None else block).withColumns({f"_v_{n}": v for n, (_, v) in wanted.items()})
    at = F.struct(*order)
    of_block = {n: F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)) if kind == "last" else _MERGE[kind](f"_v_{n}") for n, (kind, _) in wanted.items()}
    totals = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_kb")).agg(*[c.alias(f"_t_{n}") for n, c in of_block.items()])
    own_keys = [f"_k{i}" for i in range(len(keys))]
    prior = Window.partitionBy(*own_keys).orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1)
    carry = {n: F.last(f"_t_{n}", ignorenulls=True) if kind == "last" else _MERGE[kind](f"_t_{n}") for n, (kind, _) in wanted.items()}
    carried = totals.select(*own_keys, "_kb", *[c.over(prior).alias(f"_c_{n}") for n, c in carry.items()])
    same = F.col("_block").eqNullSafe(F.col("_kb"))
    for k, own in zip(keys, own_keys, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(own))
    within = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    found = rows.join(carried, same, "left")
    for n, (kind, _) in wanted.items():
        value, before = F.col(f"_v_{n}"), F.col(f"_c_{n}")
        if kind == "last":
            here = F.coalesce(F.last(value, ignorenulls=True).over(within), before)
        elif kind == "sum":
            here = F.coalesce(F.sum(value).over(within), F.lit(0)) + F.coalesce(before, F.lit(0))
        else:
            here = (F.least if kind == "min" else F.greatest)(_MERGE[kind](value).over(within), before)
        found = found.withColumn(n, here)
    return found.select(*df.columns, *wanted)


def time_block(df: DataFrame, us: str = "us", line: str = "line", size: int | None = None) -> Column:
    """A block that follows (us with nulls last, line): spans of time that hold ``size`` rows on
    the average. Least and greatest time and their count are asked of df at once (one row)."""
    return time_blocks(df, us, line, size).column


def time_blocks(df: DataFrame, us: str = "us", line: str = "line", size: int | None = None) -> Blocks:
    """``time_block`` with the number of tasks that the rows are dealt over."""
    size = size or BLOCK
    low, high, n, every = df.agg(F.min(us), F.max(us), F.count(us), F.count(F.lit(1))).first()
    width = max(1, ((high or 0) - (low or 0)) * size // max(n, 1))
    return Blocks(F.coalesce(F.floor((F.col(us) - F.lit(low or 0)) / F.lit(width)), F.lit(1 << 62) + line_block(line, size)), tasks_for(df, every))


def line_blocks(df: DataFrame) -> Blocks:
    """``line_block`` with the number of tasks that the rows of df are dealt over; df is counted."""
    return Blocks(line_block(), tasks_for(df, df.count()))


def tasks_for(df: DataFrame, rows: int) -> int:
    """So many tasks that each has about TASK_ROWS rows: a fixed number would make a task's sorts grow with the table."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def exact_key(*parts: Column) -> Column:
    """One text for several columns, different wherever any of them is (a null is a value)."""
    texts = [p.cast("string") for p in parts]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def running_values(df: DataFrame, keys: dict[str, Column], wanted: dict[str, tuple[str, str, Column, bool]], order: Sequence[Column], at: Column, block: Column | Blocks) -> DataFrame:
    """Add running values over many keys at once: name -> (name of a key, sum, min, max or last,
    value, whether a row's own value is in).

    block follows the order, and at is a value that sorts like it; rows are counted where it comes
    without a number of tasks. Rows are shuffled once for all keys, by block: what a key's earlier
    blocks say comes in as one more row before the block's own. What is grouped by key is only the
    blocks' totals, so no key is a task of its own; they are made of a shuffle by block, too, as
    input splits may hold any number of rows. ``last`` is the last value that isn't null; a null key
    gives null. Hashes of the keys stand before them, so that sorts compare numbers.
    """
    block, tasks = block if isinstance(block, Blocks) else (block, tasks_for(df, df.count()))
    place = {k: i for i, k in enumerate(keys)}
    rows = df.withColumns({"_block": block} | {f"_k{i}": keys[k].cast("string") for k, i in place.items()} | {f"_v{j}": w[2] for j, w in enumerate(wanted.values())})
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(f"_k{i}").alias("key")) for i in place.values()]))
    narrow = rows.select("_block", at.alias("_at"), *[f"_v{j}" for j in range(len(wanted))], *[f"_k{i}" for i in place.values()]).repartition(tasks, "_block")
    spread = narrow.select("_block", "_at", *[f"_v{j}" for j in range(len(wanted))], each.alias("e")).where("e.key IS NOT NULL")
    total, carry, frame = [], [], Window.unboundedPreceding
    prior = Window.partitionBy("hash", "key", "kind").orderBy("_block").rowsBetween(frame, -1)
    for j, (key, kind, _, _) in enumerate(wanted.values()):
        own = F.when(F.col("e.kind") == place[key], F.col(f"_v{j}"))
        total.append((F.max_by(own, F.when(own.isNotNull(), F.col("_at"))) if kind == "last" else _MERGE[kind](own)).alias(f"_v{j}"))
        carry.append((F.last(f"_v{j}", ignorenulls=True) if kind == "last" else _MERGE[kind](f"_v{j}")).over(prior).alias(f"_v{j}"))
    carried = spread.groupBy(F.xxhash64("e.key").alias("hash"), "e.key", "e.kind", "_block").agg(*total)
    carried = carried.repartition(tasks, "hash", "key", "kind").select("kind", "key", "_block", *carry)
    carried = carried.where(F.coalesce(*[F.col(f"_v{j}").isNotNull() | F.lit(None) for j in range(len(wanted))], F.lit(False)))
    ahead = carried.select("_block", F.lit(0).alias("_own"), *[F.when(F.col("kind") == i, F.col("key")).alias(f"_k{i}") for i in place.values()], *[f"_v{j}" for j in range(len(wanted))])
    found = rows.withColumn("_own", F.lit(1)).unionByName(ahead, allowMissingColumns=True).repartition(tasks, "_block")
    merged = {}
    for j, (name, (key, kind, _, inclusive)) in enumerate(wanted.items()):
        own = f"_k{place[key]}"
        within = Window.partitionBy(F.xxhash64(own), own, "_block").orderBy("_own", *order).rowsBetween(frame, 0 if inclusive else -1)
        value = F.last(f"_v{j}", ignorenulls=True) if kind == "last" else _MERGE[kind](f"_v{j}")
        merged[name] = F.when(F.col(own).isNotNull(), value.over(within))
    return found.withColumns(merged).where("_own = 1").select(*df.columns, *wanted)


def group_places(df: DataFrame, out: str, group: str = "grp") -> DataFrame:
    """Add each row's place in its group (from 0), by time with nulls last, then line. A null group is one too."""
    us, line = F.col("us"), F.col("line")
    one = {out: ("grp", "sum", F.lit(1).cast("bigint"), True)}
    placed = running_values(df, {"grp": exact_key(F.col(group))}, one, (us.asc_nulls_last(), line), F.struct(us.isNull(), us, line), time_blocks(df))
    return placed.withColumn(out, F.col(out) - 1)


def running_totals(df: DataFrame, wanted: dict[str, tuple[Column, Column]], order: Sequence[Column], at: Column, block: Column | Blocks) -> DataFrame:
    """Running sums, with each row's own value: name -> (key, value)."""
    return running_values(df, {n: k for n, (k, _) in wanted.items()}, {n: (n, "sum", v.cast("bigint"), True) for n, (_, v) in wanted.items()}, order, at, block)
