"""Baseline statistics of a training prefix, by grouped aggregation.

Event columns: line, us, src, dst, direction, service, size, origin, ctl, write (boolean).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import channel_key
from ..session import materialize
from .ordering import line_block, running_values

SECOND = 1_000_000


def with_channel(events: DataFrame) -> DataFrame:
    return events.withColumn("channel", channel_key(F.col("src"), F.col("dst"), F.col("direction"), F.col("service")))


def training_prefix(events: DataFrame, duration_us: int, fallback_rows: int = 1000, min_rows: int = 0) -> DataFrame:
    """Rows up to ``duration_us`` after the first row, in order, that has a time.

    Rows before that one, or without a time, belong to it while fewer than ``fallback_rows``
    rows do. Reading stops at the first later row once ``min_rows`` are in.
    The span's start and end come along as train_start and train_end.
    """
    span = events.agg(F.min_by("us", F.when(F.col("us").isNotNull(), F.col("line"))).alias("train_start"), F.min(F.when(F.col("us").isNotNull(), F.col("line"))).alias("start_line"))
    rows = events.crossJoin(F.broadcast(span)).withColumn("train_end", F.col("train_start") + duration_us)
    timed = F.col("us").isNotNull() & (F.col("line") >= F.col("start_line"))
    inside = rows.where(F.when(timed, F.col("us") <= F.col("train_end")).otherwise(True)).withColumn("timed", timed)
    # only rows without a usable time need a running count, and there are few of them before the bound
    untimed = inside.where("NOT timed").orderBy("line").limit(fallback_rows).select("line", F.lit(True).alias("early"))
    kept = inside.join(untimed, "line", "left").where("timed OR early").drop("early")
    late = events.crossJoin(F.broadcast(span)).where(timed & (F.col("us") > F.col("train_start") + duration_us)).select("line")
    if min_rows:
        reached = kept.orderBy("line").limit(min_rows).agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("at"))
        stop = reached.where(F.col("n") == min_rows).join(late).where(F.col("line") > F.col("at")).agg(F.min("line").alias("stop"))
        kept = kept.crossJoin(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("line") < F.col("stop"))).drop("stop")
    return kept.drop("timed", "start_line")


def service_probability(events: DataFrame) -> DataFrame:
    """Share of each direction and service; the total is taken over the small result."""
    counts = events.groupBy(F.concat_ws("|", "direction", "service").alias("combo")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("combo", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))


def _spread(values: Column) -> list[Column]:
    return [F.count(values).alias("n"), F.avg(values).alias("mean"), F.coalesce(F.stddev_samp(values), F.lit(0.0)).alias("std")]


def gap_rows(timed: DataFrame, longest_us: int) -> DataFrame:
    """channel, gap: time since the channel's row before, where it counts. timed: channel, line, us (not null)."""
    line = F.col("line")
    was = running_values(timed, {"channel": F.col("channel")}, {"was": ("channel", "last", F.col("us"), False)}, (line,), line, line_block())
    return was.select("channel", (F.col("us") - F.col("was")).alias("gap")).where(F.col("gap").between(0, longest_us))


def interarrival_stats(events: DataFrame, longest_us: int = 3600 * SECOND) -> DataFrame:
    """Seconds since the channel's previous row with a time, in order; negative and very long ones are left out."""
    gaps = gap_rows(with_channel(events).where("us IS NOT NULL").select("channel", "line", "us"), longest_us)
    return gaps.groupBy("channel").agg(*_spread(F.col("gap") / SECOND))


def size_stats(events: DataFrame) -> DataFrame:
    return with_channel(events).where("size IS NOT NULL").groupBy("channel").agg(*_spread(F.col("size").cast("double")))


def rate_stats(events: DataFrame, window_us: int) -> DataFrame:
    """Rows per tumbling window that has any, then their spread per channel."""
    buckets = with_channel(events).where("us IS NOT NULL").groupBy("channel", F.floor(F.col("us") / window_us).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    return buckets.groupBy("channel").agg(*_spread(F.col("rows").cast("double")))


def channel_stats(events: DataFrame, window_us: int) -> DataFrame:
    """All three statistics in long form: channel, metric, n, mean, std."""
    parts = {"interarrival": interarrival_stats(events), "size": size_stats(events), "rate": rate_stats(events, window_us)}
    rows = [df.select("channel", F.lit(name).alias("metric"), "n", "mean", "std") for name, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# -- a baseline that grows ----------------------------------------------------------------

#: The parts of a baseline that later batches are merged into.
STATE = ("moments", "edges", "buckets", "services", "origin_ctl")


def _moments(values: Column) -> list[Column]:
    return [F.count(values).alias("n"), F.avg(values).alias("mean"), (F.coalesce(F.var_pop(values), F.lit(0.0)) * F.count(values)).alias("m2")]


def baseline_state(events: DataFrame, window_us: int, longest_us: int = 3600 * SECOND) -> dict[str, DataFrame]:
    """What must be kept of some rows for baselines of them and later ones.

    moments: n, mean and m2 (summed squares of the distance from the mean) of sizes and of the
    gaps within these rows, by channel and metric. edges: first and last known time of each channel,
    between which the gap to other rows lies. buckets: rows of each channel and window of time;
    a window may be filled by several batches. services: rows of each direction and service.
    """
    rows = with_channel(events)
    timed = rows.where("us IS NOT NULL").select("channel", "line", "us")
    sizes = rows.where("size IS NOT NULL").groupBy("channel").agg(*_moments(F.col("size").cast("double"))).withColumn("metric", F.lit("size"))
    gaps = gap_rows(timed, longest_us).groupBy("channel").agg(*_moments(F.col("gap") / SECOND)).withColumn("metric", F.lit("interarrival"))
    ends = [F.min("line").alias("first_line"), F.min_by("us", "line").alias("first_us"), F.max("line").alias("last_line"), F.max_by("us", "line").alias("last_us")]
    return {
        "moments": sizes.unionByName(gaps).select("channel", "metric", "n", "mean", "m2"),
        "edges": timed.groupBy("channel").agg(*ends),
        "buckets": timed.groupBy("channel", F.floor(F.col("us") / window_us).alias("bucket")).agg(F.count(F.lit(1)).alias("rows")),
        "services": events.groupBy(F.concat_ws("|", "direction", "service").alias("combo")).agg(F.count(F.lit(1)).alias("n")),
        "origin_ctl": origin_ctls(events),
    }


def _together(parts: Column) -> Column:
    """n, mean, m2 of the union of some parts (array of structs), by pairwise updates."""

    def both(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        mean = a["mean"] + apart * b["n"] / n
        return F.struct(n.alias("n"), mean.alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n).alias("m2"))

    return F.aggregate(F.slice(parts, 2, F.size(parts)), parts[0], both)


def merge_states(earlier: dict[str, DataFrame], later: dict[str, DataFrame], longest_us: int = 3600 * SECOND) -> dict[str, DataFrame]:
    """The state of two runs of rows, of which all lines of one come before those of the other.

    Neither run is read again: moments are merged by channel, and the gap between a channel's
    last row of the first run and its first of the second is added as a part of one value.
    """
    then = later["edges"].select("channel", F.col("first_us").alias("_next"))
    across = earlier["edges"].join(then, "channel").select("channel", (F.col("_next") - F.col("last_us")).alias("gap")).where(F.col("gap").between(0, longest_us))
    joint = across.select("channel", F.lit("interarrival").alias("metric"), F.lit(1).cast("bigint").alias("n"), (F.col("gap") / SECOND).alias("mean"), F.lit(0.0).alias("m2"))
    parts = earlier["moments"].unionByName(later["moments"]).unionByName(joint).where("n > 0")
    # three parts a key at most, so the lists are short
    merged = parts.groupBy("channel", "metric").agg(_together(F.array_sort(F.collect_list(F.struct("n", "mean", "m2")))).alias("m"))
    both = {name: earlier[name].unionByName(later[name]) for name in STATE}
    ends = [F.min("first_line").alias("first_line"), F.min_by("first_us", "first_line").alias("first_us"), F.max("last_line").alias("last_line"), F.max_by("last_us", "last_line").alias("last_us")]
    return {
        "moments": merged.select("channel", "metric", "m.n", "m.mean", "m.m2"),
        "edges": both["edges"].groupBy("channel").agg(*ends),
        "buckets": both["buckets"].groupBy("channel", "bucket").agg(F.sum("rows").alias("rows")),
        "services": both["services"].groupBy("combo").agg(F.sum("n").alias("n")),
        "origin_ctl": both["origin_ctl"].groupBy("origin").agg(
            F.sum("writes").alias("writes"), F.min("first_line").alias("first_line"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("ctls")))).alias("ctls")
        ),
    }


def state_tables(state: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """service_prob, channel_stats and origin_ctl of a baseline from its state."""
    spread = lambda df: df.select("channel", "metric", "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).otherwise(0.0).alias("std"))
    rates = state["buckets"].groupBy("channel").agg(*_moments(F.col("rows").cast("double"))).withColumn("metric", F.lit("rate"))
    services = state["services"].select("combo", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))
    return {"service_prob": services, "channel_stats": spread(state["moments"]).unionByName(spread(rates)), "origin_ctl": state["origin_ctl"]}


def origin_ctls(events: DataFrame) -> DataFrame:
    """Counters each origin wrote, and its number of writes."""
    writes = events.where(F.col("write") & (F.coalesce(F.col("origin"), F.lit("")) != ""))
    return writes.groupBy("origin").agg(F.count(F.lit(1)).alias("writes"), F.min("line").alias("first_line"), F.sort_array(F.collect_set("ctl")).alias("ctls"))


def most_common_origin(events: DataFrame) -> DataFrame:
    """The origin with most writes; the earliest of equals."""
    return origin_ctls(events).agg(F.max_by("origin", F.struct(F.col("writes"), -F.col("first_line"))).alias("allowed_origin"))


def model_tables(events: DataFrame, duration_us: int, window_us: int) -> dict[str, DataFrame]:
    """The baseline model as tables: meta, service_prob, channel_stats and origin_ctl."""
    train = materialize(training_prefix(events, duration_us), "training-prefix")
    meta = train.agg(F.count(F.lit(1)).alias("trained_rows"), F.min("train_start").alias("train_start"), F.max("train_end").alias("train_end"), F.lit(window_us).alias("window_us"))
    return {
        "meta": meta.crossJoin(F.broadcast(most_common_origin(train))),
        "service_prob": service_probability(train),
        "channel_stats": channel_stats(train, window_us),
        "origin_ctl": origin_ctls(train),
    }
