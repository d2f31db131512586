"""Statistical scores of events against a baseline.

What a channel has seen before a row (its last known time, the greatest one) are running values by
blocks of lines. ``live`` counts the rows of the channel, so far and within the trailing window:
rows leave the window in the order they came, so a row counts by the greatest time up to it. Rows
meet by spans of that time, each span with the one before as a halo, so a hot channel is as many
tasks as it has spans. A RANGE frame also holds later rows of the same time, which are
taken out again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .baseline import SECOND, with_channel
from .ordering import line_block, running_values

#: Fixed values of the scores.
Z_LEAST, ARRIVALS_LEAST, SIZES_LEAST, RATES_LEAST, RARE, UNKNOWN_BURST, STD_FLOOR = 3.0, 20, 20, 5, 0.005, 25, 0.5


def with_arrivals(events: DataFrame) -> DataFrame:
    """Add, for each channel, was_us (its last known time before the row) and top_us (its greatest time so far)."""
    rows = events if "channel" in events.columns else with_channel(events)
    line, us = F.col("line"), F.col("us")
    wanted = {"was_us": ("channel", "last", us, False), "top_us": ("channel", "max", us, True)}
    return running_values(rows, {"channel": F.col("channel")}, wanted, (line,), line, line_block())


def _live(rows: DataFrame, window_us: int) -> DataFrame:
    """Add live to rows with top_us."""
    timed = F.col("us").isNotNull()
    span = F.when(timed, F.floor(F.col("top_us") / window_us)).otherwise(line_block())
    own = rows.withColumns({"_timed": timed, "_span": span, "_own": F.lit(True)})
    halo = own.where("_timed").select("channel", "line", "us", "top_us", "_timed", (F.col("_span") + 1).alias("_span"), F.lit(False).alias("_own"))
    key = ("channel", "_timed", "_span")
    trailing = Window.partitionBy(*key).orderBy("top_us").rangeBetween(-window_us, 0)
    same = Window.partitionBy(*key, "top_us")
    live = F.count("us").over(trailing) - F.count("us").over(same) + F.row_number().over(same.orderBy("line"))
    counted = own.unionByName(halo, allowMissingColumns=True).withColumn("live", F.when(timed, live))
    return counted.where("_own").drop("_timed", "_span", "_own")


def live_rate(events: DataFrame, window_us: int) -> DataFrame:
    """Add live: rows of the channel in the trailing window, itself included, by arrival."""
    return _live(with_arrivals(events), window_us).drop("was_us", "top_us")


def _z(value: Column, mean: Column, std: Column) -> Column:
    return F.abs(value - mean) / std


def _points(z: Column, base: float, slope: float, cap: float) -> Column:
    return F.least(F.lit(cap), base + slope * (z - Z_LEAST))


def score(events: DataFrame, service_prob: DataFrame, channel_stats: DataFrame, window_us: int) -> DataFrame:
    """Add stat_score (0 to 100) and stat_reasons in rule order.

    The lookups have one row per channel and per service; Spark broadcasts them while they
    are small, and joins by key otherwise.
    """
    rows = _live(with_arrivals(events), window_us).withColumn("combo", F.concat_ws("|", "direction", "service"))
    rows = rows.withColumn("gap", (F.col("us") - F.col("was_us")) / SECOND).drop("was_us", "top_us")
    for metric in ("interarrival", "size", "rate"):
        own = channel_stats.where(F.col("metric") == metric).select("channel", *[F.col(c).alias(f"{metric}_{c}") for c in ("n", "mean", "std")])
        rows = rows.join(own, "channel", "left")
    rows = rows.join(service_prob.select("combo", "p"), "combo", "left")
    c = F.col
    gap_z = _z(c("gap"), c("interarrival_mean"), c("interarrival_std"))
    gap_on = (c("gap") >= 0) & (c("interarrival_n") >= ARRIVALS_LEAST) & (c("interarrival_std") > 0) & (gap_z >= Z_LEAST)
    size_z = _z(c("size"), c("size_mean"), c("size_std"))
    size_on = (c("size_n") >= SIZES_LEAST) & (c("size_std") > 0) & (size_z >= Z_LEAST)
    p = F.coalesce(c("p"), F.lit(0.0))
    rare_on = p <= RARE
    known_rate = F.coalesce(c("rate_n") >= RATES_LEAST, F.lit(False))
    rate_z = (c("live") - c("rate_mean")) / F.greatest(c("rate_std"), F.lit(STD_FLOOR))  # only a rise is a spike
    rate_on, burst_on = known_rate & (rate_z >= Z_LEAST), ~known_rate & (c("live") >= UNKNOWN_BURST)
    rules = [
        ("interarrival_outlier", gap_on, _points(gap_z, 5, 4, 25)),
        ("payload_size_outlier", size_on, _points(size_z, 4, 3, 20)),
        ("rare_service_combo", rare_on, F.least(F.lit(20.0), 4 + 3 * -F.log(F.greatest(p, F.lit(1e-9))))),
        ("rate_spike", rate_on, _points(rate_z, 5, 4, 25)),
        ("unknown_channel_rate_spike", burst_on, F.lit(12.0)),
    ]
    total = F.lit(0.0)
    for _, on, points in rules:
        total = total + F.when(on, points).otherwise(0.0)
    reasons = F.array_compact(F.array(*[F.when(on, F.lit(name)) for name, on, _ in rules]))
    return rows.withColumn("stat_score", F.least(F.lit(100.0), total)).withColumn("stat_reasons", reasons)
