"""Scenario labels: seeds are clustered by time gaps, clusters are widened, rows are labeled.

Event columns: line, us, grp (group key), seed (boolean).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordering
from .ordering import dense_numbers, group_places, running_by_key, time_block

SECOND = 1_000_000
#: Tags that make a row a seed.
SEED_TAGS = ("attack", "likely-attack", "failed-control", "masquerade", "malicious", "anomaly")


def seed_flag(tag: Column, tags: Sequence[str] = SEED_TAGS) -> Column:
    return F.lower(F.trim(F.coalesce(tag, F.lit("")))).isin(list(tags))


def clusters(events: DataFrame, gap_us: int = 30 * SECOND) -> DataFrame:
    """line, grp, pos, us, cluster of the seeds: a gap that is longer, or unknown, begins a cluster.

    pos is a row's place among all rows of its group.
    """
    placed = with_places(events)
    return cluster_seeds(placed, gap_us)


def with_places(events: DataFrame) -> DataFrame:
    return group_places(events, "pos")


def _by_place(place: Column) -> Column:
    return F.floor(place / ordering.BLOCK)


def cluster_seeds(placed: DataFrame, gap_us: int) -> DataFrame:
    seeds = placed.where("seed").select("line", "grp", "pos", "us")
    before = running_by_key(seeds, ["grp"], {"was": ("last", F.struct("us"))}, ["pos"], inclusive=False, block=_by_place(F.col("pos")))
    new = F.coalesce((F.col("us") - F.col("was.us") > gap_us).cast("bigint"), F.lit(1).cast("bigint"))
    return running_by_key(before, ["grp"], {"cluster": ("sum", new)}, ["pos"], block=_by_place(F.col("pos"))).drop("was")


def number_scenarios(seeds: DataFrame) -> DataFrame:
    """One row per cluster, numbered over groups and clusters."""
    spans = seeds.groupBy("grp", "cluster").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.count(F.lit(1)).alias("seeds"), F.min("line").alias("core_start"), F.max("line").alias("core_end"),
    )
    numbered = dense_numbers(spans, "no", F.struct("grp", "cluster"), F.struct(F.col("grp"), F.floor(F.col("cluster") / 1024)))
    return numbered.withColumn("no", F.col("no").cast("int")).withColumn("scenario", F.format_string("scenario_%04d", F.col("no")))


def _sweep(rows: DataFrame, spans: DataFrame, value: Column, low: Column, high: Column, block: Column) -> DataFrame:
    """(grp, line, cluster) of the rows whose value lies in the span of a cluster of their group.

    A group's clusters follow each other, so their spans begin and end in the same order: a row is
    within those that have begun up to it and haven't ended before it. Both are running counts
    over rows, beginnings and ends, so a span of any length costs two rows. ``block`` is
    a function of the column ``us``, which stands for the value here.
    """
    point = lambda df, at, kind, line: df.select("grp", at.alias("us"), F.lit(kind).alias("kind"), line.cast("bigint").alias("line"))
    none = F.lit(None)
    every = point(rows, value, 1, F.col("line")).unionByName(point(spans, low, 0, none)).unionByName(point(spans, high, 2, none))
    count = lambda kind: ("sum", (F.col("kind") == kind).cast("bigint"))
    met = running_by_key(every, ["grp"], {"begun": count(0), "ended": count(2)}, ["us", "kind", "line"], block=block)
    inside = met.where((F.col("kind") == 1) & (F.col("begun") > F.col("ended")))
    return inside.select("grp", "line", F.explode(F.sequence(F.col("ended") + 1, F.col("begun"))).alias("cluster"))


def members(placed: DataFrame, spans: DataFrame, places: int = 4, around_us: int = 15 * SECOND) -> DataFrame:
    """(no, line) of the rows within so many places, or so much time, of a cluster: one sweep for each."""
    by_place = _sweep(placed, spans, F.col("pos"), F.col("first_pos") - places, F.col("last_pos") + places, _by_place(F.col("us")))
    timed = placed.where("us IS NOT NULL")
    by_time = _sweep(timed, spans.where("first_us IS NOT NULL"), F.col("us"), F.col("first_us") - around_us, F.col("last_us") + around_us, time_block(timed))
    own = spans.select(F.col("grp").alias("_grp"), F.col("cluster").alias("_cluster"), "no")
    either = by_place.union(by_time).distinct()
    return either.join(own, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("cluster") == F.col("_cluster"))).select("no", "line")


def label(events: DataFrame, gap_us: int = 30 * SECOND, places: int = 4, around_us: int = 15 * SECOND) -> tuple[DataFrame, DataFrame]:
    """(labels, summary).

    A row in several scenarios belongs to the last; it is core there if it is one of its own
    seeds, else context. The summary counts members before that.
    """
    placed = with_places(events)
    seeds = cluster_seeds(placed, gap_us)
    spans = number_scenarios(seeds)
    inside = members(placed, spans, places, around_us)
    own = seeds.join(spans.select("grp", "cluster", "no"), ["grp", "cluster"]).select("line", F.col("no").alias("seed_no"))
    last = inside.groupBy("line").agg(F.max("no").alias("no"))
    labels = (
        events.join(last, "line", "left")
        .join(own, "line", "left")
        .join(spans.select("no", "scenario"), "no", "left")
        .withColumn("role", F.when(F.col("no").isNull(), "normal").when(F.col("seed_no") == F.col("no"), "core").otherwise("context"))
        .withColumn("is_anomaly", (F.col("no").isNotNull()).cast("int"))
    )
    within = inside.join(events.select("line", "us"), "line").groupBy("no").agg(
        F.count(F.lit(1)).alias("rows"), F.min("line").alias("window_start"), F.max("line").alias("window_end"), F.min("us").alias("start_us"), F.max("us").alias("end_us")
    )
    summary = spans.join(within, "no").select(
        "scenario", "grp", "seeds", "rows", "core_start", "core_end", "window_start", "window_end", "start_us", "end_us",
        ((F.col("end_us") - F.col("start_us")) / SECOND).alias("duration_sec"),
    )
    return labels.select("line", "grp", "us", "seed", "is_anomaly", "scenario", "role"), summary
