"""Reports over attack events: one row per packet and object.

Columns: line, us, src, dst, origin, object, kind (of switchgear).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import entity_prefix
from . import ordering
from .ordering import dense_numbers, running_sums

SECOND = 1_000_000
MINUTE = 60 * SECOND


def packets(attacks: DataFrame) -> DataFrame:
    """One row per line, with its kinds and objects as sorted distinct lists."""
    return attacks.groupBy("line").agg(
        F.min("us").alias("us"), F.min("src").alias("src"), F.min("dst").alias("dst"), F.min("origin").alias("origin"),
        F.sort_array(F.collect_set("kind")).alias("kinds"), F.sort_array(F.collect_set("object")).alias("objects"),
    )


def _block(rows: DataFrame) -> Column:
    """Blocks of time that hold ordering.BLOCK rows on the average; rows without a time stand before all others."""
    return F.when(F.col("us").isNotNull(), ordering.time_block(rows)).otherwise(F.lit(-(1 << 62)) + ordering.line_block())


def sessions(rows: DataFrame, gap_us: int) -> DataFrame:
    """Number the runs of rows (us, line): a gap longer than gap_us begins a new one.

    Rows are ordered within blocks of time; only the blocks' last times and counts are ordered as a whole.
    """
    block = _block(rows)
    blocks = rows.withColumn("_at", block)
    ends = blocks.groupBy("_at").agg(F.max("us").alias("_end"))
    carried = ends.select("_at", F.max("_end").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)).alias("_prior"))
    previous = F.coalesce(F.lag("us").over(Window.partitionBy("_at").orderBy("us", "line")), F.col("_prior"))
    marked = blocks.join(carried, "_at").withColumn("_new", F.coalesce((F.col("us") - previous > gap_us).cast("int"), F.lit(1)))
    numbered = running_sums(marked.drop("_at", "_prior"), {"_new": "session"}, F.struct("us", "line"), block)
    return numbered.withColumn("session", F.col("session").cast("int")).drop("_new")


def campaigns(attacks: DataFrame, gap_us: int = 30 * MINUTE) -> DataFrame:
    """Runs of attack packets without a longer pause.

    All packets are one sequence, which is numbered by blocks of time.
    """
    numbered = sessions(attacks.select("line", "us").distinct(), gap_us)
    rows = attacks.join(numbered.select("line", "session"), "line")
    span = rows.groupBy("session").agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.countDistinct("line").alias("packets"), F.array_join(F.sort_array(F.collect_set("kind")), ", ").alias("kinds")
    )
    seconds = F.floor((F.col("end_us") - F.col("start_us")) / SECOND).cast("bigint")
    return span.select(F.col("session").alias("campaign"), "start_us", "end_us", seconds.alias("duration_sec"), "packets", "kinds")


def sequences(attacks: DataFrame, gap_us: int = 30 * MINUTE) -> DataFrame:
    """The packets of each campaign in order, with what they hit."""
    rows = sessions(packets(attacks), gap_us)
    return rows.select(F.col("session").alias("campaign"), "line", "us", F.array_join("kinds", " + ").alias("hit"))


def packet_summary(attacks: DataFrame) -> DataFrame:
    found = packets(attacks)
    rows = dense_numbers(found, "seq", F.struct("us", "line"), _block(found)).withColumn("seq", F.col("seq").cast("int"))
    return rows.select("seq", "line", "us", "src", "dst", "origin", F.array_join("objects", "; ").alias("objects"), F.array_join("kinds", ", ").alias("kinds"), F.size("objects").alias("n_objects"))


def kind_counts(attacks: DataFrame) -> DataFrame:
    """Packets per kind, most first."""
    return attacks.groupBy("kind").agg(F.countDistinct("line").alias("packets")).orderBy(F.desc("packets"), "kind")


def per_entity(attacks: DataFrame) -> DataFrame:
    """Packets per entity and kind, with the entity's total as a row of null kind."""
    rows = attacks.withColumn("entity", entity_prefix(F.col("object"))).where("entity <> ''")
    return rows.rollup("entity", "kind").agg(F.countDistinct("line").alias("packets"), F.grouping("kind").alias("total")).where("entity IS NOT NULL")


def hourly(attacks: DataFrame, width_us: int = 60 * MINUTE) -> DataFrame:
    return attacks.select("line", "us").distinct().groupBy((F.floor(F.col("us") / width_us) * width_us).cast("bigint").alias("hour_us")).agg(F.count(F.lit(1)).alias("packets"))


def temporal_summary(attacks: DataFrame) -> DataFrame:
    """Span, hours and days with attacks, and the busiest and quietest hour (the first of equals)."""
    hours = hourly(attacks)
    span = attacks.agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.countDistinct(F.floor(F.col("us") / (24 * 60 * MINUTE))).alias("days"))
    peak = hours.agg(
        F.count(F.lit(1)).alias("hours"), F.max_by("hour_us", F.struct("packets", -F.col("hour_us"))).alias("peak_us"), F.max("packets").alias("peak_packets"),
        F.min_by("hour_us", F.struct("packets", F.col("hour_us"))).alias("quiet_us"), F.min("packets").alias("quiet_packets"),
    )
    return span.crossJoin(F.broadcast(peak))


def agreement(model: DataFrame, rules: DataFrame) -> DataFrame:
    """Precision, recall and F1 of predictions (line, predicted) against rule hits (line, hit)."""
    both = model.join(rules, "line")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    p, h = F.col("predicted") == 1, F.col("hit") == 1
    counts = both.agg(n(p & h).alias("tp"), n(p & ~h).alias("fp"), n(~p & h).alias("fn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("tp", "fp", "fn", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def kind_summary(attacks: DataFrame) -> DataFrame:
    """Packets of each kind and the objects they named."""
    return attacks.groupBy("kind").agg(F.countDistinct("line").alias("packets"), F.array_join(F.sort_array(F.collect_set("object")), ", ").alias("objects"))
