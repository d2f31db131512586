"""Parts of the detector as Structured Streaming queries over event time.

Keys are the same as in the batch form. A channel's open window, and an armed select, are state
until the watermark has passed them: a window is evicted by the engine, and a select ends as the
alert of one that nothing operated, by a timer at its time + ``keep_us``. So state is bounded
by the span from the watermark's lateness and ``keep_us``, not by the stream's age. Rows that
come later than the watermark allows are dropped by the count, and paired as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalar import channel_key, micros
from ..session import ship

DAY = "1 day"


def channel_rates(stream: DataFrame, window: str = DAY, late: str = DAY) -> DataFrame:
    """Rows per channel and tumbling window. stream: ts (timestamp), src, dst, direction, service."""
    keyed = stream.withColumn("channel", channel_key(F.col("src"), F.col("dst"), F.col("direction"), F.col("service")))
    return keyed.withWatermark("ts", late).groupBy("channel", F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("rows"))


PENDING, LONELY, LATE = "sbow_without_matching_oper", "oper_without_matching_sbow", "late_oper"
SECOND = 1_000_000


def paired_steps(stream: DataFrame, timeout_us: int = 15 * SECOND, keep_us: int = 3600 * SECOND, late: str = DAY) -> DataFrame:
    """line, reason, delay_us of the selects and operates that don't pair as they should.

    stream: line, ts (timestamp), action, src, dst, object, ctl. An operate uses up its key's
    armed select: without one it is LONELY, after more than timeout_us LATE. A select arms its key in
    the place of one before it. One that isn't used within keep_us is PENDING, at once when a later
    step of its key shows it, else when the watermark passes that time; its state is gone then.
    Rows of a key within one batch are taken in order of line; batches are in order of time.
    """
    ship(stream.sparkSession)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        armed, found = (state.get if state.exists else None), []
        if state.hasTimedOut:
            found.append((armed[0], PENDING, None))
            armed = None
        else:
            rows = pd.concat(list(parts)).sort_values("line")
            for line, us, action in zip(rows["line"].tolist(), rows["us"].tolist(), rows["action"], strict=True):
                us = None if pd.isna(us) else int(us)
                delay = us - armed[1] if armed and None not in (us, armed[1]) else None
                if delay is not None and delay > keep_us:
                    found.append((armed[0], PENDING, None))
                    armed = None
                if action == "SBOw":
                    armed = (line, us)
                    continue
                if armed is None:
                    found.append((line, LONELY, None))
                elif delay is not None and delay > timeout_us:
                    found.append((line, LATE, delay))
                armed = None
        if armed:
            watermark = state.getCurrentWatermarkMs()
            ends = (watermark if armed[1] is None else armed[1] // 1000) + keep_us // 1000
            if ends <= watermark:
                found.append((armed[0], PENDING, None))
                armed = None
            else:
                state.update(armed)
                state.setTimeoutTimestamp(ends)
        if not armed and state.exists:
            state.remove()
        columns = zip(*found, strict=True) if found else ((), (), ())
        yield pd.DataFrame({n: pd.Series(list(c), dtype=t) for n, c, t in zip(("line", "reason", "delay_us"), columns, ("Int64", "object", "Int64"), strict=True)})

    timed = stream.withWatermark("ts", late).where(F.col("action").isin("SBOw", "Oper")).withColumn("us", micros(F.col("ts")))
    kinds = "line long, reason string, delay_us long"
    return timed.groupBy("src", "dst", "object", "ctl").applyInPandasWithState(step, kinds, "line long, us long", "append", GroupStateTimeout.EventTimeTimeout)


def unpaired_operates(stream: DataFrame, **options) -> DataFrame:
    """Lines of operates whose key has no armed select."""
    return paired_steps(stream, **options).where(F.col("reason") == LONELY).select("line")


def _read(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream, in the roles of the batch queries."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    # a stream reads folders; the one file is picked by its name
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if "." in name else spark.readStream.schema(schema).parquet(path)
    k, kind = F.get_json_object("props", "$.k").cast("bigint"), F.col("event_type")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    return rows.select(
        F.col("event_id").alias("line"), F.col("ts").cast("timestamp").alias("ts"), text("u", F.col("user_id") % 20).alias("src"), text("s", F.col("user_id") % 3).alias("dst"),
        F.when(kind.isin("click", "purchase", "signup"), "REQUEST").otherwise("RESPONSE").alias("direction"), kind.alias("service"),
        F.when(kind == "click", "SBOw").when(kind == "purchase", "Oper").otherwise("").alias("action"), text("o", k % 10).alias("object"), k.alias("ctl"),
    )


def _drain(df: DataFrame, path: str, mode: str) -> DataFrame:
    """Run a stream over all there is now, into a table. In update mode a row has its batch's number."""

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    df.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(f"{path}/out")


def replay_channel_rates(spark: SparkSession, path: str, out: str) -> DataFrame:
    """The last count of each window; windows that the watermark has passed leave the state."""
    counts = _drain(channel_rates(_read(spark, path)), out, "update")
    last = counts.groupBy("channel", F.col("w.start").alias("start")).agg(F.max_by("rows", "batch").alias("rows"))
    return last.select("channel", micros(F.col("start")).alias("start_us"), "rows")


def replay_paired(spark: SparkSession, path: str, out: str, timeout_us: int, keep_us: int) -> DataFrame:
    """paired_steps over a table, and past its end: one more step, of no key and long after, moves
    the watermark over all selects that are still armed."""
    steps = _read(spark, path).select("line", "ts", "action", "src", "dst", "object", "ctl")
    end = spark.read.parquet(path).agg((F.max(F.col("ts").cast("timestamp")) + F.expr(f"INTERVAL {2 * keep_us // SECOND} SECONDS")).alias("ts"))
    close = end.select(F.lit(None).cast("long").alias("line"), "ts", F.lit("Oper").alias("action"), *[F.lit(None).cast(t).alias(n) for n, t in steps.dtypes[3:]])
    close.write.parquet(f"{out}/close")
    both = steps.unionByName(spark.readStream.schema(close.schema).parquet(f"{out}/close"))
    return _drain(paired_steps(both, timeout_us, keep_us), out, "append").where("line IS NOT NULL").select("line", "reason", "delay_us")


def replay_unpaired(spark: SparkSession, path: str, out: str) -> DataFrame:
    return _drain(unpaired_operates(_read(spark, path), keep_us=10**15), out, "append").select("line")
