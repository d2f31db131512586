"""Causal history features of an event log.

Event columns: line, us, stream, src, dst, service, action, object, origin (text, "" for
none), ctl, invoke, seq (bigint), size, final_tag, is_control. Order is time, then line.

A feature over a key that is blank is 0 there: such rows are left out of the key's running values.
Keys of any size are spread over blocks of time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import actor, calendar, finite, guarded_ratio, joint_key
from .ordering import Blocks, exact_key, running_totals, running_values, time_blocks

SECOND = 1_000_000
NONE = -1
START, NO_OBJECT = "<START>", "<NO_OBJECT>"


def _order():
    return (F.col("us").asc_nulls_last(), F.col("line"))


def _at() -> Column:
    return F.struct(F.coalesce(F.col("us"), F.lit((1 << 63) - 1)), F.col("line"))


def dedup_alerts(alerts: DataFrame) -> DataFrame:
    """One alert per line: a packet before a synthetic one, then the first by position."""
    rank = F.when(F.col("event_source") == "packet", 0).when(F.col("event_source") == "synthetic", 1).otherwise(2)
    w = Window.partitionBy("line").orderBy(rank, "pos")
    return alerts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def join_alerts(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Events that have an alert, with its columns. Columns of the events win clashes."""
    own = [c for c in alerts.columns if c == "line" or c not in events.columns]
    return events.join(dedup_alerts(alerts).select(*own), "line")


def join_labels(events: DataFrame, labels: DataFrame, value: str = "label") -> DataFrame:
    """Left join of labels (line, pos, label); of repeated lines the last counts."""
    last = labels.groupBy("line").agg(F.max_by(value, "pos").alias(value))
    return events.join(last, "line", "left")


def category_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add a 0-based code by sorted distinct value. Only the distinct values are numbered."""
    values = df.select(column).distinct().where(F.col(column).isNotNull())
    codes = values.select(column, (F.row_number().over(Window.orderBy(column)) - 1).alias(out))
    return df.join(codes, column, "left").withColumn(out, F.coalesce(F.col(out), F.lit(-1)))


def with_keys(events: DataFrame) -> DataFrame:
    """Presence flags and the composite keys of the history windows."""
    c = F.col
    flag = lambda x: x.cast("int")
    rows = events.withColumns(
        {
            "has_origin": flag(c("origin") != ""), "has_object": flag(c("object") != ""), "has_action": flag(c("action") != ""),
            "has_invoke": flag(c("invoke").isNotNull()), "has_ctl": flag(c("ctl").isNotNull()), "has_seq": flag(c("seq").isNotNull()),
            "actor": actor(c("src"), c("origin")),
        }
    )
    return rows.withColumns(
        {
            "actor_object": joint_key(c("actor"), c("object")), "actor_action": joint_key(c("actor"), c("action")),
            "object_action": joint_key(c("object"), c("action")), "origin_object": joint_key(c("origin"), c("object")),
            "actor_object_action": joint_key(c("actor"), c("object"), c("action")), "source_origin": c("actor"),
        }
    )


def prior_counts(rows: DataFrame, block: Blocks | None = None) -> DataFrame:
    """Rows before this one with the same key, for eleven keys; a blank key has none.

    All keys share one shuffle by spans of time, so hot keys (there are few actions) are
    spread as widely as others.
    """
    always, on = (lambda c: F.col(c)), (lambda c, flag: F.when(F.col(flag) == 1, F.col(c)))
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    keys = {
        "actor_prior": always("actor"), "source_origin_prior": on("source_origin", "has_origin"), "src_prior": always("src"),
        "origin_prior": on("origin", "has_origin"), "object_prior": on("object", "has_object"), "action_prior": on("action", "has_action"),
        "actor_object_prior": filled("actor_object"), "actor_action_prior": filled("actor_action"), "object_action_prior": filled("object_action"),
        "origin_object_prior": filled("origin_object"), "actor_object_action_prior": filled("actor_object_action"),
    }
    found = running_totals(rows, {n: (k, F.lit(1)) for n, k in keys.items()}, _order(), _at(), time_blocks(rows) if block is None else block)
    return found.withColumns({n: F.coalesce(F.col(n) - 1, F.lit(0)) for n in keys})


def prior_distinct(rows: DataFrame, wanted: dict[str, tuple[str, str, Column]], block: Blocks | None = None) -> DataFrame:
    """name -> (key, other, mask): distinct values of ``other`` among the key's earlier rows.

    First sightings of pairs are flagged, then summed by key; a null is a value like "".
    """
    block = time_blocks(rows) if block is None else block
    keys = {n: F.when(mask, F.coalesce(F.col(key), F.lit(""))) for n, (key, _, mask) in wanted.items()}
    pairs = {f"_seen_{n}": (F.concat(F.length(k).cast("string"), F.lit(":"), k, F.coalesce(F.col(wanted[n][1]), F.lit(""))), F.lit(1)) for n, k in keys.items()}
    first = lambda n: F.coalesce((F.col(f"_seen_{n}") == 1).cast("int"), F.lit(0))
    found = running_totals(running_totals(rows, pairs, _order(), _at(), block), {n: (k, first(n)) for n, k in keys.items()}, _order(), _at(), block)
    return found.withColumns({n: F.coalesce(F.col(n) - first(n), F.lit(0)) for n in wanted}).drop(*pairs)


def novelty(rows: DataFrame) -> DataFrame:
    """Flags for known keys that meet an unknown partner."""
    c = F.col
    flag = lambda x: x.cast("int")
    rows = rows.withColumn("origin_new_src", flag((c("origin_prior") > 0) & (c("source_origin_prior") == 0)))
    return rows.withColumns(
        {
            "src_new_origin": flag((c("src_prior") > 0) & (c("source_origin_prior") == 0) & (c("has_origin") == 1)),
            "object_new_actor": flag((c("object_prior") > 0) & (c("actor_object_prior") == 0) & (c("has_object") == 1)),
            "action_new_actor": flag((c("action_prior") > 0) & (c("actor_action_prior") == 0) & (c("has_action") == 1)),
            "source_origin_consistent": flag((c("has_origin") == 1) & (c("origin_new_src") == 0)),
        }
    )


def transitions(rows: DataFrame, block: Blocks | None = None) -> DataFrame:
    """Index, previous values and times since the previous row, per stream and per object."""
    c, on_object = F.col, F.col("has_object") == 1
    keys = {
        "stream": exact_key(c("stream")), "object": F.when(on_object, c("object")),
        "actor_object": F.when(c("actor_object") != "", c("actor_object")), "origin": F.when(c("has_origin") == 1, c("source_origin")),
    }
    last = lambda key, *of: (key, "last", F.struct(*of), False)
    wanted = {
        "_rows": ("stream", "sum", F.lit(1).cast("bigint"), True), "_stream": last("stream", "service", "us"), "_object": last("object", "action", "actor", "us"),
        "_pair": last("actor_object", "us"), "_origin": last("origin", "us"),
    }
    rows = running_values(rows, keys, wanted, _order(), _at(), time_blocks(rows) if block is None else block)
    was = lambda of, field: F.coalesce(c(of)[field], F.lit(START))
    elapsed = lambda of: F.coalesce((c("us") - c(of)["us"]) / SECOND, F.lit(0.0))
    rows = rows.withColumns(
        {
            "stream_index": c("_rows") - 1,
            "prev_service": was("_stream", "service"),
            "since_stream": elapsed("_stream"),
            "prev_action_object": F.when(on_object, was("_object", "action")).otherwise(""),
            "prev_actor_object": F.when(on_object, was("_object", "actor")).otherwise(""),
            "since_actor_object": elapsed("_pair"),
            "since_object": elapsed("_object"),
            "since_origin_source": elapsed("_origin"),
        }
    ).drop(*wanted)
    changed = on_object & (F.col("object_prior") > 0) & ~F.col("prev_actor_object").isin("", START) & (F.col("prev_actor_object") != F.col("actor"))
    return rows.withColumns(
        {
            "service_transition": F.concat("prev_service", F.lit("->"), "service"),
            "action_transition": F.when(on_object, F.concat("prev_action_object", F.lit("->"), "action")).otherwise(NO_OBJECT),
            "actor_changed": changed.cast("int"),
        }
    )


def counters(rows: DataFrame, block: Blocks | None = None) -> DataFrame:
    """Reuse, change and fall of invoke ids, report sequences, counters and payload sizes.

    Missing numbers are -1 and take part in changes along a stream.
    """
    c = F.col
    block = time_blocks(rows) if block is None else block
    rows = rows.withColumns({"invoke_value": F.coalesce(F.when(F.abs("invoke") <= 1_000_000_000, c("invoke")), F.lit(NONE)), "ctl_value": F.coalesce("ctl", F.lit(NONE)), "seq_value": F.coalesce("seq", F.lit(NONE))})
    pair = (c("actor_object") != "") & (c("has_ctl") == 1)
    keys = {
        "stream": exact_key(c("stream")), "pair": F.when(pair, c("actor_object")), "invoke": F.when(c("has_invoke") == 1, exact_key(c("stream"), c("invoke"))),
        "seq": F.when(c("has_seq") == 1, exact_key(c("stream"), c("seq_value"))), "ctl": F.when(pair, exact_key(c("actor_object"), c("ctl_value"))),
    }
    uses = {f"_{k}_uses": (k, "sum", F.lit(1).cast("bigint"), True) for k in ("invoke", "seq", "ctl")}
    was = {"_was": ("stream", "last", F.struct("invoke_value", "ctl_value", "seq_value", "size"), False), "_was_ctl": ("pair", "last", c("ctl_value"), False)}
    rows = running_values(rows, keys, uses | was, _order(), _at(), block)
    change = lambda col: F.coalesce(c(col) - c("_was")[col], F.lit(0))
    flag = lambda on: F.coalesce(on, F.lit(False)).cast("int")
    return rows.withColumns(
        {
            "invoke_reused": flag(c("_invoke_uses") > 1),
            "invoke_delta": change("invoke_value"),
            "ctl_delta": change("ctl_value"),
            "seq_delta": change("seq_value"),
            "seq_reused": flag(c("_seq_uses") > 1),
            "seq_regression": flag((c("has_seq") == 1) & (c("seq_value") < c("_was")["seq_value"])),
            "ctl_delta_actor_object": F.coalesce(c("ctl_value") - c("_was_ctl"), F.lit(0)),
            "ctl_reused": flag(c("_ctl_uses") > 1),
            "ctl_regression": flag(c("ctl_value") < c("_was_ctl")),
            "size_delta": change("size"),
        }
    ).drop(*uses, *was)


def time_z(rows: DataFrame) -> DataFrame:
    """Each gap against the mean and spread of its whole stream (this one looks ahead)."""
    whole = rows.groupBy("stream").agg(F.avg("since_stream").alias("_mean"), F.coalesce(F.stddev_samp("since_stream"), F.lit(0.0)).alias("_std"))
    return rows.join(whole, "stream").withColumn("time_z", (F.col("since_stream") - F.col("_mean")) / (F.col("_std") + 1e-6)).drop("_mean", "_std")


def ratios(rows: DataFrame) -> DataFrame:
    c = F.col
    return rows.withColumns(
        {
            "actor_object_ratio": guarded_ratio(c("actor_object_prior"), c("object_prior")),
            "actor_action_ratio": guarded_ratio(c("actor_action_prior"), c("actor_prior")),
            "origin_object_ratio": guarded_ratio(c("origin_object_prior"), c("object_prior")),
            "actor_object_action_ratio": guarded_ratio(c("actor_object_action_prior"), c("actor_object_prior")),
        }
    )


def target(rows: DataFrame, label: str | None = None, fall_back: bool = True) -> DataFrame:
    """is_anomaly: the label, else (if wanted) whether the detector's tag isn't normal."""
    rule = (F.col("final_tag") != "normal").cast("int")
    found = rule if label is None else F.coalesce(F.col(label).cast("int"), rule) if fall_back else F.col(label).cast("int")
    return rows.withColumn("heuristic_is_anomaly", rule).withColumn("is_anomaly", found)


def features(events: DataFrame) -> DataFrame:
    """All history features. Those over keys share a shuffle by spans of time, one for each kind."""
    rows = calendar(with_keys(events))
    block = time_blocks(events)
    rows = prior_counts(rows, block)
    rows = prior_distinct(rows, {"object_actors_prior": ("object", "actor", F.col("has_object") == 1), "origin_srcs_prior": ("origin", "src", F.col("has_origin") == 1)}, block)
    return ratios(time_z(counters(transitions(novelty(rows), block), block)))


def select_features(rows: DataFrame, keep: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """The final table: keys as they are, numbers finite with 0 for missing."""
    return rows.select(*keep, *[finite(F.col(c).cast("double")).alias(c) for c in numeric])
