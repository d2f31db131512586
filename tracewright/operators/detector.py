"""The whole detector: protocol-state rules and statistics over an event log, as alerts.

Rows up to the end of the training span feed every state (pairs, counters, rates, answers
to reports), but they are neither scored nor shown, and their writes make no origin known
unless ``trained`` asks for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import fingerprint
from ..session import materialize
from . import protocol, statistical

SECOND = 1_000_000


@dataclass(frozen=True)
class Options:
    """Bounds of the rules, in microseconds where they are times."""

    window_us: int = 30 * SECOND
    pair_us: int = 15 * SECOND
    match_us: int = 20 * SECOND
    reset_us: int = 120 * SECOND
    quiet_us: int = 30 * SECOND
    memory: int = protocol.INVOKE_MEMORY
    tolerance: int = 2
    strict: bool = False
    sequence: bool = False
    duplicates: bool = False
    trained: bool = False
    include_training: bool = False
    emit_all: bool = False


ALERT = (
    "event_source", "line", "us", "direction", "service", "src", "dst", "stream", "invoke", "object", "action", "ctl", "origin",
    "report_seq", "report_origins", "report_ctls", "refs", "flags", "protocol_tag", "protocol_reasons", "stat_reasons",
    "protocol_score", "stat_score", "anomaly_score", "final_tag", "suppressed",
)


def detect(events: DataFrame, model: dict[str, DataFrame], payloads: DataFrame | None = None, options: Options | None = None) -> DataFrame:
    """Alerts, one a row, and one for each select left without its operate.

    events: the columns of the rule modules, and last_appl_error (boolean) or the text of
    variables if known. payloads: line, report, refs, identities, flags, entries, report_name,
    report_seq (of normalize.payload_values); only reports have a number. ``duplicates``
    adds to ``sequence`` the rule on repeated numbers.
    """
    o = options or Options()
    meta = model["meta"].select("train_end")
    on = F.lit(True) if o.include_training else F.col("us").isNull() | F.col("train_end").isNull() | (F.col("us") > F.col("train_end"))
    rows = events.crossJoin(F.broadcast(meta)).withColumn("detected", on).drop("train_end")
    if "last_appl_error" not in rows.columns and "variables" in rows.columns:
        rows = rows.withColumn("last_appl_error", protocol.last_appl_error(F.col("variables")))
    if payloads is not None and "report" in payloads.columns:
        payloads = payloads.withColumn("report_seq", F.when(F.col("report"), F.col("report_seq"))).drop("report")
    writes = rows.where("write").withColumn("learned", F.col("detected"))
    learned, trained = writes.where("learned"), model["origin_ctl"] if o.trained else None
    rules = [protocol.write_rules(writes, o.pair_us, o.memory), protocol.origin_rule(learned)]
    if payloads is not None:
        # four uses: trees are walked once. Tables of as many rows as the log are never broadcast, however small their files are
        payloads = at = materialize(payloads.join(rows.select("line", "us", "src", "dst").hint("merge"), "line"), "payloads")
        names = at.select("line", F.explode("identities").alias("identity"))
        rules.append(protocol.unknown_identities(names, learned, "unexpected_octet_identity_in_control_context", trained))
        each = at.select("line", "us", "src", "dst", F.posexplode("entries").alias("pos", "e")).select("line", "pos", "us", "src", "dst", "e.origin", "e.ctl")
        if o.sequence:
            scope = F.when(F.size("refs") > 0, F.array_join("refs", ";")).otherwise("*")
            name = F.when(F.col("report_name") != "", F.col("report_name")).otherwise("RPT")
            keyed = at.where("report_seq IS NOT NULL").select("line", "us", F.col("report_seq").alias("seq"), F.explode("entries").alias("e"), "src", "dst", name.alias("name"), scope.alias("scope"))
            origin = F.when(F.coalesce("e.origin", F.lit("")) != "", F.col("e.origin")).otherwise(protocol.UNKNOWN)
            keyed = keyed.select("line", "us", "seq", F.concat_ws("|", "src", "dst", "name", origin, "scope").alias("key")).distinct()
            numbers = protocol.report_sequence(keyed, o.reset_us, o.tolerance)
            rules.append(numbers if o.duplicates else numbers.drop("report_seq_duplicate"))
        rules.append(protocol.report_rules(each, writes, o.match_us, o.strict))
    scored = statistical.score(rows, model["service_prob"], model["channel_stats"], o.window_us)
    found = protocol.with_scores(protocol.with_reasons(scored.where("detected"), rules))
    found = with_payloads(found, payloads)
    reasons = F.concat("protocol_reasons", "stat_reasons")
    listed = [F.array_join(F.col(c).cast("array<string>"), ";") for c in ("report_origins", "report_ctls")]
    key = fingerprint(F.col("final_tag"), F.col("src"), F.col("dst"), F.col("service"), reasons, *listed, F.col("report_seq"), F.array_join("refs", ";"), F.array_join("flags", ";"))
    found = found.withColumn("event_source", F.lit("packet")).withColumn("fingerprint", key)
    # rows that aren't alerts never take part in suppression
    found = materialize(found.select(*[c for c in ALERT if c != "suppressed"], "fingerprint"), "detector")
    alerts = protocol.suppress(found.where(F.col("final_tag") != protocol.TAGS[0]), o.quiet_us)
    if o.emit_all:
        alerts = alerts.unionByName(found.where(F.col("final_tag") == protocol.TAGS[0]).withColumn("suppressed", F.lit(False)))
    packets = protocol.emitted(alerts, o.emit_all).select(*ALERT)
    return packets.unionByName(synthetic(writes, o), allowMissingColumns=True)


def with_payloads(rows: DataFrame, payloads: DataFrame | None) -> DataFrame:
    none = F.array().cast("array<string>")
    if payloads is None:
        return rows.withColumns({"report_seq": F.lit(None).cast("bigint"), "report_origins": none, "report_ctls": F.array().cast("array<bigint>"), "refs": none, "flags": none})
    said = payloads.select(
        "line", "report_seq", "refs", "flags",
        F.array_sort(F.array_distinct(F.filter(F.transform("entries", lambda e: e["origin"]), lambda x: x != ""))).alias("report_origins"),
        F.array_sort(F.array_distinct(F.filter(F.transform("entries", lambda e: e["ctl"]), lambda x: x.isNotNull()))).alias("report_ctls"),
    )
    joined = rows.drop("report_seq").join(said.hint("merge"), "line", "left")
    return joined.withColumns({"refs": F.coalesce("refs", none), "flags": F.coalesce("flags", none), "report_origins": F.coalesce("report_origins", none), "report_ctls": F.coalesce("report_ctls", F.array().cast("array<bigint>"))})


def synthetic(writes: DataFrame, options: Options) -> DataFrame:
    """Selects still armed at the end, suppressed among themselves like other alerts."""
    left = protocol.pending_selects(writes)
    key = F.concat_ws("|", "final_tag", "src", "dst", "service", "reason", "object", "action", F.coalesce(F.col("ctl").cast("string"), F.lit("")), F.coalesce("origin", F.lit("")))
    found = protocol.suppress(left.withColumn("fingerprint", key), options.quiet_us)
    found = found if options.emit_all else found.where("NOT suppressed")
    score = F.col("protocol_score")
    return found.select(
        "event_source", "line", "us", "service", "src", "dst", "stream", "object", "action", "ctl", "origin", F.lit(protocol.TAGS[1]).alias("protocol_tag"), F.array("reason").alias("protocol_reasons"),
        F.array().cast("array<string>").alias("stat_reasons"), "protocol_score", F.lit(0.0).alias("stat_score"), score.alias("anomaly_score"), "final_tag", "suppressed",
    )
