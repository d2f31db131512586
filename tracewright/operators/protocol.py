"""Protocol-state rules over an event log as keyed windows.

Event columns: line, us, src, dst, direction, service, stream, action, object, origin, ctl,
invoke (bigint), write and report (boolean). Every window orders by line, which is the order
of the capture; rules over writes share one shuffle by blocks of lines, whatever their keys.

A rule adds a boolean column named after its reason. Rules over writes are computed on the
writes alone, so a key never holds rows that can't take part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import carried, ordering
from .ordering import exact_key, running_values

SECOND = 1_000_000
UNKNOWN = "UNKNOWN"
#: Severity of tags, their base scores, and the tags' names by severity.
TAGS = ("normal", "failed-control", "likely-attack")
BASE_SCORE = (0.0, 45.0, 70.0)
FAILED_FROM, LIKELY_FROM, PENDING_SCORE = 40.0, 70.0, 45.0
ERROR_TOKEN = "LastApplError"
#: Fixed value: invoke ids a channel remembers.
INVOKE_MEMORY = 5000

#: Write rules in the order in which their reasons are given, with their severity.
WRITE_RULES = {
    "last_appl_error": 1,
    "oper_without_matching_sbow": 2,
    "late_oper": 1,
    "missing_invoke_id_on_write": 1,
    "write_invoke_id_regression": 1,
    "duplicate_write_invoke_id": 2,
    "write_ctlnum_regression": 1,
    "write_ctlnum_reused_across_objects": 2,
    "write_ctlnum_reused_excessively": 1,
    "unexpected_origin_identifier": 2,
    "unexpected_octet_identity_in_control_context": 2,
    "report_seq_regression": 1,
    "report_seq_duplicate": 1,
    "report_origin_not_seen_in_writes": 2,
    "report_ctlnum_regression": 1,
    "report_ctlnum_below_write_baseline": 1,
    "report_ctlnum_not_seen_in_writes": 1,
    "report_without_matching_write": 1,
}


def _origin_key() -> Column:
    return F.when(F.coalesce(F.col("origin"), F.lit("")) != "", F.col("origin")).otherwise(UNKNOWN)


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _along(writes: DataFrame, *parts: tuple[dict, dict]) -> DataFrame:
    """Running values of all parts (their keys and what is wanted of them) in one shuffle."""
    keys, wanted = {}, {}
    for own_keys, own_wanted in parts:
        keys |= own_keys
        wanted |= own_wanted
    return running_values(writes, keys, wanted, (F.col("line"),), F.col("line"), ordering.line_block())


# -- select and operate -----------------------------------------------------------------

PAIR = ("src", "dst", "object", "ctl")


def _steps() -> tuple[dict, dict]:
    step = F.col("action").isin("SBOw", "Oper")
    return {"pair": F.when(step, exact_key(*map(F.col, PAIR)))}, {"_step": ("pair", "last", F.struct("action", "us"), False)}


def _pair_columns(timeout_us: int) -> dict[str, Column]:
    operate, selected = F.col("action") == "Oper", _no(F.col("_step.action") == "SBOw")
    delay = F.when(operate & selected, F.col("us") - F.col("_step.us"))
    return {"oper_without_matching_sbow": _no(operate & ~selected), "late_oper": _no(delay > timeout_us), "delay_us": delay}


def pairing(writes: DataFrame, timeout_us: int = 15 * SECOND) -> DataFrame:
    """An operate needs a select just before it on its key, which it uses up.

    Adds oper_without_matching_sbow, late_oper, delay_us and pending (a select that nothing
    follows on its key). A select that another select follows is replaced.
    """
    steps = writes.where(F.col("action").isin("SBOw", "Oper"))
    found = _along(steps.select("line", *PAIR, "action", "us"), _steps()).select("line", *[c.alias(n) for n, c in _pair_columns(timeout_us).items()])
    return found.join(_armed(writes, "line").withColumn("pending", F.lit(True)).hint("merge"), "line", "left").withColumn("pending", _no(F.col("pending")))


def _armed(writes: DataFrame, *columns: str) -> DataFrame:
    """Selects that nothing follows on their key: its last step, found by partial aggregation."""
    steps = writes.where(F.col("action").isin("SBOw", "Oper"))
    last = steps.groupBy(*[F.col(c).alias(f"_{c}") for c in PAIR]).agg(F.max_by(F.struct("action", *columns), "line").alias("w"))
    return last.where("w.action = 'SBOw'").select(*[F.col(f"w.{c}").alias(c) for c in columns])


def pending_selects(writes: DataFrame) -> DataFrame:
    """A synthetic alert for each select still armed at the end."""
    own = ("line", "us", "src", "dst", "stream", "service", "object", "ctl", "origin")
    return _armed(writes, *own).select(
        F.lit("synthetic").alias("event_source"), "line", "us", "src", "dst", "stream", "service", "object", F.lit("SBOw").alias("action"), "ctl", "origin",
        F.lit("sbow_without_matching_oper").alias("reason"), F.lit(PENDING_SCORE).alias("protocol_score"), F.lit(TAGS[1]).alias("final_tag"),
    )


def last_appl_error(variables: Column) -> Column:
    """Whether the variables' text carries the token of an application error."""
    return F.coalesce(F.contains(variables, F.lit(ERROR_TOKEN)), F.lit(False))


# -- counters and identifiers of writes ---------------------------------------------------


def _invokes() -> tuple[dict, dict]:
    invoke = F.col("invoke")
    keys = {"channel": exact_key(F.col("src"), F.col("dst")), "invoke": F.when(invoke.isNotNull(), exact_key(F.col("src"), F.col("dst"), invoke))}
    return keys, {"_invoke_high": ("channel", "max", invoke, False), "_invoke_uses": ("invoke", "sum", F.lit(1).cast("bigint"), True)}


def _invoke_columns() -> dict[str, Column]:
    return {
        "missing_invoke_id_on_write": F.col("invoke").isNull(), "write_invoke_id_regression": _no(F.col("invoke") < F.col("_invoke_high")),
        "duplicate_write_invoke_id": _no(F.col("_invoke_uses") > 1),
    }


def _with_memory(found: DataFrame, writes: DataFrame, memory: int | None) -> DataFrame:
    """Ids that a channel has forgotten count as new again: channels with more ids than it
    remembers are read once more, with that memory."""
    if memory is None:
        return found
    ids = writes.where("invoke IS NOT NULL").select("line", exact_key(F.col("src"), F.col("dst")).alias("key"), F.col("invoke").alias("value"))
    many = ids.select("key", "value").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > memory).select("key")
    if many.isEmpty():
        return found
    again = carried.forgetful_repeats(ids.join(many, "key"), memory)
    return found.join(again.hint("merge"), "line", "left").withColumn("duplicate_write_invoke_id", F.coalesce("again", "duplicate_write_invoke_id")).drop("again")


def invoke_rules(writes: DataFrame, memory: int | None = INVOKE_MEMORY) -> DataFrame:
    """Missing, falling and repeated invoke ids per channel, which remembers the last ``memory`` ids it took in."""
    found = _along(writes.select("line", "src", "dst", "invoke"), _invokes()).select("line", *[c.alias(n) for n, c in _invoke_columns().items()])
    return _with_memory(found, writes, memory)


def _ctls() -> tuple[dict, dict]:
    ctl, named = F.col("ctl"), F.nullif(F.col("object"), F.lit(""))
    party = [F.col("src"), F.col("dst"), _origin_key()]
    keys = {"party": F.when(ctl.isNotNull(), exact_key(*party)), "use": F.when(ctl.isNotNull(), exact_key(*party, ctl))}
    return keys, {
        "_ctl_high": ("party", "max", ctl, False), "_first_object": ("use", "min", named, True), "_last_object": ("use", "max", named, True),
        "_ctl_uses": ("use", "sum", F.lit(1).cast("bigint"), True),
    }


def _ctl_columns() -> dict[str, Column]:
    return {
        "write_ctlnum_regression": _no(F.col("ctl") < F.col("_ctl_high")), "write_ctlnum_reused_across_objects": _no(F.col("_first_object") != F.col("_last_object")),
        "write_ctlnum_reused_excessively": _no(F.col("_ctl_uses") > 2),
    }


def ctl_rules(writes: DataFrame) -> DataFrame:
    """Falling counters per channel and origin; counters used for two objects, or a third time."""
    known = writes.where("ctl IS NOT NULL").select("line", "src", "dst", "origin", "object", "ctl")
    return _along(known, _ctls()).select("line", *[c.alias(n) for n, c in _ctl_columns().items()])


def write_rules(writes: DataFrame, timeout_us: int = 15 * SECOND, memory: int | None = INVOKE_MEMORY) -> DataFrame:
    """The columns of pairing (but pending), invoke_rules and ctl_rules for every write, in one pass."""
    rows = writes.select("line", *PAIR, "action", "us", "invoke", "origin")
    found = _along(rows, _steps(), _invokes(), _ctls())
    found = found.select("line", *[c.alias(n) for n, c in {**_pair_columns(timeout_us), **_invoke_columns(), **_ctl_columns()}.items()])
    return _with_memory(found, writes, memory)


# -- origins ------------------------------------------------------------------------------


def allowed_origin(writes: DataFrame) -> DataFrame:
    """line, origin, allowed: the origin that led by writes before each one.

    The leader changes only when another origin's count exceeds the leader's, so it is the
    origin that first reached the highest count so far.
    """
    line = F.col("line")
    named = writes.where(F.coalesce(F.col("origin"), F.lit("")) != "").select("line", "origin")
    block = ordering.line_blocks(named)
    counted = running_values(named, {"origin": F.col("origin")}, {"k": ("origin", "sum", F.lit(1).cast("bigint"), True)}, (line,), line, block)
    first_of_highest = F.struct(F.col("k"), (-line).alias("since"), F.col("origin"))
    led = running_values(counted, {"all": F.lit("")}, {"top": ("all", "max", first_of_highest, False)}, (line,), line, block)
    return led.select("line", "origin", F.col("top.origin").alias("allowed"))


def origin_rule(writes: DataFrame) -> DataFrame:
    led = allowed_origin(writes)
    return led.select("line", F.coalesce(F.col("origin") != F.col("allowed"), F.lit(False)).alias("unexpected_origin_identifier"))


def known_origins(writes: DataFrame, trained: DataFrame | None = None) -> DataFrame:
    """origin, since: the first line that wrote it. Origins of ``trained`` are known from the start."""
    rows = writes.where(F.coalesce(F.col("origin"), F.lit("")) != "").select("origin", "line")
    if trained is not None:
        rows = rows.unionByName(trained.select("origin", F.lit(0).cast("bigint").alias("line")))
    return rows.groupBy("origin").agg(F.min("line").alias("since"))


def unknown_identities(identities: DataFrame, writes: DataFrame, out: str, trained: DataFrame | None = None) -> DataFrame:
    """line, out: whether the line names an identity that no write up to it has used, though
    some origin was known; an empty identity is known to none. identities: line, identity (several rows a line)."""
    known = known_origins(writes, trained)
    start = known.agg(F.min("since").alias("start"))
    rows = identities.where(F.col("identity").isNotNull()).join(known, F.col("identity") == F.col("origin"), "left").crossJoin(F.broadcast(start))
    unknown = (F.col("line") >= F.col("start")) & F.coalesce(F.col("since") > F.col("line"), F.lit(True))
    return rows.groupBy("line").agg(F.coalesce(F.max(unknown), F.lit(False)).alias(out))


# -- reports against writes ---------------------------------------------------------------


def report_rules(entries: DataFrame, writes: DataFrame, match_us: int = 20 * SECOND, strict: bool = False) -> DataFrame:
    """Rules on report entries (line, pos, us, src, dst, origin, ctl), one row an entry.

    Writes of a line stand before its entries. Where writes have a boolean column ``learned``,
    only learned ones make origins and counters known; all of them answer reports. Adds
    report_origin_not_seen_in_writes, report_ctlnum_regression,
    report_ctlnum_below_write_baseline, report_ctlnum_not_seen_in_writes,
    report_without_matching_write and unmatched_severity. All running values come from one shuffle.
    A report is answered by the last write before it that isn't later by time, if that is within
    ``match_us``; while times rise that is the last write, for the rest see ``carried.answered``.
    """
    named = entries.where(F.coalesce(F.col("origin"), F.lit("")) != "")
    learned = F.col("learned") if "learned" in writes.columns else F.lit(True)
    known = writes.where(F.coalesce(F.col("origin"), F.lit("")) != "").withColumn("_learned", learned)
    first = known.where("_learned").agg(F.min("line").alias("start"))
    e = named.select(F.lit(1).alias("side"), "line", "pos", "us", "src", "dst", "origin", "ctl", F.lit(None).cast("bigint").alias("wctl"), F.lit(None).cast("bigint").alias("wus"), F.lit(0).alias("names"))
    # a write's channel is turned around, so that it meets the reports that answer it
    w = known.select(
        F.lit(0).alias("side"), "line", F.lit(-1).alias("pos"), "us", F.col("dst").alias("src"), F.col("src").alias("dst"), "origin", "ctl",
        F.when(F.col("_learned"), F.col("ctl")).alias("wctl"), F.when(F.col("ctl").isNotNull(), F.col("us")).alias("wus"), F.col("_learned").cast("int").alias("names"),
    )
    both = e.unionByName(w)
    order, c = tuple(map(F.col, ("line", "side", "pos"))), F.col
    counted = c("ctl").isNotNull()
    keys = {
        "origin": c("origin"), "counter": F.when(counted, exact_key(c("origin"), c("ctl"))), "party": exact_key(c("src"), c("dst"), c("origin")),
        "match": F.when(counted & c("us").isNotNull(), exact_key(c("src"), c("dst"), c("origin"), c("ctl"))),
    }
    wanted = {
        "low": ("origin", "min", c("wctl"), True), "high": ("origin", "max", c("wctl"), True), "seen": ("origin", "max", c("names"), True),
        "used": ("counter", "sum", c("wctl").isNotNull().cast("bigint"), True), "report_high": ("party", "max", F.when(c("side") == 1, c("ctl")), False),
        "last_write": ("match", "last", c("wus"), False), "latest": ("match", "max", c("us"), False),
    }
    seen = running_values(both, keys, wanted, order, F.struct(*order), ordering.line_block())
    seen = materialize(seen.withColumn("key", keys["match"]), "reports")
    rows = seen.where("side = 1").crossJoin(F.broadcast(first)).withColumn("answered", F.lit(None).cast("boolean"))
    if not seen.where("us < latest").isEmpty():  # the clock went back somewhere
        timed = seen.where("key IS NOT NULL").select("key", "line", "side", "pos", "us", c("last_write").alias("was"), c("latest").alias("high"))
        rows = rows.drop("answered").join(carried.answered(timed, match_us).hint("merge"), ["line", "pos"], "left")
    no = F.lit(False)
    started, unknown, has = F.coalesce(F.col("start") <= F.col("line"), no), F.col("seen") == 0, F.col("ctl").isNotNull()
    since = F.col("us") - F.col("last_write")
    matched = F.coalesce("answered", since.between(0, match_us), no)
    excused = no if strict else F.col("used") > 0
    unmatched = has & ~matched & ((started & unknown) | ~excused)
    rule = {
        "report_origin_not_seen_in_writes": started & unknown,
        "report_ctlnum_regression": has & F.coalesce(F.col("ctl") < F.col("report_high"), no),
        "report_ctlnum_below_write_baseline": has & F.coalesce(F.col("ctl") < F.col("low"), no),
        "report_ctlnum_not_seen_in_writes": has & F.coalesce(F.col("ctl").between(F.col("low"), F.col("high")), no) & (F.col("used") == 0),
        "report_without_matching_write": unmatched,
    }
    severity = F.when(unmatched, F.when(started & unknown, 2).otherwise(1)).otherwise(0)
    return rows.select("line", "pos", *[c.alias(n) for n, c in rule.items()], severity.alias("unmatched_severity"))


def report_sequence(entries: DataFrame, reset_us: int = 120 * SECOND, tolerance: int = 2) -> DataFrame:
    """line, report_seq_regression, report_seq_duplicate. entries: line, us, key, seq, one row
    for each key of a line. Silence longer than reset_us begins a new session of a key."""
    line, key, block, no = F.col("line"), {"key": F.col("key")}, ordering.line_blocks(entries), F.lit(False)
    along = lambda df, wanted: running_values(df, key, wanted, (line,), line, block)
    rows = along(entries.select("line", "key", "us", "seq"), {"was": ("key", "last", F.struct("us"), False)})
    new = F.coalesce(F.col("us") - F.col("was.us") > reset_us, no)
    rows = along(rows.withColumn("new", new).drop("was"), {"began": ("key", "max", F.when(F.col("new"), line), True)})
    # the largest (session, number) before is of the latest session: a maximum that starts anew with each
    rows = along(rows.withColumn("session", F.struct("began", "seq")), {"top": ("key", "max", F.col("session"), False)})
    high = F.when(F.col("top.began").eqNullSafe(F.col("began")), F.col("top.seq"))
    return rows.select(
        "line", "key", F.coalesce(high - F.col("seq") > tolerance, no).alias("report_seq_regression"), F.coalesce(high == F.col("seq"), no).alias("report_seq_duplicate")
    )


# -- tags, scores, suppression -------------------------------------------------------------


def with_reasons(events: DataFrame, rules: Sequence[DataFrame]) -> DataFrame:
    """Join per-line rule tables to events and add protocol_reasons (in rule order) and severity."""
    found = events
    present: list[str] = []
    for r in rules:
        names = [n for n in r.columns if n in WRITE_RULES or n in ("delay_us", "unmatched_severity")]
        if "report_without_matching_write" in names or "report_seq_regression" in names:
            r = r.groupBy("line").agg(*[F.max(n).alias(n) for n in names])
        # one row a line: a table as long as the log, which Spark would broadcast for the small size of its file
        found = found.join(r.select("line", *names).hint("merge"), "line", "left")
        present += names
    on = {n: F.coalesce(F.col(n), F.lit(False)) for n in WRITE_RULES if n in present or n in events.columns}
    name = {n: F.lit(n) for n in on}
    if "delay_us" in present:
        ms = F.floor((F.col("delay_us") + 500) / 1000)  # half a millisecond goes up
        name["late_oper"] = F.format_string("late_oper_after_%d.%03ds", F.floor(ms / 1000), ms % 1000)
    severity = {n: F.lit(WRITE_RULES[n]) for n in on}
    if "unmatched_severity" in present:
        severity["report_without_matching_write"] = F.coalesce("unmatched_severity", F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(on[n], name[n]) for n in on]))
    worst = F.greatest(F.lit(0), F.lit(0), *[F.when(on[n], severity[n]).otherwise(0) for n in on])
    return found.withColumn("protocol_reasons", reasons).withColumn("severity", worst)


def with_scores(rows: DataFrame) -> DataFrame:
    """protocol_tag, protocol_score, anomaly_score and final_tag from severity, protocol_reasons and stat_score."""
    s = F.col("severity")
    tag = F.when(s == 2, TAGS[2]).when(s == 1, TAGS[1]).otherwise(TAGS[0])
    base = F.when(s == 2, BASE_SCORE[2]).when(s == 1, BASE_SCORE[1]).otherwise(BASE_SCORE[0])
    bonus = F.least(F.lit(20.0), 5.0 * F.greatest(F.lit(0), F.size("protocol_reasons") - 1))
    rows = rows.withColumn("protocol_tag", tag).withColumn("protocol_score", base + bonus)
    rows = rows.withColumn("anomaly_score", F.least(F.lit(100.0), F.col("protocol_score") + F.col("stat_score")))
    final = F.when((s == 2) | (F.col("anomaly_score") >= LIKELY_FROM), TAGS[2]).when((s == 1) | (F.col("anomaly_score") >= FAILED_FROM), TAGS[1]).otherwise(TAGS[0])
    return rows.withColumn("final_tag", final)


def suppress(alerts: DataFrame, quiet_us: int = 30 * SECOND, key: str = "fingerprint") -> DataFrame:
    """Add suppressed: a repeat within ``quiet_us`` of the last one of its key that was sent.

    Whether a row is sent hangs on the last sent row, not on the last row, so windows can't say
    it. Blocks of a key are step functions of the time last sent, which are composed
    (``carried.quiet_repeats``), so that a key or a burst of any length is spread over tasks.
    """
    timed = alerts.where(F.col("us").isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), "line", "us")
    quiet = carried.quiet_repeats(timed, quiet_us)
    return alerts.join(quiet.withColumn("suppressed", F.lit(True)).hint("merge"), "line", "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))


def emitted(alerts: DataFrame, emit_all: bool = False) -> DataFrame:
    return alerts if emit_all else alerts.where((F.col("final_tag") != TAGS[0]) & ~F.col("suppressed"))


def totals(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("final_tag").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("suppressed").cast("bigint")).alias("suppressed"))
