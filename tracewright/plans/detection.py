"""Baseline, statistical and protocol-state queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import fingerprint
from ..operators import baseline, detector, normalize, protocol, statistical
from ..session import materialize, ship
from .bind import DAY, EVENTS, HOUR, events, writes
from .registry import query

E = f"WITH e AS ({EVENTS})"
W = f"{E}, w AS (SELECT * FROM e WHERE write)"
TRAIN = 5 * DAY
WINDOW = 6 * HOUR
CHANNEL = "src || '|' || dst || '|' || direction || '|' || service"
T = f"{E}, t AS (SELECT *, {CHANNEL} AS channel FROM e WHERE us <= (SELECT arg_min(us, line) FROM e) + {TRAIN})"
IA = "ia AS (SELECT channel, count(*) AS n, avg(gap) AS mean, coalesce(stddev_samp(gap), 0) AS std FROM (SELECT channel, (us - lag(us) OVER (PARTITION BY channel ORDER BY line)) / 1e6 AS gap FROM t) WHERE gap BETWEEN 0 AND 3600 * 24 GROUP BY channel)"
SZ = "sz AS (SELECT channel, count(size) AS n, avg(size) AS mean, coalesce(stddev_samp(size), 0) AS std FROM t GROUP BY channel)"
RT = f"rt AS (SELECT channel, count(*) AS n, avg(c) AS mean, coalesce(stddev_samp(c), 0) AS std FROM (SELECT channel, us // {WINDOW} AS b, count(*) AS c FROM t GROUP BY ALL) GROUP BY channel)"
SP = "sp AS (SELECT direction || '|' || service AS combo, count(*) AS n, count(*) / (SELECT count(*) FROM t) AS p FROM t GROUP BY 1)"
ROUNDED = "n, round(mean, 6) AS mean, round(std, 6) AS std"


def _round(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.training_prefix(events(spark, sf_dir), TRAIN)


@query(f"{T} SELECT line, us, channel FROM t")
def b1_training_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.with_channel(_train(spark, sf_dir)).select("line", "us", "channel")


@query(f"{T}, {SP} SELECT combo, n, round(p, 6) AS p FROM sp")
def b2_service_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(baseline.service_probability(_train(spark, sf_dir)), "p")


@query(f"{T}, {IA} SELECT channel, n, round(mean * n * 1e6)::BIGINT AS total_us, round(std, 6) AS std FROM ia")
def b3_interarrival_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean is shown as a sum of microseconds, which is a whole number and so has no ties to round."""
    found = baseline.interarrival_stats(_train(spark, sf_dir), DAY)
    return found.select("channel", "n", F.round(F.col("mean") * F.col("n") * 1e6).cast("bigint").alias("total_us"), F.round("std", 6).alias("std"))


@query(f"{T}, {SZ} SELECT channel, n, round(mean * n * 100)::BIGINT AS total_cents, round(std, 6) AS std FROM sz")
def b4_b8_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = baseline.size_stats(_train(spark, sf_dir))
    return found.select("channel", "n", F.round(F.col("mean") * F.col("n") * 100).cast("bigint").alias("total_cents"), F.round("std", 6).alias("std"))


@query(f"{T}, {RT} SELECT channel, {ROUNDED} FROM rt")
def b5_rate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(baseline.rate_stats(_train(spark, sf_dir), WINDOW), "mean", "std")


@query(f"{T} SELECT origin, count(*) AS writes, min(line) AS first_line, array_to_string(list_sort(list_distinct(list(ctl))), ',') AS ctls FROM t WHERE write AND origin <> '' GROUP BY origin")
def b6_origin_ctls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.origin_ctls(_train(spark, sf_dir)).withColumn("ctls", F.array_join(F.col("ctls").cast("array<string>"), ","))


@query(f"{T} SELECT arg_max(origin, (n, -f)) AS allowed_origin FROM (SELECT origin, count(*) AS n, min(line) AS f FROM t WHERE write AND origin <> '' GROUP BY origin)")
def b7_most_common_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.most_common_origin(_train(spark, sf_dir))


LIVE = f"count(*) OVER (PARTITION BY {CHANNEL} ORDER BY us RANGE BETWEEN {WINDOW} PRECEDING AND CURRENT ROW)"


@query(f"{E} SELECT line, {LIVE} AS live FROM e")
def t6_live_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times are distinct in this table; ties are tested against a sequential model."""
    return statistical.live_rate(events(spark, sf_dir), WINDOW).select("line", "live")


@query(f"""{T}, {IA.replace("3600 * 24", "3600 * 24")}, {SZ}, {RT}, {SP},
x AS (SELECT line, direction || '|' || service AS combo, {CHANNEL} AS channel, size, {LIVE} AS live, (us - lag(us) OVER (PARTITION BY {CHANNEL} ORDER BY line)) / 1e6 AS gap FROM e),
z AS (SELECT line, abs(gap - ia.mean) / nullif(ia.std, 0) AS zi, gap >= 0 AND ia.n >= 20 AS oi, abs(size - sz.mean) / nullif(sz.std, 0) AS zs, sz.n >= 20 AS os,
  coalesce(p, 0) AS p, (live - rt.mean) / greatest(rt.std, 0.5) AS zr, coalesce(rt.n >= 5, false) AS kr, live
  FROM x LEFT JOIN ia USING (channel) LEFT JOIN sz USING (channel) LEFT JOIN rt USING (channel) LEFT JOIN sp USING (combo)),
f AS (SELECT line, zi, zs, zr, p, coalesce(oi AND zi >= 3, false) AS a, coalesce(os AND zs >= 3, false) AS b, p <= 0.005 AS c, coalesce(kr AND zr >= 3, false) AS d, NOT kr AND live >= 25 AS g FROM z)
SELECT line, round(least(100, (CASE WHEN a THEN least(25, 5 + 4 * (zi - 3)) ELSE 0 END) + (CASE WHEN b THEN least(20, 4 + 3 * (zs - 3)) ELSE 0 END)
  + (CASE WHEN c THEN least(20, 4 - 3 * ln(greatest(p, 1e-9))) ELSE 0 END) + (CASE WHEN d THEN least(25, 5 + 4 * (zr - 3)) ELSE 0 END) + (CASE WHEN g THEN 12 ELSE 0 END)), 6) AS stat_score,
  concat_ws(';', CASE WHEN a THEN 'interarrival_outlier' END, CASE WHEN b THEN 'payload_size_outlier' END, CASE WHEN c THEN 'rare_service_combo' END,
    CASE WHEN d THEN 'rate_spike' END, CASE WHEN g THEN 'unknown_channel_rate_spike' END) AS stat_reasons FROM f""")
def t1_t5_statistical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scored(spark, sf_dir)
    return _round(found, "stat_score").select("line", "stat_score", F.array_join("stat_reasons", ";").alias("stat_reasons"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = materialize(baseline.with_channel(_train(spark, sf_dir)).select("line", "us", "src", "dst", "direction", "service", "size"), "training-prefix")
    stats = baseline.interarrival_stats(train, DAY).withColumn("metric", F.lit("interarrival"))
    stats = stats.unionByName(baseline.size_stats(train).withColumn("metric", F.lit("size"))).unionByName(baseline.rate_stats(train, WINDOW).withColumn("metric", F.lit("rate")))
    return statistical.score(events(spark, sf_dir), baseline.service_probability(train), stats, WINDOW)


def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, us, label, protocol_score and stat_score of every event: the two rule scores, and whether it is a seed."""
    w = writes(spark, sf_dir)
    rows = _scored(spark, sf_dir).drop("final_tag")
    found = protocol.with_scores(protocol.with_reasons(rows, [protocol.write_rules(w, 3 * HOUR), protocol.origin_rule(w)]))
    return found.select(F.col("line").alias("id"), "us", F.col("seed").cast("int").alias("label"), "protocol_score", "stat_score")


#: Means of a few gaps lie halfway between microseconds, where the order of sums would decide; halves go up.
COARSE = "n, round(mean + 1e-8, 6) AS mean, round(std + 1e-8, 6) AS std"


@query(f"""{T}, {IA}, {SZ}, {RT} SELECT channel, 'interarrival' AS metric, {COARSE} FROM ia UNION ALL SELECT channel, 'size', {COARSE} FROM sz WHERE n > 0 UNION ALL SELECT channel, 'rate', {COARSE} FROM rt""")
def b8_merged_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training prefix in three batches, whose states are merged one after the other."""
    train = materialize(_train(spark, sf_dir).select("line", "us", "src", "dst", "direction", "service", "size", "origin", "ctl", "write"), "training-prefix")
    at = train.agg(F.min("line"), F.max("line")).first()
    low, high = at[0] or 0, at[1] or 0
    cuts = [low + (high - low) // 3, low + 2 * (high - low) // 3]
    parts = [train.where(F.col("line") <= cuts[0]), train.where((F.col("line") > cuts[0]) & (F.col("line") <= cuts[1])), train.where(F.col("line") > cuts[1])]
    states = [baseline.baseline_state(p, WINDOW, DAY) for p in parts]
    merged = baseline.merge_states(baseline.merge_states(states[0], states[1], DAY), states[2], DAY)
    stats = baseline.state_tables(merged)["channel_stats"]
    return stats.select("channel", "metric", "n", *[F.round(F.col(c) + 1e-8, 6).alias(c) for c in ("mean", "std")])


PAIR = f"""st AS (SELECT *, lag(action) OVER k AS was, lag(us) OVER k AS was_us, lead(action) OVER k AS nxt FROM w WINDOW k AS (PARTITION BY src, dst, object, ctl ORDER BY line)),
pr AS (SELECT *, action = 'Oper' AND coalesce(was <> 'SBOw', true) AS lonely, CASE WHEN action = 'Oper' AND was = 'SBOw' THEN us - was_us END AS delay_us FROM st)"""


@query(f"{W}, {PAIR} SELECT line, lonely AS oper_without_matching_sbow, coalesce(delay_us > {3 * HOUR}, false) AS late_oper, delay_us, action = 'SBOw' AND nxt IS NULL AS pending FROM pr")
def p2_p3_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.pairing(writes(spark, sf_dir), 3 * HOUR)


@query(f"""{W}, {PAIR} SELECT 'synthetic' AS event_source, line, us, src, dst, stream, service, object, action, ctl, origin, 'sbow_without_matching_oper' AS reason,
  45.0::DOUBLE AS protocol_score, 'failed-control' AS final_tag FROM pr WHERE action = 'SBOw' AND nxt IS NULL""")
def p4_pending_selects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.pending_selects(writes(spark, sf_dir))


@query(f"""{W} SELECT line, coalesce(invoke < max(invoke) OVER (PARTITION BY src, dst ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS write_invoke_id_regression,
  invoke IS NOT NULL AND row_number() OVER (PARTITION BY src, dst, invoke ORDER BY line) > 1 AS duplicate_write_invoke_id, invoke IS NULL AS missing_invoke_id_on_write FROM w""")
def p5_p7_invoke_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.invoke_rules(writes(spark, sf_dir))


@query(f"""{W} SELECT line, coalesce(ctl < max(ctl) OVER (PARTITION BY src, dst, origin ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS write_ctlnum_regression,
  min(object) OVER u <> max(object) OVER u AS write_ctlnum_reused_across_objects, row_number() OVER u > 2 AS write_ctlnum_reused_excessively
  FROM w WINDOW u AS (PARTITION BY src, dst, origin, ctl ORDER BY line)""")
def p8_p10_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.ctl_rules(writes(spark, sf_dir))


LEADER = """c AS (SELECT line, origin, row_number() OVER (PARTITION BY origin ORDER BY line) AS k FROM w WHERE origin <> ''),
m AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY k ORDER BY line) = 1 THEN origin END AS leader FROM c),
al AS (SELECT line, origin, last_value(leader IGNORE NULLS) OVER (ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS allowed FROM m)"""


@query(f"{W}, {LEADER} SELECT line, origin, allowed FROM al")
def p12_allowed_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.allowed_origin(writes(spark, sf_dir))


@query(f"{W}, {LEADER} SELECT line, coalesce(origin <> allowed, false) AS unexpected_origin_identifier FROM al")
def p11_unexpected_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.origin_rule(writes(spark, sf_dir))


@query(f"{W} SELECT origin, min(line) AS since FROM w WHERE origin <> '' GROUP BY origin")
def p13_known_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.known_origins(writes(spark, sf_dir))


@query(f"""{W}, k AS (SELECT origin, min(line) AS since FROM w WHERE origin <> '' GROUP BY origin), i AS (SELECT line, unnest([origin, 'g' || (ctl % 9)]) AS identity FROM e WHERE report)
SELECT i.line, coalesce(max(i.line >= (SELECT min(since) FROM k) AND coalesce(since > i.line, true)), false) AS unexpected_octet_identity_in_control_context
FROM i LEFT JOIN k ON identity = origin WHERE identity <> '' GROUP BY i.line""")
def p14_unknown_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    other = F.concat(F.lit("g"), (F.col("ctl") % 9).cast("string"))
    named = e.where("report").select("line", F.explode(F.array("origin", other)).alias("identity"))
    return protocol.unknown_identities(named.where("identity <> ''"), e.where("write"), "unexpected_octet_identity_in_control_context")


def _entries(e: DataFrame) -> DataFrame:
    """Reports answer the channel they came by, so source and destination are turned around."""
    return e.where("report").select("line", F.lit(0).alias("pos"), "us", F.col("dst").alias("src"), F.col("src").alias("dst"), "origin", "ctl")


@query(f"""{W}, n AS (SELECT line, us, dst AS src, src AS dst, origin, ctl FROM e WHERE report),
b AS (SELECT 1 AS side, line, us, src, dst, origin, ctl, NULL AS wctl, NULL AS wus FROM n UNION ALL SELECT 0, line, us, dst, src, origin, ctl, ctl, us FROM w WHERE origin <> ''),
s AS (SELECT *, min(wctl) OVER o AS low, max(wctl) OVER o AS high, max(1 - side) OVER o AS seen, count(wctl) OVER p AS used,
  max(CASE WHEN side = 1 THEN ctl END) OVER (PARTITION BY src, dst, origin ORDER BY line, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rh,
  last_value(wus IGNORE NULLS) OVER (PARTITION BY src, dst, origin, ctl ORDER BY line, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lw
  FROM b WINDOW o AS (PARTITION BY origin ORDER BY line, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY origin, ctl ORDER BY line, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT *, coalesce((SELECT min(line) FROM w) <= line, false) AND seen = 0 AS unk, coalesce(us - lw BETWEEN 0 AND {4 * HOUR}, false) AS matched FROM s WHERE side = 1)
SELECT line, 0 AS pos, unk AS report_origin_not_seen_in_writes, coalesce(ctl < rh, false) AS report_ctlnum_regression, coalesce(ctl < low, false) AS report_ctlnum_below_write_baseline,
  coalesce(ctl BETWEEN low AND high, false) AND used = 0 AS report_ctlnum_not_seen_in_writes, NOT matched AND (unk OR used = 0) AS report_without_matching_write,
  CASE WHEN NOT matched AND (unk OR used = 0) THEN (CASE WHEN unk THEN 2 ELSE 1 END) ELSE 0 END AS unmatched_severity FROM r""")
def p15_p19_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return protocol.report_rules(_entries(e), e.where("write"), 4 * HOUR)


SEQ = f"""q AS (SELECT line, us, src || '|' || dst || '|' || origin AS key, seq FROM e WHERE report),
g AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY key ORDER BY line) > {24 * HOUR})::INT, 0) AS n FROM q),
se AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY line) AS session FROM g),
hi AS (SELECT *, max(seq) OVER (PARTITION BY key, session ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM se)"""


@query(f"{E}, {SEQ} SELECT line, key, coalesce(high - seq > 2, false) AS report_seq_regression, coalesce(high = seq, false) AS report_seq_duplicate FROM hi")
def p20_p21_report_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = events(spark, sf_dir).where("report").select("line", "us", F.concat_ws("|", "src", "dst", "origin").alias("key"), "seq")
    return protocol.report_sequence(named, 24 * HOUR)


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write rules, their reasons, scores and tags, past the training span."""
    e = events(spark, sf_dir)
    w = e.where("write")
    rules = [protocol.write_rules(w, 3 * HOUR), protocol.origin_rule(w)]
    rows = protocol.with_scores(protocol.with_reasons(e.withColumn("stat_score", F.when(F.col("seed"), 42.0).otherwise(0.0)).drop("final_tag"), rules))
    # training rows feed every state above, but are neither scored nor shown
    end = e.agg((F.min_by("us", "line") + TRAIN).alias("train_end"))
    return rows.crossJoin(F.broadcast(end)).where("us > train_end").drop("train_end")


TAGS = f"""{W}, {PAIR}, {LEADER},
iv AS (SELECT line, coalesce(invoke < max(invoke) OVER (PARTITION BY src, dst ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ir,
  invoke IS NOT NULL AND row_number() OVER (PARTITION BY src, dst, invoke ORDER BY line) > 1 AS du, invoke IS NULL AS mi,
  coalesce(ctl < max(ctl) OVER (PARTITION BY src, dst, origin ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS cr,
  min(object) OVER u <> max(object) OVER u AS ao, row_number() OVER u > 2 AS ex FROM w WINDOW u AS (PARTITION BY src, dst, origin, ctl ORDER BY line)),
j AS (SELECT e.*, CASE WHEN seed THEN 42.0 ELSE 0.0 END AS stat_score, coalesce(lonely, false) AS lonely, coalesce(delay_us > {3 * HOUR}, false) AS late, delay_us, coalesce(mi, false) AS mi, coalesce(ir, false) AS ir,
  coalesce(du, false) AS du, coalesce(cr, false) AS cr, coalesce(ao, false) AS ao, coalesce(ex, false) AS ex, coalesce(al.origin <> allowed, false) AS uo
  FROM e LEFT JOIN (SELECT line, lonely, delay_us FROM pr) USING (line) LEFT JOIN iv USING (line) LEFT JOIN al ON al.line = e.line),
rs AS (SELECT *, list_filter([CASE WHEN lonely THEN 'oper_without_matching_sbow' END, CASE WHEN late THEN printf('late_oper_after_%d.%03ds', (delay_us + 500) // 1000000, (delay_us + 500) // 1000 % 1000) END, CASE WHEN mi THEN 'missing_invoke_id_on_write' END,
  CASE WHEN ir THEN 'write_invoke_id_regression' END, CASE WHEN du THEN 'duplicate_write_invoke_id' END, CASE WHEN cr THEN 'write_ctlnum_regression' END, CASE WHEN ao THEN 'write_ctlnum_reused_across_objects' END,
  CASE WHEN ex THEN 'write_ctlnum_reused_excessively' END, CASE WHEN uo THEN 'unexpected_origin_identifier' END], lambda x: x IS NOT NULL) AS reasons,
  CASE WHEN lonely OR du OR ao OR uo THEN 2 WHEN late OR mi OR ir OR cr OR ex THEN 1 ELSE 0 END AS severity FROM j),
sc AS (SELECT *, ([0.0, 45.0, 70.0])[severity + 1] + least(20, 5 * greatest(0, len(reasons) - 1)) AS protocol_score FROM rs),
tg AS (SELECT *, least(100, protocol_score + stat_score)::DOUBLE AS anomaly_score, ['normal', 'failed-control', 'likely-attack'][severity + 1] AS protocol_tag FROM sc),
fin AS (SELECT *, CASE WHEN severity = 2 OR anomaly_score >= 70 THEN 'likely-attack' WHEN severity = 1 OR anomaly_score >= 40 THEN 'failed-control' ELSE 'normal' END AS tag
  FROM tg WHERE us > (SELECT arg_min(us, line) FROM e) + {TRAIN})"""


@query(f"{TAGS} SELECT line, array_to_string(reasons, ';') AS protocol_reasons, protocol_tag, protocol_score::DOUBLE AS protocol_score, anomaly_score, tag AS final_tag FROM fin")
def p22_p24_tags_and_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("line", F.array_join("protocol_reasons", ";").alias("protocol_reasons"), "protocol_tag", "protocol_score", "anomaly_score", "final_tag")


QUIET = 48 * HOUR
SENT = f"""{TAGS.replace("WITH e", "WITH RECURSIVE e", 1)}, al2 AS (SELECT line, us, tag, tag || '|' || src || '|' || dst || '|' || service AS key FROM fin WHERE tag <> 'normal'),
sent AS (SELECT key, min(us) AS us FROM al2 GROUP BY key UNION ALL SELECT a.key, min(a.us) FROM sent s JOIN al2 a ON a.key = s.key AND a.us >= s.us + {QUIET} GROUP BY a.key, s.us),
sup AS (SELECT a.*, s.us IS NULL AS suppressed FROM al2 a LEFT JOIN sent s ON a.key = s.key AND a.us = s.us)"""


def _suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = _tagged(spark, sf_dir).where("final_tag <> 'normal'")
    key = F.concat_ws("|", "final_tag", "src", "dst", "service")
    shown = alerts.select("line", "us", "final_tag", key.alias("fingerprint"))
    return protocol.suppress(materialize(shown, "alerts"), QUIET)


@query(f"{SENT} SELECT line, key AS fingerprint, suppressed FROM sup")
def p25_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suppressed(spark, sf_dir).select("line", "fingerprint", "suppressed")


@query(f"{SENT} SELECT line, tag AS final_tag FROM sup WHERE NOT suppressed")
def p26_emitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.emitted(_suppressed(spark, sf_dir)).select("line", "final_tag")


@query(f"{SENT} SELECT tag AS final_tag, count(*) AS rows, sum(suppressed::INT)::BIGINT AS suppressed FROM sup GROUP BY tag")
def p27_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.totals(_suppressed(spark, sf_dir))


@query(f"""{TAGS} SELECT line, tag || '|' || src || '|' || dst || '|' || service || '|' || array_to_string(list_sort(list_distinct(reasons))[1:3], ';') || '|' || coalesce(CAST(seq AS VARCHAR), '') AS fingerprint FROM fin""")
def f11_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tagged(spark, sf_dir)
    return rows.select("line", fingerprint(F.col("final_tag"), F.col("src"), F.col("dst"), F.col("service"), F.col("protocol_reasons"), F.col("seq")).alias("fingerprint"))


@query(f"{E} SELECT line, contains(props, '9') AS last_appl_error FROM e")
def p1_token_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.replace(F.col("props"), F.lit("9"), F.lit("LastApplError"))
    return events(spark, sf_dir).select("line", protocol.last_appl_error(token).alias("last_appl_error"))


@query(f"""{W}, k AS (SELECT origin, min(line) AS since FROM w WHERE origin <> '' GROUP BY origin),
i AS (SELECT line, unnest(list_distinct(['h' || (ctl % 8), origin])) AS identity FROM e WHERE ctl % 2 = 0 OR ctl % 4 = 1)
SELECT i.line, coalesce(max(i.line >= (SELECT min(since) FROM k) AND coalesce(since > i.line, true)), false) AS unexpected_octet_identity_in_control_context
FROM i LEFT JOIN k ON identity = origin WHERE identity <> '' GROUP BY i.line""")
def p14_octet_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of nested results and parameters, of rows with a hint or of control by their own word."""
    from .normalization import raw_events

    ship(spark)
    k = F.col("user_id") * 0 + F.col("ctl")
    e = events(spark, sf_dir)
    named = F.concat(F.lit('[{"type": "structure", "value": [{"type": "octet-string", "value": "h'), (k % 8).cast("string"), F.lit('"}]}]'))
    said = e.select("line", "user_id", "ctl").select("line", named.alias("access_result"), (k % 4 == 1).cast("int").alias("is_control"), (k % 2 == 0).alias("hint"))
    raw = raw_events(spark, sf_dir).drop("access_result").join(said, "line").withColumn("variables", F.when(F.col("hint"), F.col("variables")).otherwise("[]"))
    found = normalize.payload_values(raw).select("line", F.explode("identities").alias("identity"))
    return protocol.unknown_identities(found.where("identity <> ''"), e.where("write"), "unexpected_octet_identity_in_control_context")


@query()
def detector_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole detector over the events and their nested payloads; its parts have twins of their own."""
    from .normalization import raw_events

    ship(spark)
    e = events(spark, sf_dir).drop("final_tag")
    model = baseline.model_tables(e, TRAIN, WINDOW)
    options = detector.Options(WINDOW, 3 * HOUR, 4 * HOUR, 24 * HOUR, QUIET, sequence=True, duplicates=True)
    found = detector.detect(e, model, normalize.payload_values(raw_events(spark, sf_dir)), options)
    lists = [c for c, k in found.dtypes if k.startswith("array")]
    return found.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ";") for c in lists})
