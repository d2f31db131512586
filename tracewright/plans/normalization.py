"""Scalar functions, normalization of nested records, and file round trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import normalize
from ..session import shared_path, ship, table
from ..sources import io
from ..streaming import detector
from .bind import EVENTS, HOUR, events
from .registry import query

E = f"WITH e AS ({EVENTS})"


@query("""SELECT event_id AS line, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id * 3 END AS parsed_int, try_cast(props AS DOUBLE) AS not_a_number, coalesce(nullif(trim(event_type), ''), '') AS first_text,
  CASE WHEN length(props) % 2 = 0 THEN length(props) // 2 END AS bytes_or_null, length(props) // 2 AS bytes_or_zero, contains(event_type, 'CSWI') AS hint, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE value END AS finite_value,
  value / (value + 1 + 1) AS ratio, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS parsed_ts, concat_ws('|', 'u' || user_id, '', event_type, 'x') AS channel FROM events""")
def f1_f21_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    odd = F.when(F.col("event_id") % 4 == 0, F.lit("x1")).otherwise(F.concat(F.lit(" "), (F.col("event_id") * 3).cast("string"), F.lit(" ")))
    value = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    ts = scalar.parse_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    return rows.select(
        F.col("event_id").alias("line"), scalar.parse_int(odd).alias("parsed_int"), scalar.parse_number(F.col("props")).alias("not_a_number"), scalar.first_text(F.lit("  "), F.col("event_type")).alias("first_text"),
        scalar.payload_bytes(F.col("props")).alias("bytes_or_null"), scalar.payload_bytes_or_zero(F.col("props")).alias("bytes_or_zero"), scalar.has_control_hint(F.col("event_type")).alias("hint"),
        scalar.finite(value, 1e9).alias("finite_value"), scalar.guarded_ratio(F.col("value"), F.col("value") + 1).alias("ratio"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed_ts"),
        scalar.channel_key(F.concat(F.lit(" u"), "user_id"), F.lit(None).cast("string"), F.col("event_type"), F.lit("x ")).alias("channel"),
    )


@query(f"""{E}, c AS (SELECT line, us // 1000000 AS s FROM e), d AS (SELECT line, s, (s % 86400 // 3600)::INTEGER AS hour_of_day FROM c)
SELECT line, hour_of_day, ((s // 86400 + 3) % 7)::INTEGER AS day_of_week, s // 900 * 900 AS bucket_15m, (hour_of_day < 6 OR hour_of_day >= 20)::INTEGER AS is_off_hours FROM d""")
def f17_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalar.calendar(events(spark, sf_dir)).select("line", "hour_of_day", "day_of_week", "bucket_15m", "is_off_hours")


@query(f"""{E} SELECT line, src || '|' || CASE WHEN origin <> '' THEN origin ELSE '<NO_ORIGIN>' END AS actor, CASE WHEN origin <> '' AND object <> '' THEN origin || '|' || object ELSE '' END AS origin_object,
  stream || '|' || dst AS grp, (object <> '')::INTEGER AS has_object, regexp_extract(object || '_' || service, '^([^_]+)', 1) AS prefix, array_to_string(['b', 'a'], ',') AS parts FROM e""")
def f18_f24_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return events(spark, sf_dir).select(
        "line", scalar.actor(c("src"), c("origin")).alias("actor"), scalar.joint_key(c("origin"), c("object")).alias("origin_object"), scalar.group_key(["stream", "dst"]).alias("grp"),
        (c("object") != "").cast("int").alias("has_object"), scalar.entity_prefix(F.concat("object", F.lit("_"), "service")).alias("prefix"),
        F.array_join(scalar.split_list(F.lit("b; a ;;b")), ",").alias("parts"),
    )


# -- nested records -------------------------------------------------------------------------


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested raw records, built from the events table."""
    k, line = F.col("ctl"), F.col("line")
    typed = lambda kind, value: _text('{"type": "', kind, '", "value": ', value, "}")
    parameters = _text('{"originIdentifier": ', typed("octet-string", _text('"', F.col("origin"), '"')), ', "ctlNum": ', typed("unsigned", k), ', "test": {"type": "boolean", "value": false}}')
    dissection = _text("{'frame': {'number': ", line, ", 'size': ", k, "}, 'ethernet': {'source_mac': 'm", F.col("user_id"), "', 'destination_mac': ''}, 'tcp': {'seq': ", k, ", 'flags': 'A'}, 'prp': {'lan_id': 'A'}}")
    inner = _text('{"type": "structure", "value": [', typed("octet-string", _text('"', F.col("origin"), '"')), ", ", typed("unsigned", k), ', {"type": "boolean", "value": true}]}')
    access = _text("[", typed("visible-string", _text('"IED', F.col("user_id") % 3, "$RP$urcb", k % 5, '"')), ", ", typed("unsigned", line), ", ", inner, "]")
    variables = _text('[{"name": "dev/Q', k % 4, 'CSWI1$ST$Pos"}]')
    return events(spark, sf_dir).select(
        "line", F.lit("").alias("wtimestamp"), _text("t", line).alias("timestamp"), "service", "direction", F.when(line % 3 != 0, F.col("object")).otherwise("").alias("control_object"),
        parameters.alias("control_parameters"), F.when(k % 2 == 0, typed("boolean", F.lit("false"))).alias("control_value"), dissection.alias("dissection"),
        variables.alias("variables"), F.when(k % 3 == 0, variables).otherwise("[1]").alias("control_variables"), access.alias("access_result"), F.lit("not json").alias("data"),
        F.lit("aa").alias("raw_mms_hex"), "report",
    )


@query(f"""{E} SELECT line, 't' || line AS event_time, service, CASE WHEN line % 3 <> 0 AND object <> '' THEN object END AS control_object, CAST(line AS VARCHAR) AS frame_number, CAST(ctl AS VARCHAR) AS frame_mms_size,
  'm' || user_id AS src_mac, CAST(NULL AS VARCHAR) AS dst_mac, CAST(NULL AS VARCHAR) AS prp_sequence, CAST(NULL AS VARCHAR) AS prp_lan_id, CAST(ctl AS VARCHAR) AS tcp_seq, 'A' AS tcp_flags, origin AS origin_identifier, CAST(ctl AS VARCHAR) AS ctl_num,
  'false' AS ctl_test, CAST(NULL AS VARCHAR) AS ctl_check, CASE WHEN ctl % 2 = 0 THEN 'boolean' END AS ctl_val_type, CASE WHEN ctl % 2 = 0 THEN 'false' END AS ctl_val, CASE WHEN ctl % 3 <> 0 THEN '[1]' END AS control_variables, CAST(NULL AS VARCHAR) AS data FROM e""")
def n1_n8_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normalize.normalize(raw_events(spark, sf_dir), ["service", "control_object", "raw_mms_hex"], drop=["raw_mms_hex"])
    return found.select(
        "line", "event_time", "service", "control_object", "frame_number", "frame_mms_size", "src_mac", "dst_mac", "prp_sequence", "prp_lan_id", "tcp_seq", "tcp_flags", "origin_identifier", "ctl_num",
        "ctl_test", "ctl_check", "ctl_val_type", "ctl_val", "control_variables", "data",
    )


@query(f"""{E}, l AS (SELECT line, 0 AS pos, 'a' AS t FROM e WHERE service = 'error' UNION ALL SELECT line, 1, 'b' FROM e WHERE seed), d AS (SELECT line, arg_max(t, pos) AS t FROM l GROUP BY line)
SELECT e.line, d.t AS final_tag, CASE WHEN d.t IS NOT NULL THEN 'core' END AS scenario_role FROM e LEFT JOIN d USING (line)""")
def n9_merge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    label = lambda df, pos, tag: df.select("line", F.lit(pos).alias("pos"), F.lit(tag).alias("final_tag"), F.lit("core").alias("scenario_role"))
    labels = label(e.where("service = 'error'"), 0, "a").unionByName(label(e.where("seed"), 1, "b"))
    return normalize.merge_labels(e, labels).select("line", "final_tag", "scenario_role")


@query(f"""{E} SELECT line, '["' || service || '","' || src || '"]' AS listed FROM e""")
def n11_array_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("line", normalize.array_text(F.array("service", "src")).alias("listed"))


@query(f"""{E} SELECT line, 'dev/Q' || (ctl % 4) || 'CSWI1$ST$Pos' AS refs, CASE WHEN origin = '' THEN '' ELSE origin END AS identities, 'true' AS flags, origin || ':' || ctl AS entries,
  'IED' || (user_id % 3) || '$RP$urcb' || (ctl % 5) AS report_name, line AS report_seq FROM e""")
def f5_f10_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = normalize.payload_values(raw_events(spark, sf_dir))
    entries = F.array_join(F.transform("entries", lambda x: F.concat(x["origin"], F.lit(":"), x["ctl"].cast("string"))), ";")
    return found.select("line", F.array_join("refs", ";").alias("refs"), F.array_join("identities", ";").alias("identities"), F.array_join("flags", ";").alias("flags"), entries.alias("entries"), "report_name", "report_seq")


@query(f"{E} SELECT line, json_extract_string(props, '$.k') AS k, 'none' AS missing FROM e")
def f25_json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("line", scalar.json_text(F.col("props"), "$.k").alias("k"), scalar.json_text(F.col("props"), "$.a.b", "none").alias("missing"))


# -- files ------------------------------------------------------------------------------------

PLAIN = "line bigint, us bigint, stream string, service string, props string"


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("line", "us", "stream", "service", F.concat("props", F.lit('\n"x", y')).alias("props"))


@query(f"{E} SELECT line, us, stream, service, props || chr(10) || '\"x\", y' AS props FROM e")
def s1_s5_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "csv")
    io.write_csv(_plain(spark, sf_dir), path, compressed=True)
    return io.read_csv(spark, path, PLAIN)


@query(f"{E} SELECT line, service FROM e")
def s3_s4_csv_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "csv")
    io.write_csv(_plain(spark, sf_dir).drop("props"), path)
    wanted = [c for c in io.column_names(spark, path) if c in ("line", "service")]
    return io.read_csv(spark, path, "line bigint, us bigint, stream string, service string", wanted)


@query(f"{E} SELECT line, us, stream, service, CASE WHEN service <> 'view' THEN props END AS props FROM e")
def s6_json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "jsonl")
    rows = events(spark, sf_dir).select("line", "us", "stream", "service", F.when(F.col("service") != "view", F.col("props")).alias("props"))
    io.write_json_lines(rows, path, compressed=True)
    return io.read_json_lines(spark, path, PLAIN)


@query(f"{E} SELECT origin, count(*) AS writes FROM e WHERE write AND us <= (SELECT arg_min(us, line) FROM e) + {120 * HOUR} GROUP BY origin")
def s7_model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import baseline

    path = shared_path(spark, "model")
    io.write_model(baseline.model_tables(events(spark, sf_dir), 120 * HOUR, 6 * HOUR), path)
    return io.read_model(spark, path)["origin_ctl"].select("origin", "writes")


@query(f"{E} SELECT line, service FROM e WHERE line <= (SELECT count(*) // 2 FROM e)")
def s8_first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return io.first_lines(e, e.count() // 2).select("line", "service")


@query(f"{E} SELECT n.name, e.rows FROM (SELECT count(*) AS rows FROM e) e, (VALUES ('line'), ('event_time'), ('service'), ('control_object')) n(name)")
def n10_dropped_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of four scalars of the record and its raw bytes, those that are left after the drop, with their rows."""
    found = normalize.normalize(raw_events(spark, sf_dir), ["service", "control_object", "raw_mms_hex"], drop=["raw_mms_hex"])
    names = [c for c in ("line", "event_time", "service", "control_object", "raw_mms_hex") if c in found.columns]
    return found.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("name"), "rows")


@query("SELECT row_number() OVER (ORDER BY event_id) AS line, event_id FROM events")
def s1_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows stand in the file by event_id."""
    return io.with_line_numbers(table(spark, sf_dir, "events").select("event_id")).select("line", "event_id")


@query(f"""{E} SELECT src || '|' || dst || '|' || direction || '|' || service AS channel, us // {24 * HOUR} * {24 * HOUR} AS start_us, count(*) AS rows FROM e GROUP BY ALL""")
def stream_channel_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream, counted per channel and day."""
    return detector.replay_channel_rates(spark, f"{sf_dir}/events.parquet", shared_path(spark, "stream"))


@query(f"""WITH e AS ({EVENTS}), w AS (SELECT * FROM e WHERE write), st AS (SELECT *, lag(action) OVER (PARTITION BY src, dst, object, ctl ORDER BY line) AS was FROM w)
SELECT line FROM st WHERE action = 'Oper' AND coalesce(was <> 'SBOw', true)""")
def stream_unpaired_operates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairing rule as a stateful stream."""
    return detector.replay_unpaired(spark, f"{sf_dir}/events.parquet", shared_path(spark, "stream"))


@query(f"""WITH e AS ({EVENTS}), w AS (SELECT * FROM e WHERE write), st AS (SELECT line, action, us - lag(us) OVER k AS delay, lag(action) OVER k AS was, lead(action) OVER k AS nxt FROM w WINDOW k AS (PARTITION BY src, dst, object, ctl ORDER BY line))
SELECT line, CASE WHEN action = 'SBOw' THEN 'sbow_without_matching_oper' WHEN coalesce(was <> 'SBOw', true) THEN 'oper_without_matching_sbow' ELSE 'late_oper' END AS reason,
  CASE WHEN action = 'Oper' AND was = 'SBOw' THEN delay END AS delay_us FROM st
WHERE action = 'SBOw' AND nxt IS NULL OR action = 'Oper' AND (coalesce(was <> 'SBOw', true) OR delay > {3 * HOUR})""")
def stream_paired_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selects and operates as a stream by event time; what is armed at the end is told when the watermark passes it."""
    return detector.replay_paired(spark, f"{sf_dir}/events.parquet", shared_path(spark, "stream"), 3 * HOUR, 10_000 * 24 * HOUR)
