"""Report queries over the attack events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports
from .bind import ATTACKS, EVENTS, HOUR, attacks, events
from .registry import query

GAP = 12 * HOUR
A = f"WITH a AS ({ATTACKS})"
PACKETS = "p AS (SELECT line, min(us) AS us, min(src) AS src, min(dst) AS dst, min(origin) AS origin, list_sort(list_distinct(list(kind))) AS kinds, list_sort(list_distinct(list(object))) AS objects FROM a GROUP BY line)"
SESSIONS = f"""s AS (SELECT *, sum(n) OVER (ORDER BY us, line)::INTEGER AS campaign FROM
  (SELECT *, CASE WHEN us - lag(us) OVER (ORDER BY us, line) <= {GAP} THEN 0 ELSE 1 END AS n FROM p))"""


@query(f"""{A}, {PACKETS}, {SESSIONS}
SELECT campaign, min(a.us) AS start_us, max(a.us) AS end_us, (max(a.us) - min(a.us)) // 1000000 AS duration_sec, count(DISTINCT a.line) AS packets,
  array_to_string(list_sort(list_distinct(list(kind))), ', ') AS kinds FROM a JOIN s ON a.line = s.line GROUP BY campaign""")
def r1_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.campaigns(attacks(spark, sf_dir), GAP)


@query(f"{A}, {PACKETS}, {SESSIONS} SELECT campaign, line, us, array_to_string(kinds, ' + ') AS hit FROM s")
def r2_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sequences(attacks(spark, sf_dir), GAP)


@query(f"""{A}, {PACKETS} SELECT row_number() OVER (ORDER BY us, line)::INTEGER AS seq, line, us, src, dst, origin, array_to_string(objects, '; ') AS objects,
  array_to_string(kinds, ', ') AS kinds, len(objects)::INTEGER AS n_objects FROM p""")
def r3_packet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.packet_summary(attacks(spark, sf_dir))


@query(f"{A} SELECT kind, count(DISTINCT line) AS packets FROM a GROUP BY kind ORDER BY packets DESC, kind")
def r4_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.kind_counts(attacks(spark, sf_dir))


@query(f"""{A}, b AS (SELECT regexp_extract(object, '^([^_]+)', 1) AS entity, kind, line FROM a)
SELECT entity, kind, count(DISTINCT line) AS packets, grouping(kind)::TINYINT AS total FROM b GROUP BY GROUPING SETS ((entity, kind), (entity))""")
def r5_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.per_entity(attacks(spark, sf_dir))


H = f"h AS (SELECT us // {HOUR} * {HOUR} AS hour_us, count(DISTINCT line) AS packets FROM a GROUP BY 1)"


@query(f"{A}, {H} SELECT * FROM h")
def r6_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.hourly(attacks(spark, sf_dir))


@query(f"""{A}, {H} SELECT (SELECT min(us) FROM a) AS first_us, (SELECT max(us) FROM a) AS last_us, (SELECT count(DISTINCT us // {24 * HOUR}) FROM a) AS days, count(*) AS hours,
  (SELECT hour_us FROM h ORDER BY packets DESC, hour_us LIMIT 1) AS peak_us, max(packets) AS peak_packets,
  (SELECT hour_us FROM h ORDER BY packets, hour_us LIMIT 1) AS quiet_us, min(packets) AS quiet_packets FROM h""")
def r6_temporal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.temporal_summary(attacks(spark, sf_dir))


@query(f"""WITH e AS ({EVENTS}), c AS (SELECT sum((size >= 60 AND service = 'error')::INT) AS tp, sum((size >= 60 AND service <> 'error')::INT) AS fp, sum((size < 60 AND service = 'error')::INT) AS fn FROM e)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c""")
def r7_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return reports.agreement(e.select("line", (F.col("size") >= 60).cast("int").alias("predicted")), e.select("line", (F.col("service") == "error").cast("int").alias("hit")))


@query(f"{A} SELECT kind, count(DISTINCT line) AS packets, array_to_string(list_sort(list_distinct(list(object))), ', ') AS objects FROM a GROUP BY kind")
def r8_kind_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.kind_summary(attacks(spark, sf_dir))
