"""The driver's events table in the roles of an event log, for Spark and for DuckDB.

The table holds no control traffic, so roles are dealt out by event type and by the number k
in props. Events are hours apart; the bounds that are seconds in a capture are hours here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import micros
from ..session import table

HOUR = 3600 * 1_000_000
DAY = 24 * HOUR


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    rows = table(spark, sf_dir, "events").withColumn("k", k)
    return rows.select(
        F.col("event_id").alias("line"), micros(F.col("ts")).alias("us"), F.col("user_id").cast("string").alias("stream"),
        text("u", F.col("user_id") % 20).alias("src"), text("s", F.col("user_id") % 3).alias("dst"),
        F.when(kind.isin("click", "purchase", "signup"), "REQUEST").otherwise("RESPONSE").alias("direction"), kind.alias("service"),
        F.when(kind == "click", "SBOw").when(kind == "purchase", "Oper").otherwise("").alias("action"),
        F.when(kind == "signup", "").otherwise(text("o", F.col("k") % 10)).alias("object"), F.when(kind == "error", "").otherwise(text("g", F.col("k") % 7)).alias("origin"),
        F.col("k").alias("ctl"), F.when(F.col("k") % 11 != 0, F.col("k")).alias("invoke"), F.when(kind == "view", F.col("k")).alias("seq"), F.col("value").alias("size"),
        kind.isin("click", "purchase").alias("write"), (kind == "view").alias("report"), ((kind == "error") & (F.col("k") >= 90)).alias("seed"),
        F.when((kind == "error") & (F.col("k") >= 90), "likely-attack").when((kind == "error") & (F.col("k") >= 80), "failed-control").otherwise("normal").alias("final_tag"),
        "props", F.col("user_id"),
    )


EVENTS = """
SELECT event_id AS line, epoch_us(ts) AS us, CAST(user_id AS VARCHAR) AS stream, 'u' || (user_id % 20) AS src, 's' || (user_id % 3) AS dst,
  CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 'REQUEST' ELSE 'RESPONSE' END AS direction, event_type AS service,
  CASE event_type WHEN 'click' THEN 'SBOw' WHEN 'purchase' THEN 'Oper' ELSE '' END AS action,
  CASE WHEN event_type = 'signup' THEN '' ELSE 'o' || (k % 10) END AS object, CASE WHEN event_type = 'error' THEN '' ELSE 'g' || (k % 7) END AS origin,
  k AS ctl, CASE WHEN k % 11 <> 0 THEN k END AS invoke, CASE WHEN event_type = 'view' THEN k END AS seq, value AS size,
  event_type IN ('click', 'purchase') AS write, event_type = 'view' AS report, event_type = 'error' AND k >= 90 AS seed,
  CASE WHEN event_type = 'error' AND k >= 90 THEN 'likely-attack' WHEN event_type = 'error' AND k >= 80 THEN 'failed-control' ELSE 'normal' END AS final_tag,
  props, user_id
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
"""


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("write")


def attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed events, each naming an object of one of three entities, and its neighbour."""
    kinds = F.array(*[F.lit(x) for x in ("Breaker", "Switch", "Earth", "Lock")])
    rows = events(spark, sf_dir).where("seed")
    both = rows.select("line", "us", "src", "dst", F.lit("ROGUE").alias("origin"), "ctl", "user_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    name = F.format_string("E%02d_o%d", F.col("ctl") % 3, (F.col("ctl") + F.col("n")) % 10)
    return both.select("line", "us", "src", "dst", "origin", name.alias("object"), F.get(kinds, ((F.col("user_id") + F.col("n") * (F.col("ctl") % 2)) % 4).cast("int")).alias("kind"))


ATTACKS = f"""
SELECT line, us, src, dst, 'ROGUE' AS origin, printf('E%02d_o%d', ctl % 3, (ctl + n) % 10) AS object,
  ['Breaker', 'Switch', 'Earth', 'Lock'][(user_id + n * (ctl % 2)) % 4 + 1] AS kind
FROM ({EVENTS}) CROSS JOIN (VALUES (0), (1)) AS t(n) WHERE seed
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labeled documents as scored rows: the fewer characters, the higher the score, in coarse steps."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    score = F.round(F.least(F.lit(1.0), F.lit(20.0) / F.sqrt(F.col("n_chars") + 1)), 2)
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("label"), score.alias("score"), F.col("source").alias("grp"), (F.col("doc_id") * 60_000_000).alias("us"))


SCORED = """
SELECT d.doc_id AS id, 1 - quality AS label, round(least(1.0, 20.0 / sqrt(n_chars + 1)), 2) AS score, source AS grp, d.doc_id * 60000000 AS us
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""
