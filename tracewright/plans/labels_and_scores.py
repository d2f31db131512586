"""Splits, thresholds, metrics and deterministic detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import label_codes
from ..operators import evaluation, rules, scenarios, sequences
from ..session import table
from .bind import EVENTS, SCORED, events, scored
from .registry import query

S = f"WITH s AS ({SCORED})"
HOURS = 3600 * 1_000_000


@query(f"""WITH e AS ({EVENTS}) SELECT line, CASE WHEN seed THEN 'sc' || user_id ELSE 'normal|' || dst || '|' || (us // 900000000) END AS gid FROM e""")
def m1_scenario_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("scenario", F.when(F.col("seed"), F.concat(F.lit("sc"), "stream"))).withColumn("grp", F.col("dst"))
    return evaluation.scenario_groups(rows).select("line", "gid")


@query()
def m2_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership follows a hash that DuckDB lacks; quotas are tested."""
    rows = scored(spark, sf_dir).withColumn("gid", F.concat_ws("|", "grp", F.col("id") % 7))
    return evaluation.group_split(rows).select("id", "label", "gid", "split")


ROUND = "round_even({0}, 0)::BIGINT"


@query(f"""{S}, g AS (SELECT grp || '|' || (id % 7) AS gid, max(label) AS positive, count(*) AS rows FROM s GROUP BY ALL), n AS (SELECT count(*) AS n, sum(positive)::BIGINT AS p FROM g),
a AS (SELECT *, greatest(least(greatest({ROUND.format("n * 0.25")}, 2), n - 2), 0) AS asked FROM n), b AS (SELECT *, greatest(least(greatest({ROUND.format("asked * p / n")}, 1), p - 1), 0) AS want FROM a),
c AS (SELECT *, greatest(least(greatest(asked - want, 1), n - p - 1), 0) AS want_neg FROM b), d AS (SELECT *, greatest(asked - want_neg, 0) AS want_pos FROM c),
o AS (SELECT 1 AS positive, 'test' AS split, want_pos AS groups FROM d UNION ALL SELECT 1, 'train', p - want_pos FROM d UNION ALL SELECT 0, 'test', want_neg FROM d UNION ALL SELECT 0, 'train', n - p - want_neg FROM d)
SELECT positive, split, groups FROM o WHERE groups > 0""")
def m2_split_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of each class on each side of the split, where there are any."""
    split = m2_group_split(spark, sf_dir).groupBy("gid", "split").agg(F.max("label").alias("positive"))
    return split.groupBy("positive", "split").agg(F.count(F.lit(1)).alias("groups"))


@query(f"{S} SELECT name, sum(label)::BIGINT AS positives, count(*) AS rows FROM s, (VALUES ('supervised_is_anomaly'), ('is_anomaly')) n(name) GROUP BY name")
def q5_label_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label column of a table with an asked-for name, and of one with the usual fallback only."""
    both = scored(spark, sf_dir).select(F.col("label").alias("supervised_is_anomaly"), F.col("label").alias("is_anomaly"))
    parts = []
    for df, wanted in ((both, "missing"), (both.drop("supervised_is_anomaly"), "supervised_is_anomaly")):
        name = sequences.label_column(df, wanted)
        parts.append(df.agg(F.sum(name).alias("positives"), F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "positives", "rows"))
    return parts[0].unionByName(parts[1])


@query(f"""WITH e AS ({EVENTS}) SELECT line, service IN ('error', 'signup') AS seed FROM e""")
def l1_seed_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("service") == "error", " Likely-Attack ").when(F.col("service") == "signup", "MASQUERADE").when(F.col("service") == "click", F.lit(None)).otherwise("normal")
    return events(spark, sf_dir).select("line", scenarios.seed_flag(tag).alias("seed"))


@query(f"""{S} SELECT c.flags, c.name, count(*) AS rows FROM s, (VALUES ('plain', 'gap'), ('plain', 'ratio'), ('expert', 'gap'), ('expert', 'ratio'), ('expert', 'stat_score'), ('identity', 'gap'), ('identity', 'ratio'), ('identity', 'service_cat')) c(flags, name) GROUP BY ALL""")
def m5_feature_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that may be learned from, without what would leak labels, scores of experts or identities."""
    n = F.col("id").cast("bigint")
    rows = scored(spark, sf_dir).select(
        n.alias("line_number"), n.alias("gap"), F.col("score").alias("ratio"), F.col("score").alias("stat_score"), n.alias("service_cat"), n.alias("scenario_seed_count"),
        F.col("label").alias("is_anomaly"), F.col("label").alias("own_label"), F.col("grp").alias("source"), n.alias("unwanted"),
    )
    options = {"plain": {}, "expert": {"expert": True}, "identity": {"identity": True}}
    found = [F.struct(F.lit(k).alias("flags"), F.lit(c).alias("name")) for k, o in options.items() for c in evaluation.feature_columns(rows, "own_label", drop=["unwanted"], **o)]
    return rows.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(F.array(*found)).alias("c"), "rows").select("c.flags", "c.name", "rows")


@query(f"""{S}, p AS (SELECT id, row_number() OVER (ORDER BY us, id) AS k, count(*) OVER () AS n FROM s), c AS (SELECT *, least(greatest({ROUND.format("n * 0.2")}, 1), n - 2) AS t FROM p),
d AS (SELECT *, least(greatest({ROUND.format("(n - t) * 0.2")}, 1), n - t - 1) AS v FROM c) SELECT id, CASE WHEN k <= n - t - v THEN 'train' WHEN k <= n - t THEN 'val' ELSE 'test' END AS split FROM d""")
def m3_chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.chronological_split(scored(spark, sf_dir)).select("id", "split")


@query(f"""{S}, p AS (SELECT id, row_number() OVER (ORDER BY us, id) AS k, count(*) OVER () AS n FROM s), c AS (SELECT *, n // 5 AS ch, n - (n // 5) * 4 AS f FROM p)
SELECT id, (CASE WHEN k <= f THEN 0 ELSE (k - f - 1) // ch + 1 END)::INTEGER AS fold FROM c""")
def m4_time_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.time_folds(scored(spark, sf_dir), 4).select("id", "fold")


@query(f"{S}, g AS (SELECT grp, ((row_number() OVER (ORDER BY count(*) DESC, grp) - 1) % 4)::INTEGER AS fold FROM s GROUP BY grp) SELECT id, fold FROM s JOIN g USING (grp)")
def m4_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.group_folds(scored(spark, sf_dir), 4, "grp").select("id", "fold")


CURVE = """c AS (SELECT score, sum(label)::BIGINT AS p, (count(*) - sum(label))::BIGINT AS q FROM {0} GROUP BY score),
u AS (SELECT *, (sum(p) OVER (ORDER BY score DESC))::BIGINT AS tp, (sum(q) OVER (ORDER BY score DESC))::BIGINT AS fp, (sum(p) OVER ())::BIGINT AS pos, (sum(q) OVER ())::BIGINT AS neg FROM c)"""


@query(f"{S}, {CURVE.format('s')} SELECT score, p, q, tp, fp, pos, neg FROM u")
def m14_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.curve(scored(spark, sf_dir))


@query(f"{S}, {CURVE.format('s')}, f AS (SELECT score, 2.0 * tp / (tp + fp + pos) AS f1 FROM u) SELECT score AS threshold, round(f1, 9) AS f1 FROM f ORDER BY f.f1 DESC, score LIMIT 1")
def m14_row_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.row_threshold(scored(spark, sf_dir)).select("threshold", F.round("f1", 9).alias("f1"))


GROUPED = "SELECT id, label, score, grp || '|' || (id % 40) AS grp FROM s"


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumn("grp", F.concat_ws("|", "grp", F.col("id") % 40))


G = f"{S}, t AS ({GROUPED}), g AS (SELECT grp, max(label) AS label, max(score) AS score FROM t GROUP BY grp)"


@query(f"""{G}, k AS (SELECT score AS t FROM (SELECT DISTINCT score FROM g) UNION SELECT 0.5), a AS (SELECT t, sum((score >= t AND label = 1)::INT) AS tp, sum((score >= t AND label = 0)::INT) AS fp, sum(label) AS pos FROM k, g GROUP BY t),
r AS (SELECT t, round(2.0 * tp / nullif(tp + fp + pos, 0), 12) AS f1, round(tp / greatest(pos, 1), 12) AS recall FROM a) SELECT t::DOUBLE AS threshold, f1, recall FROM r ORDER BY r.f1 DESC, r.recall DESC, t LIMIT 1""")
def m15_scenario_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.scenario_threshold(_grouped(spark, sf_dir))


RATES = """sum((label = 1 AND {0})::INT)::BIGINT AS tp, sum((label = 0 AND {0})::INT)::BIGINT AS fp, sum((label = 1 AND NOT {0})::INT)::BIGINT AS fn, sum((label = 0 AND NOT {0})::INT)::BIGINT AS tn"""
DERIVED = """tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1,
  round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE coalesce(tn / nullif(tn + fp, 0), 0) END, 9) AS balanced_accuracy"""
RANKING = """(SELECT round(CASE WHEN max(pos) > 0 THEN sum(p / pos * (tp / (tp + fp))) ELSE 0 END, 9) FROM u) AS average_precision,
  (SELECT round(CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN sum(q * (tp - p / 2)) / (max(pos) * max(neg)) END, 9) FROM u) AS roc_auc"""
METRICS = ("precision", "recall", "f1", "balanced_accuracy", "average_precision", "roc_auc")


def _rounded(df: DataFrame, names: tuple[str, ...] = METRICS) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


@query(f"{S}, {CURVE.format('s')}, m AS (SELECT {RATES.format('(score >= 0.5)')} FROM s) SELECT {DERIVED}, {RANKING} FROM m")
def m16_row_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.row_metrics(scored(spark, sf_dir), 0.5))


@query(f"{G}, {CURVE.format('g')}, m AS (SELECT {RATES.format('(score >= 0.5)')} FROM g) SELECT {DERIVED}, {RANKING} FROM m")
def m17_group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.group_metrics(_grouped(spark, sf_dir), 0.5))


@query(f"{S} SELECT id, label, score, (score >= 0.5)::INTEGER AS predicted FROM s")
def m18_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.predictions(scored(spark, sf_dir), 0.5)


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 1.0 WHEN toxic = 0 THEN 0.0 END::DOUBLE AS by_number, CASE WHEN source IN ('src1', 'src2') THEN 1.0 WHEN source = 'src3' THEN 0.0 END::DOUBLE AS by_word FROM labels JOIN documents USING (doc_id)")
def f16_label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    coded = label_codes(label_codes(rows, "toxic", "by_number"), "source", "by_word", ("src1", "src2"), ("src3",))
    return coded.select("doc_id", "by_number", "by_word")


# -- deterministic detectors ---------------------------------------------------------------

REASON = "CASE WHEN ctl >= 90 THEN 'report_ctlnum_regression; last_appl_error;other' WHEN ctl >= 80 THEN ' last_appl_error' WHEN ctl >= 70 THEN '[]' WHEN ctl >= 60 THEN 'other;other' END"


def _reasoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("ctl")
    text = F.when(k >= 90, "report_ctlnum_regression; last_appl_error;other").when(k >= 80, " last_appl_error").when(k >= 70, "[]").when(k >= 60, "other;other")
    rows = events(spark, sf_dir).withColumn("protocol_reasons", text).withColumn("scenario", F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("sc"), F.col("user_id") % 40)))
    return rows.withColumn("label", F.col("seed").cast("int")).withColumn("role", F.when(F.col("seed"), "core").otherwise("normal"))


D = f"""WITH e AS ({EVENTS}), d AS (SELECT *, seed::INT AS label, CASE WHEN user_id % 5 <> 0 THEN 'sc' || (user_id % 40) END AS scenario, (ctl >= 90)::INT AS hard, (ctl BETWEEN 80 AND 89)::INT AS moderate_only,
  (CASE WHEN ctl >= 90 THEN 3 WHEN ctl >= 80 OR ctl BETWEEN 60 AND 69 THEN 1 ELSE 0 END) AS violations FROM e)"""


@query(f"""{D} SELECT line, hard, moderate_only, violations, CASE WHEN ctl >= 90 THEN 'last_appl_error;other;report_ctlnum_regression' WHEN ctl >= 80 THEN 'last_appl_error' WHEN ctl BETWEEN 60 AND 69 THEN 'other' ELSE '' END AS violation_list,
  hard AS is_report_ctlnum_regression, (ctl >= 80)::INT AS is_last_appl_error FROM d""")
def d1_reason_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.reason_flags(_reasoned(spark, sf_dir)).select("line", "hard", "moderate_only", "violations", "violation_list", "is_report_ctlnum_regression", "is_last_appl_error")


@query(f"{D} SELECT line, coalesce(max(hard) OVER (PARTITION BY scenario) * (scenario IS NOT NULL)::INT, 0)::INTEGER AS escalated FROM d")
def d2_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.escalate(rules.reason_flags(_reasoned(spark, sf_dir))).select("line", "escalated")


@query(f"{D} SELECT line, (hard = 1 OR moderate_only = 1)::INT AS predicted, CASE WHEN hard = 1 THEN 3 WHEN moderate_only = 1 THEN 1 ELSE 0 END AS confidence FROM d")
def d3_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.predict(rules.reason_flags(_reasoned(spark, sf_dir))).select("line", "predicted", "confidence")


@query(f"""{D}, p AS (SELECT scenario, label, (hard = 1 OR moderate_only = 1)::INT AS y FROM d), s AS (SELECT max(label) AS label, max(y) AS y FROM p WHERE scenario IS NOT NULL GROUP BY scenario),
m AS (SELECT 'row' AS level, {RATES.format('(y = 1)')} FROM p UNION ALL SELECT 'seed', {RATES.format('(y = 1)')} FROM p UNION ALL SELECT 'scenario', {RATES.format('(y = 1)')} FROM s)
SELECT level, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1,
  round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE coalesce(tn / nullif(tn + fp, 0), 0) END, 9) AS balanced_accuracy FROM m""")
def d4_level_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rules.level_metrics(rules.predict(rules.reason_flags(_reasoned(spark, sf_dir)))), METRICS[:4])


@query(f"""{D}, s AS (SELECT line, label, (ctl % 13 = 0)::INT AS o, (ctl % 3 = 0 AND ctl % 2 = 0)::INT AS c, (hard = 1 OR ctl % 17 = 0)::INT AS h, (seq IS NOT NULL AND ctl % 5 = 0)::INT AS q FROM d)
SELECT line, o AS strict_origin, c AS strict_ctl, q AS strict_sequence_raw, q AS strict_sequence, h AS strict_protocol, (o + c + h + 0.25 * q)::DOUBLE AS strict_score, (o + c + h + 0.25 * q >= 1)::INT AS strict_predicted FROM s""")
def d5_strict_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.strict_score(_strict(spark, sf_dir), sequence=True).select("line", "strict_origin", "strict_ctl", "strict_sequence_raw", "strict_sequence", "strict_protocol", F.col("strict_score").cast("double").alias("strict_score"), "strict_predicted")


def _strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, bit = F.col("ctl"), lambda c: c.cast("int")
    rows = _reasoned(spark, sf_dir)
    return rows.withColumns(
        {
            "origin_new_src": bit(k % 13 == 0), "src_new_origin": F.lit(0), "has_ctl": bit(k % 2 == 0), "ctl_regression": bit(k % 3 == 0), "ctl_reused": F.lit(0), "ctl_delta_actor_object": F.lit(0),
            "has_seq": bit(F.col("seq").isNotNull()), "seq_regression": bit(k % 5 == 0), "seq_reused": F.lit(0), "seq_delta": F.lit(0), "protocol_score": F.when((k >= 90) | (k % 17 == 0), 50.0).otherwise(0.0),
        }
    )


STRICT = "(CASE WHEN ctl % 13 = 0 OR (ctl % 6 = 0) OR hard = 1 OR ctl % 17 = 0 THEN 1 ELSE 0 END)"


@query(f"""{D}, m AS (SELECT 'rules' AS branch, {RATES.format('(hard = 1 OR moderate_only = 1)')} FROM d UNION ALL SELECT 'strict', {RATES.format(f'({STRICT} = 1)')} FROM d)
SELECT branch, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM m""")
def d7_branch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = rules.predict(rules.reason_flags(_reasoned(spark, sf_dir)))
    strict = rules.strict_score(_strict(spark, sf_dir))
    rate = lambda df, c: evaluation.rates(evaluation.confusion(df, F.col(c) == 1))
    return _rounded(rules.summary({"rules": rate(ruled, "predicted"), "strict": rate(strict, "strict_predicted")}), METRICS[:3])
