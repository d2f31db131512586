"""Model branches. Fits are compared by tests on held-out metrics, not by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, models, sequences
from ..session import materialize, table
from .bind import DAY, EVENTS, events
from .detection import rule_scores
from .registry import query

FEATURES = ["n_chars", "spaces", "symbols", "capitals"]
STEPS = ["ctl", "size", "failed"]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda keep: F.length(F.regexp_replace("text", f"[^{keep}]+", "")).cast("double")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = docs.select(F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("label"), F.col("source").alias("grp"), (F.col("doc_id") * 60_000_000).alias("us"), F.col("n_chars").cast("double").alias("n_chars"), count(" ").alias("spaces"), count("#*$%&|").alias("symbols"), count("A-Z").alias("capitals"))
    return materialize(evaluation.chronological_split(rows), "branch-rows")


@query()
def m6_m7_forest_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    branch = models.train_branch(_documents(spark, sf_dir), FEATURES)
    return evaluation.predictions(branch.scored, branch.threshold)


def _rules_branch(spark: SparkSession, sf_dir: str) -> models.Branch:
    rows = materialize(evaluation.chronological_split(rule_scores(spark, sf_dir), bucket_us=DAY), "rule-rows")
    return models.train_branch(rows, ["protocol_score", "stat_score"])


@query()
def d6_rules_only_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest over the two rule scores alone."""
    branch = _rules_branch(spark, sf_dir)
    return evaluation.predictions(branch.scored, branch.threshold)


@query(f"""WITH e AS ({EVENTS}), p AS (SELECT line AS id, seed::INT AS label, row_number() OVER (ORDER BY us, line) AS k, count(*) OVER () AS n FROM e),
c AS (SELECT *, least(greatest(round_even(n * 0.2, 0)::BIGINT, 1), n - 2) AS t FROM p) SELECT id, label, true AS scored, true AS decided FROM c WHERE k > n - t""")
def d6_test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the branch of the rule scores tells, their labels, and whether score and decision are such."""
    branch = _rules_branch(spark, sf_dir)
    rows = evaluation.predictions(branch.scored, branch.threshold)
    return rows.select("id", "label", F.col("score").between(0, 1).alias("scored"), (F.col("predicted") == (F.col("score") >= branch.threshold).cast("int")).alias("decided"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("line", "us", F.col("stream").alias("grp"), F.col("ctl").cast("double").alias("ctl"), "size", (F.col("service") == "error").cast("double").alias("failed"), F.col("seed").cast("int").alias("label"))
    found = sequences.windows(rows, STEPS)
    split = evaluation.chronological_split(found.select(F.col("end_line").alias("id"), F.col("end_us").alias("us")), bucket_us=24 * 3600 * 1_000_000).select(F.col("id").alias("end_line"), "split")
    return materialize(found.join(split, "end_line"), "branch-windows")


SPLIT = """WITH d AS (SELECT d.doc_id AS id, 1 - quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE text IS NOT NULL),
p AS (SELECT *, row_number() OVER (ORDER BY id) AS k, count(*) OVER () AS n FROM d), c AS (SELECT *, least(greatest(round_even(n * 0.2, 0)::BIGINT, 1), n - 2) AS t FROM p)"""


@query(f"{SPLIT} SELECT id, label, true AS scored, true AS decided FROM c WHERE k > n - t")
def m6_m7_test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows the refitted forest scores, their labels, and whether score and decision are such."""
    branch = models.train_branch(_documents(spark, sf_dir), FEATURES)
    rows = evaluation.predictions(branch.scored, branch.threshold)
    return rows.select("id", "label", F.col("score").between(0, 1).alias("scored"), (F.col("predicted") == (F.col("score") >= branch.threshold).cast("int")).alias("decided"))


@query()
def m8_sequence_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    branch = models.sequence_branch(_windows(spark, sf_dir), STEPS)
    return evaluation.predictions(branch.scored, branch.threshold, ("end_line", "label"))


@query()
def m10_m13_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two branches scored out of fold, joined with two rule scores, and combined."""
    wide = sequences.flatten(_windows(spark, sf_dir), STEPS)
    e = events(spark, sf_dir).select("line", (F.col("ctl") / 2.0).alias("protocol_score"), F.least(F.col("size"), F.lit(50.0)).alias("stat_score"))
    rows = materialize(evaluation.time_folds(models.align(wide, e).withColumn("id", F.col("end_line")).withColumn("us", F.col("end_us")), 3, 24 * 3600 * 1_000_000), "fusion-rows")
    steps = [c for c in rows.columns if "_t_minus_" in c or c.endswith("_t0")]
    tabular = models.out_of_fold(rows, ["ctl_t0", "size_t0", "failed_t0"], "tabular", 3, expanding=True)
    sequence = models.out_of_fold(rows, steps, "sequence", 3, expanding=True).select("id", "sequence")
    joined = tabular.join(sequence, "id")
    joined = materialize(joined, "fusion-scores")
    meta = models.meta_features(joined, F.col("tabular"), F.col("sequence"), F.col("protocol_score"), F.col("stat_score"))
    combiner = models.fit_combiner(meta.where("fold < 3"), models.META)
    return evaluation.predictions(models.scores(combiner, meta.where("fold = 3")), 0.5)
