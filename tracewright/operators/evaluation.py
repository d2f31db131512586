"""Splits, thresholds and metrics for detectors.

Scored rows have columns: id (unique), label (0 or 1), score, grp (group id), us (time).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import dense_numbers, running_sums

CANDIDATES = 500
QUARTER_US = 900 * 1_000_000


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


# -- groups and splits --------------------------------------------------------------------


def scenario_groups(rows: DataFrame, scenario: str = "scenario", group: str | None = "grp", us: str | None = "us", line: str = "line") -> DataFrame:
    """Add gid: the scenario, else "normal", the group and a quarter of an hour (or 500 lines)."""
    found = F.trim(F.coalesce(F.col(scenario), F.lit("")))
    parts = [F.lit("normal")]
    if group:
        parts.append(F.coalesce(F.col(group).cast("string"), F.lit("")))
    parts.append(F.coalesce(F.floor(F.col(us) / QUARTER_US), F.lit(-1)).cast("string") if us else F.floor(F.col(line) / 500).cast("string"))
    return rows.withColumn("gid", F.when(found != "", found).otherwise(F.concat_ws("|", *parts)))


def _half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("bigint")


def group_split(rows: DataFrame, test_size: float = 0.25, seed: int = 42, gid: str = "gid") -> DataFrame:
    """Add split: whole groups go to train or test, by quota for groups with and without positives.

    Which groups of a class go to test is drawn by a hash of group and seed. Ranks are taken
    within class; a group table has one row a group. A class of one group stays in train; where a
    class has no group, the other one gives all that are asked for.
    """
    groups = rows.groupBy(gid).agg(F.max("label").alias("positive"))
    sizes = groups.agg(F.count(F.lit(1)).alias("n"), F.sum("positive").cast("bigint").alias("p"))
    none = F.lit(0)
    asked = F.least(F.greatest(_half_even(F.col("n") * test_size) if test_size < 1 else F.lit(int(test_size)), F.lit(2)), F.col("n") - 2)
    quota = sizes.withColumn("asked", F.greatest(asked, none)).withColumn("neg", F.col("n") - F.col("p"))
    want = F.least(F.greatest(_half_even(F.col("asked") * F.col("p") / F.col("n")), F.lit(1)), F.col("p") - 1)
    quota = quota.withColumn("want", F.greatest(want, none))
    want_neg = F.least(F.greatest(F.col("asked") - F.col("want"), F.lit(1)), F.col("neg") - 1)
    quota = quota.withColumn("want_neg", F.greatest(want_neg, none)).withColumn("want_pos", F.greatest(F.col("asked") - F.col("want_neg"), none))
    place = dense_numbers(
        groups.withColumn("h", F.xxhash64(gid, F.lit(seed))).withColumn("key", F.struct("positive", "h", gid)), "place", F.col("key"),
        F.struct("positive", F.floor(F.col("h") / F.lit(1 << 56)).alias("b")),
    )
    negatives = F.col("n") - F.col("p")
    test = F.when(F.col("positive") == 1, F.col("place") - negatives <= F.col("want_pos")).otherwise(F.col("place") <= F.col("want_neg"))
    named = place.crossJoin(F.broadcast(quota)).select(gid, F.when(test, "test").otherwise("train").alias("split"))
    return rows.join(named, gid)


def _resolve(n: Column, size: float, least: Column, most: Column) -> Column:
    return F.least(F.greatest(_half_even(n * size) if 0 < size < 1 else F.lit(int(size)), least), most)


def chronological_split(rows: DataFrame, test_size: float = 0.2, val_size: float = 0.2, bucket_us: int = 3600 * 1_000_000) -> DataFrame:
    """Add split by order of time: train, then val, then test. Rows without a time are left out."""
    timed = rows.where("us IS NOT NULL")
    placed = dense_numbers(timed.withColumn("_at", F.struct("us", "id")), "place", F.col("_at"), F.floor(F.col("us") / bucket_us)).drop("_at")
    one = F.lit(1)
    n = timed.agg(F.count(F.lit(1)).alias("n")).withColumn("test_n", _resolve(F.col("n"), test_size, one, F.col("n") - 2))
    n = n.withColumn("val_n", _resolve(F.col("n") - F.col("test_n"), val_size, one, F.col("n") - F.col("test_n") - 1))
    train_n = F.col("n") - F.col("test_n") - F.col("val_n")
    split = F.when(F.col("place") <= train_n, "train").when(F.col("place") <= train_n + F.col("val_n"), "val").otherwise("test")
    return placed.crossJoin(F.broadcast(n)).withColumn("split", split).drop("n", "test_n", "val_n", "place")


def time_folds(rows: DataFrame, folds: int = 4, bucket_us: int = 3600 * 1_000_000) -> DataFrame:
    """Add fold: 0 is trained on only; fold i is tested after training on all folds before it.

    Test chunks have n // (folds + 1) rows each; what is left over goes to fold 0.
    """
    placed = dense_numbers(rows.where("us IS NOT NULL").withColumn("_at", F.struct("us", "id")), "place", F.col("_at"), F.floor(F.col("us") / bucket_us)).drop("_at")
    n = rows.where("us IS NOT NULL").agg(F.count(F.lit(1)).alias("n"))
    chunk = F.floor(F.col("n") / (folds + 1))
    first = F.col("n") - chunk * folds
    fold = F.when(F.col("place") <= first, 0).otherwise(F.floor((F.col("place") - first - 1) / chunk) + 1).cast("int")
    return placed.crossJoin(F.broadcast(n)).withColumn("fold", fold).drop("n", "place")


def group_folds(rows: DataFrame, folds: int = 4, gid: str = "gid") -> DataFrame:
    """Add fold: groups by falling size are dealt to the folds in turn."""
    sizes = rows.groupBy(gid).agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.struct(-F.col("n"), F.col(gid)))
    placed = dense_numbers(sizes, "place", F.col("key"), -F.col("n"))
    return rows.join(placed.select(gid, ((F.col("place") - 1) % folds).cast("int").alias("fold")), gid)


#: Columns that would leak the label or the identity of an event.
LEAKING = ("line_number", "event_timestamp", "supervised_is_anomaly", "is_anomaly", "heuristic_is_anomaly", "final_tag", "seed_is_attack")
EXPERT = ("protocol_score", "stat_score", "anomaly_score")
IDENTITY_SUFFIX = "_cat"


def feature_columns(df: DataFrame, label: str, expert: bool = False, identity: bool = False, drop: Sequence[str] = ()) -> list[str]:
    """Numeric columns that may be learned from."""
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint", "boolean")
    out = []
    for name, kind in df.dtypes:
        leaks = name == label or name in LEAKING or name in drop or name.startswith("scenario_")
        if kind in numeric and not leaks and (expert or name not in EXPERT) and (identity or not name.endswith(IDENTITY_SUFFIX)):
            out.append(name)
    return out


# -- curves, thresholds, metrics -----------------------------------------------------------


def curve(scored: DataFrame) -> DataFrame:
    """score, tp, fp, pos, neg: what each distinct score as a threshold would find."""
    counts = scored.groupBy("score").agg(F.sum("label").cast("bigint").alias("p"), (F.count(F.lit(1)) - F.sum("label")).cast("bigint").alias("q"))
    block = -F.floor(F.col("score") * 256)
    running = running_sums(counts.withColumn("key", -F.col("score")), {"p": "tp", "q": "fp"}, F.col("key"), block)
    totals = counts.agg(F.sum("p").alias("pos"), F.sum("q").alias("neg"))
    return running.crossJoin(F.broadcast(totals)).select("score", "p", "q", "tp", "fp", "pos", "neg")


def row_threshold(scored: DataFrame) -> DataFrame:
    """threshold, f1: the lowest threshold of the highest F1 over rows."""
    at = curve(scored).withColumn("f1", _safe(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")))
    best = at.agg(F.max_by("score", F.struct("f1", -F.col("score"))).alias("threshold"), F.max("f1").alias("f1"), F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    one_class = (F.coalesce("pos", F.lit(0)) == 0) | (F.coalesce("neg", F.lit(0)) == 0)
    return best.select(F.when(one_class, 0.5).otherwise(F.col("threshold")).alias("threshold"), "f1")


def group_scores(scored: DataFrame) -> DataFrame:
    """One row a group: its highest score, and whether any row is positive."""
    return scored.groupBy("grp").agg(F.max("label").alias("label"), F.count(F.lit(1)).alias("rows"), F.sum("label").cast("bigint").alias("positives"), F.max("score").alias("score"), F.avg("score").alias("mean_score"))


def scenario_threshold(scored: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """threshold, f1, recall: the best of at most ``most`` group scores and 0.5 for F1 over groups;
    equals are decided by recall, then by the lower threshold."""
    groups = group_scores(scored)
    values = dense_numbers(groups.select("score").distinct(), "k", F.col("score"), F.floor(F.col("score") * 256))
    n = values.agg(F.count(F.lit(1)).alias("n"))
    step = F.when(F.col("n") > most, F.floor(F.col("i") * (F.col("n") - 1) / (most - 1)) + 1).otherwise(F.col("i") + 1)
    wanted = n.select(F.explode(F.sequence(F.lit(0), F.least("n", F.lit(most)).cast("int") - 1)).alias("i"), "n").select(step.alias("k")).distinct()
    candidates = values.join(F.broadcast(wanted), "k").select(F.col("score").alias("t")).union(scored.sparkSession.range(1).select(F.lit(0.5).alias("t"))).distinct()
    # groups are counted between neighbouring candidates first, so groups never meet all candidates
    counts = curve(groups.select("score", "label"))
    steps = counts.select(F.col("score").alias("t"), "p", "q", F.lit(0).alias("c")).unionByName(candidates.select("t", F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("q"), F.lit(1).alias("c")))
    totals = counts.agg(F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    at = running_sums(steps.withColumn("key", F.struct(-F.col("t"), F.col("c"))), {"p": "tp", "q": "fp"}, F.col("key"), -F.floor(F.col("t") * 256)).where("c = 1").crossJoin(F.broadcast(totals))
    f1, recall = _safe(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")), F.col("tp") / F.greatest("pos", F.lit(1))
    rated = at.select("t", F.round(f1, 12).alias("f1"), F.round(recall, 12).alias("recall"), "pos", "neg")
    best = rated.agg(F.max_by("t", F.struct("f1", "recall", -F.col("t"))).alias("threshold"), F.max("f1").alias("f1"), F.max_by("recall", F.struct("f1", "recall")).alias("recall"), F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    return best.select(F.when((F.col("pos") == 0) | (F.col("neg") == 0), 0.5).otherwise(F.col("threshold")).alias("threshold"), "f1", "recall")


def confusion(scored: DataFrame, predicted: Column) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    y = F.col("label") == 1
    return scored.agg(n(y & predicted).alias("tp"), n(~y & predicted).alias("fp"), n(y & ~predicted).alias("fn"), n(~y & ~predicted).alias("tn"))


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and balanced accuracy from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, specificity = _safe(tp, tp + fn), _safe(tn, tn + fp)
    both = (tp + fn > 0) & (tn + fp > 0)
    balanced = F.when(both, (recall + specificity) / 2).when(tp + fn > 0, recall).otherwise(specificity)
    return counts.select("*", _safe(tp, tp + fp).alias("precision"), recall.alias("recall"), _safe(2 * tp, 2 * tp + fp + fn).alias("f1"), balanced.alias("balanced_accuracy"))


def ranking(scored: DataFrame) -> DataFrame:
    """Average precision (a step sum, not the trapezoid) and ROC AUC (ties count half)."""
    at = curve(scored)
    ap = F.sum((F.col("p") / F.col("pos")) * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    auc = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)) / (F.max("pos") * F.max("neg"))
    both = (F.max("pos") > 0) & (F.max("neg") > 0)
    return at.agg(F.when(F.max("pos") > 0, ap).otherwise(0.0).alias("average_precision"), F.when(both, auc).alias("roc_auc"))


def row_metrics(scored: DataFrame, threshold: float) -> DataFrame:
    return rates(confusion(scored, F.col("score") >= threshold)).crossJoin(F.broadcast(ranking(scored)))


def group_metrics(scored: DataFrame, threshold: float) -> DataFrame:
    return row_metrics(group_scores(scored).select("score", "label"), threshold)


def predictions(scored: DataFrame, threshold: float, keep: Sequence[str] = ("id", "label")) -> DataFrame:
    return scored.select(*keep, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
