"""Detector branches: forests over features or windows, and their fusion by MLlib."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import forest
from .evaluation import row_threshold
from .forest import Forest
from .sequences import flatten

TREES, DEPTH, LEAF, SEED = 300, 12, 2, 42


def with_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Add weight: rows of both classes weigh the same in all. Two counts are broadcast."""
    n = rows.agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_p"))
    own = F.when(F.col(label) == 1, F.col("_p")).otherwise(F.col("_n") - F.col("_p"))
    return rows.crossJoin(F.broadcast(n)).withColumn("weight", F.col("_n") / (2.0 * F.greatest(own, F.lit(1)))).drop("_n", "_p")


def fit_forest(train: DataFrame, features: Sequence[str], label: str = "label", trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = SEED) -> Forest:
    """Balanced classes; see ``forest`` for how cells of equal rows are counted."""
    return forest.fit(train, features, label, trees, depth, leaf, seed)


def fit_combiner(train: DataFrame, features: Sequence[str], label: str = "label") -> PipelineModel:
    """Balanced logistic regression over branch scores."""
    assemble = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    logistic = LogisticRegression(labelCol=label, weightCol="weight", maxIter=100, regParam=0.0)
    return Pipeline(stages=[assemble, logistic]).fit(with_weights(train, label))


def scores(model: Forest | PipelineModel, rows: DataFrame, out: str = "score") -> DataFrame:
    """Add the chance of label 1; the model's own columns are dropped."""
    if isinstance(model, Forest):
        return rows.withColumn(out, model.score(rows))
    found = model.transform(rows).withColumn(out, vector_to_array("probability")[1])
    return found.drop("features", "rawPrediction", "probability", "prediction", "weight")


def importances(model: Forest, features: Sequence[str]) -> list[tuple[str, float]]:
    """Features by falling importance."""
    return sorted(zip(features, map(float, model.importances), strict=True), key=lambda x: (-x[1], x[0]))


@dataclass(frozen=True)
class Branch:
    """A fitted detector: its threshold from the validation part, and the scored test part."""

    model: Forest
    threshold: float
    scored: DataFrame


def train_branch(rows: DataFrame, features: Sequence[str], **options) -> Branch:
    """rows: split (train, val, test), label and features. The threshold comes from a model of
    train on val; the model that scores test is fitted on both."""
    first = fit_forest(rows.where("split = 'train'"), features, **options)
    best = row_threshold(scores(first, rows.where("split = 'val'")).select("label", "score")).first()
    threshold = 0.5 if best is None or best["threshold"] is None else float(best["threshold"])
    final = fit_forest(rows.where("split <> 'test'"), features, **options)
    return Branch(final, threshold, scores(final, rows.where("split = 'test'")))


def sequence_branch(found: DataFrame, features: Sequence[str], size: int = 8, **options) -> Branch:
    """The same over flattened windows (with split and label)."""
    wide = flatten(found, features, size)
    inputs = [c for c in wide.columns if "_t_minus_" in c or c.endswith("_t0")]
    return train_branch(wide.fillna(0.0, subset=inputs), inputs, **options)


def align(windows: DataFrame, rows: DataFrame) -> DataFrame:
    """Windows with the row they end at."""
    own = [c for c in rows.columns if c not in windows.columns]
    return windows.join(rows.select(F.col("line").alias("end_line"), *[c for c in own if c != "line"]), "end_line")


def meta_features(rows: DataFrame, tabular: Column, sequence: Column, protocol: Column, stat: Column) -> DataFrame:
    return rows.withColumns(
        {
            "tabular_score": tabular, "sequence_score": sequence, "rule_protocol": protocol, "rule_stat": stat,
            "score_max": F.greatest(tabular, sequence), "rule_sum": protocol + stat,
        }
    )


META = ("tabular_score", "sequence_score", "rule_protocol", "rule_stat", "score_max", "rule_sum")


def out_of_fold(rows: DataFrame, features: Sequence[str], out: str, folds: int, expanding: bool = False, **options) -> DataFrame:
    """Scores of each fold by a model of the others (of the earlier ones, if ``expanding``).

    A fold is left out where its training rows lack a class. Folds are fitted one after the
    other; each fit is distributed.
    """
    parts = []
    for fold in range(1 if expanding else 0, folds + 1 if expanding else folds):
        train = rows.where(F.col("fold") < fold if expanding else F.col("fold") != fold)
        seen = train.agg(F.min("label").alias("a"), F.max("label").alias("b")).first()
        if seen["a"] is None or seen["a"] == seen["b"]:
            continue
        parts.append(scores(fit_forest(train, features, **options), rows.where(F.col("fold") == fold), out))
    if not parts:
        return rows.withColumn(out, F.lit(None).cast("double")).limit(0)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found
