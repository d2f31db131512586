"""A quality classifier: a sparse ensemble of rules.

Shallow trees over a document's statistics are grown; each path from a root to a node is a
conjunctive rule; a lasso logistic fit over the rules keeps few of them; and the kept ones
are compiled into one Spark column expression, so that scoring is a projection.

Labels are learned only from rows outside the held-out fold (crc32 of the id), and from a
sample of at most about ``SAMPLE_ROWS`` labelled rows, picked by a hash of the id. Scores use
statistics of the text alone.

Defined results: null and empty texts have zero statistics and get a score; null ids are
held in no fold and scored; repeated rows each give a row; an empty table gives an empty
result; without labels of both kinds every score is the smoothed share of label 1; repeated
labels each count; other columns are ignored. Texts are measured whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import measure
from .util import held_out, materialize

SAMPLE_ROWS, TREES, DEPTH, LASSO, SEED = 20_000, 16, 3, 0.002, 11

_PER = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
#: Statistics the rules speak of.
STATISTICS = ("log_words", "word_length", "symbols", "duplicate_lines", "repeated", "letters", "capitals", "exclamations", "line_words")


def statistics(measured: DataFrame, *keep: str) -> DataFrame:
    values = {
        "log_words": F.log1p(F.col("n_words")),
        "word_length": _PER("word_chars", "n_words"),
        "symbols": _PER("n_symbols", "n_words"),
        "duplicate_lines": _PER("n_dup_lines", "n_lines"),
        "repeated": _PER("n_repeat_words", "n_words"),
        "letters": _PER("n_letters", "word_chars"),
        "capitals": _PER("n_upper", "n_letters"),
        "exclamations": _PER("n_exclaim", "n_words"),
        "line_words": _PER("n_words", "n_lines"),
    }
    return measured.select(*keep, *[values[name].cast("double").alias(name) for name in STATISTICS])


@dataclass(frozen=True)
class Bound:
    statistic: str
    above: bool
    at: float

    def column(self) -> Column:
        c = F.col(self.statistic)
        return c > self.at if self.above else c <= self.at


Rule = tuple[Bound, ...]


def simplified(path: list[Bound]) -> Rule:
    """One bound for each statistic and side: the tightest."""
    tight: dict[tuple[str, bool], float] = {}
    for b in path:
        key = (b.statistic, b.above)
        tight[key] = b.at if key not in tight else (max if b.above else min)(tight[key], b.at)
    return tuple(Bound(s, above, at) for (s, above), at in sorted(tight.items()))


def tree_rules(root, names: list[str]) -> list[Rule]:
    """The rule of every node below the root of an MLlib tree."""
    rules, todo = [], [(root, [])]
    while todo:
        node, path = todo.pop()
        if path:
            rules.append(simplified(path))
        if node.getClass().getSimpleName() != "LeafNode":
            split = node.split()
            name, at = names[split.featureIndex()], float(split.threshold())
            todo.append((node.leftChild(), [*path, Bound(name, False, at)]))
            todo.append((node.rightChild(), [*path, Bound(name, True, at)]))
    return rules


def matches(rule: Rule) -> Column:
    found = F.lit(True)
    for b in rule:
        found = found & b.column()
    return found


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules and an intercept."""

    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self) -> Column:
        """The chance of label 1 as a column over the statistics."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(matches(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))


def fit(sample: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = SEED) -> Ensemble:
    """sample: the statistics and ``label`` (0 or 1)."""
    counts = {int(r["label"]): r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, total = counts.get(1, 0), sum(counts.values())
    if not ones or ones == total:
        p = (ones + 1) / (total + 2)
        return Ensemble((), math.log(p / (1 - p)))
    names = list(STATISTICS)
    data = sample.select(F.col("label").cast("double").alias("label"), array_to_vector(F.array(*names)).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=max(1, total // 1000), featureSubsetStrategy="sqrt").fit(data)
    rules = sorted({r for t in forest.trees for r in tree_rules(t._java_obj.rootNode(), names)}, key=repr)
    fired = sample.select(F.col("label").cast("double").alias("label"), array_to_vector(F.array(*[matches(r).cast("double") for r in rules])).alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(fired)
    kept = tuple((r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w)
    return Ensemble(kept, float(model.intercept))


def training_rows(stats: DataFrame, labels: DataFrame, label_col: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics and label of a bounded sample of labelled rows outside the held-out fold."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label_col).alias("label"))
    share = min(1.0, sample_rows / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    return stats.join(picked, "doc_id").select("label", *STATISTICS)


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    stats = materialize(statistics(measure(docs, id_col, text_col), "doc_id"), "classifier-statistics")
    sample = materialize(training_rows(stats, labels, label_col), "classifier-sample").persist()
    try:
        model = fit(sample)
    finally:
        sample.unpersist()
    scored = stats.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
