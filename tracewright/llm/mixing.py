"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic; a topic is a cluster of hashed term
vectors where the documents don't name one. The cells' token weights are raked
until their sums along each dimension meet the target shares; a document's inclusion
probability then follows from its cell, and documents are drawn by a hash of their id.

The driver sees the filled cells only, with their tokens: as many as there are combinations of
sources, languages and topics. Every category is raked by itself; in a dimension with targets
those that no target names share one category, OTHER.

No cell gives more tokens than it has, so scarce categories bound what can be kept: the kept
tokens meet the targets in expectation as they are, each document counting once, and the
corpus is cut to the largest size up to ``budget`` that allows this. ``weight`` is 1 but for
rounding. Targets that no weights of the filled cells can meet give way to the sums that
raking ends with.

Defined results: null sources and languages are the category "(null)"; documents without
tokens weigh nothing and are always kept; rows with the same id share their fate; an empty
table gives an empty result; other columns stay as they are, but those of the names that
``prepared`` and ``mix`` add are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import discard, materialize, words

OTHER, NULL, NONE = "(other)", "(null)", "(none)"
#: Topics, and the hashed terms they are told by.
TOPICS, TERMS = 12, 512
#: Points that a task of the clustering holds on the average.
POINTS_A_TASK = 4096
#: Clusters with a smaller share of the distinct texts have no name of their own.
LEAST_TOPIC = 0.03
#: So many cells are sent to all tasks; more are joined.
MOST_BROADCAST = 200_000
DIMENSIONS = ("source", "lang", "topic")


def token_weight(text: Column) -> Column:
    return F.size(words(text)).cast("long")


@dataclass(frozen=True)
class Topics:
    """Stages from the column ``_terms`` (words) to the cluster ``_topic``, and the clusters large enough for a name."""

    stages: PipelineModel
    named: tuple[int, ...]


def terms(text: Column) -> Column:
    return words(F.lower(text))


def fit_topics(docs: DataFrame, text_col: str = "text", topics: int = TOPICS) -> Topics | None:
    """Clusters of the texts by their hashed terms, which weigh more the rarer they are.

    Weights come from all distinct texts, clusters from all distinct vectors of theirs (told apart
    by 64-bit hashes). Points are dealt and ordered by these hashes, whatever the order of the
    documents. None where fewer than two differ.
    """
    known = docs.where(F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).select(F.xxhash64(text_col, F.lit(3)).alias("key"), terms(F.col(text_col)).alias("_terms"))
    counts = HashingTF(inputCol="_terms", outputCol="_counts", numFeatures=TERMS, binary=True)
    # a text is its terms' few places from here on
    hashed = counts.transform(known).select("key", "_counts", F.xxhash64(vector_to_array("_counts"), F.lit(3)).alias("point"))
    texts = materialize(hashed.groupBy("key").agg(F.first("_counts").alias("_counts"), F.first("point").alias("point")), "topic-texts")
    if texts.isEmpty():
        return None
    idf = IDF(inputCol="_counts", outputCol="_weighted").fit(texts)
    unit = Normalizer(inputCol="_weighted", outputCol="_features")
    points = materialize(texts.groupBy("point").agg(F.first("_counts").alias("_counts")), "topic-points")
    n = points.count()
    discard(texts)
    k = min(topics, n)
    if k < 2:
        return None
    # dealt by the points alone, so that the first centers are the same on any machine; weights come after, as they take more room
    dealt = points.repartition(-(-n // POINTS_A_TASK), "point").sortWithinPartitions("point")
    vectors = unit.transform(idf.transform(dealt)).select("_features")
    clusters = KMeans(k=k, seed=5, maxIter=15, initMode="random", featuresCol="_features", predictionCol="_topic").fit(vectors)
    sizes = clusters.summary.clusterSizes
    return Topics(PipelineModel([counts, idf, unit, clusters]), tuple(i for i, x in enumerate(sizes) if x >= LEAST_TOPIC * sum(sizes)))


def with_topic(docs: DataFrame, found: Topics | None, text_col: str = "text") -> DataFrame:
    """Add topic: the cluster of a text's terms, OTHER if that is a small one; "(none)" without words."""
    if found is None:
        return docs.withColumn("topic", F.lit(NONE))
    own = ("_terms", "_counts", "_weighted", "_features", "_topic")
    told = found.stages.transform(docs if "_terms" in docs.columns else docs.withColumn("_terms", terms(F.col(text_col))))
    name = F.when(F.size("_terms") == 0, NONE).when(F.col("_topic").isin(list(found.named)), F.concat(F.lit("topic-"), F.col("_topic").cast("string"))).otherwise(OTHER)
    return told.withColumn("topic", name).drop(*own)


def rake(mass: np.ndarray, targets: Sequence[np.ndarray], rounds: int = 200, tol: float = 1e-10) -> np.ndarray:
    """Fit an array of cell masses to target shares along each axis.

    Categories without mass can't be reached; their share goes to the others in proportion.
    """
    fit = mass / mass.sum() if mass.sum() else mass.astype(float)
    goals = []
    for axis, target in enumerate(targets):
        sums = mass.sum(axis=tuple(i for i in range(mass.ndim) if i != axis))
        goal = np.where(sums > 0, target, 0.0)
        goals.append(goal / goal.sum() if goal.sum() else np.where(sums > 0, 1.0, 0.0) / max(1, (sums > 0).sum()))
    for _ in range(rounds):
        off = 0.0
        for axis, goal in enumerate(goals):
            sums = fit.sum(axis=tuple(i for i in range(fit.ndim) if i != axis))
            factor = np.divide(goal, sums, out=np.zeros_like(goal), where=sums > 0)
            off = max(off, float(np.abs(sums - goal).max(initial=0)))
            fit = fit * factor.reshape([-1 if i == axis else 1 for i in range(fit.ndim)])
        if off < tol:
            break
    return fit


def bounded(mass: np.ndarray, goals: Sequence[np.ndarray], kept: float, rounds: int = 500, tol: float = 1e-8) -> np.ndarray | None:
    """Masses of at most ``mass`` whose sums along each axis are kept * goal; None if none are found.

    A cell is mass * min(1, x y z) with a factor for each of its categories. An axis' factors are
    solved exactly in turn: for a given number of saturated cells the sum is linear in the factor.
    """
    factors = [np.ones(n) for n in mass.shape]
    axes = range(mass.ndim)
    for _ in range(rounds):
        for axis, goal in enumerate(goals):
            own = np.moveaxis(mass, axis, 0).reshape(mass.shape[axis], -1)
            rest = np.multiply.outer(*[factors[i] for i in axes if i != axis]).ravel()
            order = np.argsort(-rest, kind="stable")
            rest, own = rest[order], own[:, order]
            saturated = np.cumsum(own, axis=1) - own
            open_ = np.cumsum((own * rest)[:, ::-1], axis=1)[:, ::-1]
            factor = np.divide(kept * goal[:, None] - saturated, open_, out=np.full_like(own, np.inf), where=open_ > 0)
            fits = factor * rest <= 1
            first = factor[np.arange(len(factor)), fits.argmax(axis=1)]
            top = 1 / rest[rest > 0].min() if (rest > 0).any() else 1.0
            factors[axis] = np.where(goal > 0, np.where(fits.any(axis=1), np.clip(first, 0, top), top), 0.0)
        found = mass * np.minimum(1, np.einsum("i,j,k->ijk", *factors))
        if all(np.abs(found.sum(axis=tuple(i for i in axes if i != a)) - kept * g).max() < tol * kept for a, g in enumerate(goals)):
            return found
    return None


def largest(mass: np.ndarray, fit: np.ndarray, budget: float, steps: int = 12) -> np.ndarray:
    """The largest masses found, of at most ``mass`` and ``budget`` in all, with the marginals of
    ``fit``. The scaled fit itself, which ends at its tightest cell, is the least of them."""
    total = float(mass.sum())
    if not total:
        return fit
    mass, budget = mass / total, budget / total
    goals = [fit.sum(axis=tuple(i for i in range(fit.ndim) if i != a)) for a in range(fit.ndim)]
    tightest = float(np.divide(fit, mass, out=np.zeros_like(fit), where=mass > 0).max())
    best = fit * min(budget, 1 / tightest)
    sums = [mass.sum(axis=tuple(i for i in range(mass.ndim) if i != a)) for a in range(mass.ndim)]
    high = min(budget, 0.9999 * min(float((s[g > 0] / g[g > 0]).min()) for s, g in zip(sums, goals, strict=True)))
    low, kept = float(best.sum()), high
    for _ in range(steps):
        if kept <= low * (1 + 1e-4):
            break
        found = bounded(mass, goals, kept)
        if found is None:
            high = kept
        else:
            best, low = found, kept
        kept = high if low >= high else (low + high) / 2
    return best * total


def inclusion(mass: np.ndarray, share: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """Probability and weight of each cell, so that ``budget`` tokens are expected."""
    ratio = np.divide(share, mass, out=np.zeros_like(share), where=mass > 0)
    low, high = 0.0, 1.0
    reached = lambda k: float((mass * np.minimum(1, k * ratio)).sum())
    budget = min(budget, float(mass[ratio > 0].sum()) * (1 - 1e-12))
    while reached(high) < budget:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if reached(middle) < budget else (low, middle)
    p = np.minimum(1.0, high * ratio)
    return p, np.divide(high * ratio, p, out=np.ones_like(p), where=p > 0)


def tempered(totals: Mapping[str, float], alpha: float) -> dict[str, float]:
    """Shares in proportion to tokens^alpha."""
    raised = {k: v**alpha for k, v in totals.items() if v > 0}
    return {k: v / sum(raised.values()) for k, v in raised.items()}


def with_cells(docs: DataFrame, known: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add cell columns: a dimension's value, or OTHER if it has known ones and isn't among them."""
    for d in DIMENSIONS:
        value = F.coalesce(F.col(d).cast("string"), F.lit(NULL))
        docs = docs.withColumn(f"{d}_cell", F.when(value.isin(list(known[d])), value).otherwise(F.lit(OTHER)) if d in known else value)
    return docs


def cell_weights(
    docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = 0.8, alpha: float = 0.7
) -> tuple[list[tuple], dict[str, list[str]]]:
    """Rows (source, lang, topic, p, weight) of all cells, and the categories that targets name.

    docs: source, lang, topic, n_tokens. ``budget`` is the largest share of all tokens to keep. A dimension without a target gets shares in
    proportion to its categories' tokens^alpha.
    """
    targets = targets or {}
    known = {d: [k for k in targets[d] if k != OTHER] for d in DIMENSIONS if d in targets}
    cells = with_cells(docs, known).groupBy(*[f"{d}_cell" for d in DIMENSIONS]).agg(F.sum("n_tokens").alias("n")).collect()
    axes = {d: sorted({r[f"{d}_cell"] for r in cells}) for d in DIMENSIONS}
    mass = np.zeros([len(axes[d]) for d in DIMENSIONS])
    at = [{k: i for i, k in enumerate(axes[d])} for d in DIMENSIONS]
    for r in cells:
        mass[tuple(a[r[f"{d}_cell"]] for a, d in zip(at, DIMENSIONS, strict=True))] += float(r["n"] or 0)
    goals = []
    for i, d in enumerate(DIMENSIONS):
        sums = dict(zip(axes[d], mass.sum(axis=tuple(j for j in range(3) if j != i)), strict=True))
        goal = targets.get(d) or tempered(sums, alpha)
        goals.append(np.array([goal.get(k, 0.0) for k in axes[d]], dtype=float))
    wanted = largest(mass, rake(mass, goals), budget * float(mass.sum()))
    p, weight = inclusion(mass, wanted, float(wanted.sum()))
    rows = [(*keys, float(p[tuple(a[k] for a, k in zip(at, keys, strict=True))]), float(weight[tuple(a[k] for a, k in zip(at, keys, strict=True))])) for keys in (tuple(r[f"{d}_cell"] for d in DIMENSIONS) for r in cells)]
    return rows, known


def draw(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on id and seed only."""
    return F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 40)).cast("double") / float(1 << 40)


def mix(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", **options) -> DataFrame:
    """Add p, weight and kept. docs: source, lang, topic, n_tokens and any other columns."""
    cell_names = [f"{d}_cell" for d in DIMENSIONS]
    docs = docs.drop("p", "weight", "kept", *cell_names)
    rows, known = cell_weights(docs.select(*DIMENSIONS, "n_tokens"), **options)
    found = docs.sparkSession.createDataFrame(rows, ", ".join(f"{c} string" for c in cell_names) + ", p double, weight double")
    joined = with_cells(docs, known).join(F.broadcast(found) if len(rows) <= MOST_BROADCAST else found, cell_names, "left")
    free = F.col("n_tokens") == 0
    return (
        joined.withColumn("p", F.when(free, 1.0).otherwise(F.coalesce("p", F.lit(0.0))))
        .withColumn("weight", F.when(free, 1.0).otherwise(F.coalesce("weight", F.lit(1.0))))
        .withColumn("kept", draw(F.col(id_col), seed) < F.col("p"))
        .drop(*cell_names)
    )


def prepared(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, and with a topic unless they have one, as mix wants them."""
    if "topic" in docs.columns:
        return docs.withColumn("n_tokens", token_weight(F.col(text_col)))
    # split once: case doesn't change the number of words
    cut = docs.withColumn("_terms", terms(F.col(text_col)))
    return with_topic(cut.withColumn("n_tokens", F.size("_terms").cast("long")), fit_topics(docs, text_col), text_col).drop("_terms")
