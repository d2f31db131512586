"""Cases of the third round's findings."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import mixing
from tracewright.operators import evaluation, forest, models, ordering, protocol
from tracewright.plans import catalog


@pytest.fixture(scope="module")
def one_class(tmp_path_factory):
    """Tables of scored documents whose groups all hold a positive."""
    at = tmp_path_factory.mktemp("one-class")
    c = duckdb.connect()
    c.execute(f"COPY (SELECT i AS doc_id, 'text' AS text, 'en' AS lang, 'src' || (i % 2) AS source, 100 + i % 9 AS n_chars FROM range(1200) t(i)) TO '{at}/documents.parquet'")
    c.execute(f"COPY (SELECT i AS doc_id, (i % 11 > 0)::INT AS quality, 0 AS toxic FROM range(1200) t(i)) TO '{at}/labels.parquet'")
    for name in ("documents", "labels"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet'")
    return str(at), c


def _same(spark, one_class, name):
    at, c = one_class
    rows = catalog.queries()[name](spark, at)
    said = c.sql(catalog.oracle_sql()[name])
    got, want = sorted(map(repr, (tuple(r[n] for n in said.columns) for r in rows.collect()))), sorted(map(repr, said.fetchall()))
    assert got == want
    return rows.collect()


def test_quotas_where_all_groups_are_positive(spark, one_class):
    """the SQL told of -1 groups, and the split took one group too many to test."""
    got = {(r["positive"], r["split"]): r["groups"] for r in _same(spark, one_class, "m2_split_quotas")}
    assert got == {(1, "test"): 4, (1, "train"): 10}


@pytest.mark.parametrize(("positive", "negative", "test_pos", "test_neg"), [(8, 0, 2, 0), (0, 8, 0, 2), (7, 1, 2, 0), (1, 7, 0, 2), (2, 2, 1, 1), (1, 0, 0, 0), (0, 1, 0, 0), (12, 4, 3, 1)])
def test_quotas_of_small_classes(spark, positive, negative, test_pos, test_neg):
    df = spark.range(positive + negative).select(F.col("id"), F.col("id").cast("string").alias("gid"), (F.col("id") < positive).cast("int").alias("label"))
    rows = [r for r in evaluation.group_split(df).collect() if r["split"] == "test"]
    assert (sum(r["label"] for r in rows), sum(1 - r["label"] for r in rows)) == (test_pos, test_neg)


def test_group_metrics_of_one_class(spark, one_class):
    """the SQL divided by the empty class; balanced accuracy is the other class' recall, and no curve is drawn."""
    (got,) = _same(spark, one_class, "m17_group_metrics")
    assert (got["balanced_accuracy"], got["average_precision"], got["roc_auc"]) == (got["recall"], 1.0, None)


def test_tables_as_long_as_the_log_are_not_broadcast(spark, capsys):
    """rules' tables with a row a line went through the driver while their files were small."""
    lines = spark.range(50).select(F.col("id").alias("line"))
    rule = lines.withColumn("late_oper", F.lit(True)).withColumn("delay_us", F.col("line") * 1000)
    found = protocol.with_reasons(lines, [rule])
    found.explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out
    assert {r["line"]: list(r["protocol_reasons"]) for r in found.collect()}[7] == ["late_oper_after_0.007s"]


@pytest.mark.parametrize("rows", [1000, 4000])
def test_running_values_are_dealt_over_more_tasks_as_rows_grow(spark, monkeypatch, rows):
    """a fixed number of partitions made a task's sorts grow with the table."""
    monkeypatch.setattr(ordering, "TASK_ROWS", 100)
    monkeypatch.setattr(ordering, "BLOCK", 10)
    log = spark.range(rows).select(F.col("id").alias("line"), (F.col("id") * 7).alias("us"), (F.col("id") % 3).cast("string").alias("key"))
    blocks = ordering.time_blocks(log)
    order = (F.col("us"), F.col("line"))
    found = ordering.running_values(log, {"k": F.col("key")}, {"n": ("k", "sum", F.lit(1).cast("bigint"), True)}, order, F.struct(*order), blocks)
    assert found.rdd.getNumPartitions() == blocks.tasks == rows // 100
    assert all(r["n"] == r["line"] // 3 + 1 for r in found.collect())


def test_topics_are_fitted_on_all_distinct_texts(spark):
    """they came from about 4,000 texts picked by a hash."""
    docs = spark.range(18_000).select((F.col("id") % 9000).alias("n")).select(F.concat_ws(" ", F.concat(F.lit("a"), F.col("n")), F.concat(F.lit("b"), F.col("n") % 7)).alias("text"))
    found = mixing.fit_topics(docs)
    assert found.stages.stages[1].numDocs == 9000
    assert sum(found.stages.stages[3].summary.clusterSizes) > 2000


@pytest.fixture(scope="module")
def marked(spark):
    """Rows with a null, a NaN, few distinct values of a and many of b; label 1 if a > 2 and b > 0.7, with some noise."""
    r = random.Random(4)
    rows = [(i, a := float(r.randrange(5)), b := round(r.random(), 3), int(a > 2 and b > 0.7 or r.random() < 0.03)) for i in range(3000)]
    rows += [(3000, None, 0.5, 0), (3001, float("nan"), 0.9, 1)]
    return rows, spark.createDataFrame(rows, "id long, a double, b double, label int")


def test_equal_rows_are_one_cell_of_the_forest(spark, marked):
    """A forest passed over every row of a table of few distinct ones, for each of its trees and levels."""
    rows, df = marked
    cuts = forest.edges(df, ["a", "b"], "label")
    assert list(cuts[0]) == [0.5, 1.5, 2.5, 3.5] and 25 <= len(cuts[1]) <= forest.BINS - 1
    found = {(r["code"], r["label"]): r["n"] for r in forest.cells(df, ["a", "b"], "label", cuts).collect()}
    many = df.crossJoin(spark.range(7).select("id").withColumnRenamed("id", "copy"))
    assert {(r["code"], r["label"]): r["n"] for r in forest.cells(many, ["a", "b"], "label", cuts).collect()} == {k: 7 * n for k, n in found.items()}
    want = Counter((bytes([4 if a is None or a != a else sum(c < a for c in cuts[0]), sum(c < b for c in cuts[1])]), y) for _, a, b, y in rows)
    assert found == dict(want)
    assert sum(len(bytes(r["marks"])) // 2 for r in forest.blocks(forest.cells(many, ["a", "b"], "label", cuts), len(found)).collect()) == len(found)


@pytest.mark.parametrize("copies", [1, 5])
def test_forest_nodes_count_the_bootstrapped_rows(spark, marked, monkeypatch, copies):
    """every tree passed over all rows at each level. Nodes against plain loops, in many blocks and passes."""
    monkeypatch.setattr(forest, "BLOCK", 100)
    monkeypatch.setattr(forest, "PASS_BYTES", 3000)
    kept = {}
    monkeypatch.setattr(forest, "_finished", lambda grown, *rest, _f=forest._finished: (kept.update(grown), _f(grown, *rest))[1])
    monkeypatch.setattr(forest, "discard", lambda *t: kept.update(blocks=t[1].collect()))
    _, df = marked
    df = df.crossJoin(spark.range(copies).select("id").withColumnRenamed("id", "copy"))
    model = forest.fit(df, ["a", "b"], "label", trees=3, depth=4, leaf=2, seed=9)
    blocks, total = kept.pop("blocks"), df.count()
    for number, tree in kept.items():
        at = defaultdict(lambda: [0, 0])
        for r in blocks:
            marks, counts = np.frombuffer(r["marks"], np.uint8).reshape(-1, 2), np.frombuffer(r["counts"], np.int64)
            for own, times in zip(marks.tolist(), forest.drawn(counts, 9, number, r["block"]).tolist(), strict=True):
                node = 0
                while True:
                    at[node][own[0] % 2] += times
                    if tree.child[node] < 0:
                        break
                    node = tree.child[node] + (own[tree.feature[node]] // 2 > tree.cut[node])
        assert {n: tuple(x) for n, x in at.items() if sum(x)} == {n: x for n, x in enumerate(zip(tree.c0, tree.c1, strict=True)) if sum(x)}
        assert abs(sum(at[0]) - total) < 6 * total**0.5 * copies**0.5
        assert all(tree.c0[i] + tree.c1[i] >= 2 for i in range(len(tree.child)))
    scored = models.scores(model, df)
    assert evaluation.ranking(scored.select("label", "score")).first()["roc_auc"] > 0.9
    assert scored.count() == total and scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_best_splits_by_plain_loops():
    """the cut of most Gini gain that leaves enough rows on both sides, or none."""
    r = np.random.default_rng(5)
    sums = r.poisson(0.3, size=(40, 2, forest.BINS, 2))
    sums[0] = 0
    sums[1, :, :, 1] = 0
    sums[:, 1] = sums[:, 0, ::-1]  # both features see the same rows
    got = forest.best_splits(sums, (1.0, 3.0), 3)

    def spoiled(a, b):
        return 2 * a * (3.0 * b) / (a + 3.0 * b) if a + b else 0.0

    for n in range(len(sums)):
        best = 0.0
        total = sums[n, 0].sum(axis=0)
        for f in range(2):
            for c in range(forest.BINS - 1):
                left = sums[n, f, : c + 1].sum(axis=0)
                right = total - left
                if left.sum() >= 3 and right.sum() >= 3:
                    best = max(best, spoiled(*total) - spoiled(*left) - spoiled(*right))
        assert abs(got["gain"][n] - best) < 1e-9
    assert got["gain"][0] == got["gain"][1] == 0
