"""The pipeline stage by stage against plain Python."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_components, shingles
from tracewright.llm import decontamination, mixing, quality_rules


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "ngram_jaccard_join", "decontamination", "mixing", "sharding"]

    good = stages["quality_rules"](spark, docs, sf_dir)
    assert good.columns == docs.columns
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.assess(docs).collect()}
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(k for k, v in verdict.items() if v)

    rows = sorted(good.collect(), key=lambda r: r["doc_id"])
    root = brute_components([shingles(r["text"]) for r in rows])
    unique = stages["ngram_jaccard_join"](spark, good, sf_dir)
    assert set(unique.columns) == set(docs.columns)
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted({rows[i]["doc_id"] for i in root})

    items = [decontamination.word_ids(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = lambda text: any(decontamination.passage_distance(w, decontamination.word_ids(text))[0] <= decontamination.allowed(len(w), 0.2) for w in items)
    clean = stages["decontamination"](spark, unique, sf_dir)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in unique.collect() if not leaks(r["text"]))

    mixed = stages["mixing"](spark, clean, sf_dir)
    assert set(mixed.columns) == set(docs.columns)
    drawn = mixing.mix(mixing.prepared(clean), targets=corpus_pipeline.LANG_TARGETS).where("kept")
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(r["doc_id"] for r in drawn.collect())

    placed = stages["sharding"](spark, mixed, sf_dir)
    assert sorted(r["doc_id"] for r in placed.collect()) == sorted(r["doc_id"] for r in mixed.collect())
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in placed.collect())


def test_mixed_corpus_has_the_target_shares(spark):
    """Tokens of the stage's rows as they are: no weight repairs them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").crossJoin(spark.range(60).withColumnRenamed("id", "copy"))
    docs = docs.withColumn("doc_id", docs["doc_id"] * 60 + docs["copy"]).drop("copy")
    mixed = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, "")
    tokens = {r["lang"]: r["n"] for r in mixing.prepared(mixed).groupBy("lang").agg(F.sum("n_tokens").alias("n")).collect()}
    goal = {k: v for k, v in corpus_pipeline.LANG_TARGETS["lang"].items() if k in tokens}
    off = {k: tokens[k] / sum(tokens.values()) - v / sum(goal.values()) for k, v in goal.items()}
    assert set(tokens) == set(goal) and max(map(abs, off.values())) < 0.01, off


def test_empty_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
