"""Cases of the fourth round's findings on the join of similar documents."""

import random
import re
import time

import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_components, near_copies, shingles
from tracewright.llm import components as stars
from tracewright.llm import ngram_join


def sharing_a_passage(n, copies):
    """Texts of which about half is one passage, and near copies of some."""
    r = random.Random(9)
    passage = [f"p{i}" for i in range(20)]
    texts = [" ".join([*passage, *(f"w{r.randrange(10**9)}" for _ in range(r.randint(10, 18)))]) for _ in range(n)]
    return texts + [f"{t} end" for t in texts[:copies]]


@pytest.fixture
def seated(monkeypatch):
    """Classes that were sent to tiles, by the tiles' keys."""
    rows, join = [], ngram_join._join_tiles

    def counted(dealt, *keys):
        rows.append((keys, dealt.count()))
        return join(dealt, *keys)

    monkeypatch.setattr(ngram_join, "_join_tiles", counted)
    return rows


def test_documents_that_share_a_passage_come_apart(spark, monkeypatch, seated):
    """they were one group, each of whose classes went to all its tiles: rows as the square of the table."""
    monkeypatch.setattr(ngram_join, "TILE_SETS", 32)
    texts = sharing_a_passage(400, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_documents(docs).collect()}
    assert got == {i: i if i < 400 else i - 400 for i in range(460)}
    assert sum(n for _, n in seated) <= 2 * len(texts)


def test_the_pipeline_s_join_parts_them_too(spark, monkeypatch, seated):
    """as above, in the stage of near duplicates."""
    monkeypatch.setattr(ngram_join, "TILE_SETS", 32)
    docs = spark.createDataFrame(list(enumerate(sharing_a_passage(300, 40))), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == list(range(300))
    assert sum(n for _, n in seated) <= 2 * 340


@pytest.mark.parametrize(("seed", "tile_sets"), [(11, 3), (12, 10), (13, 40)])
def test_groups_are_parted_without_loss(spark, monkeypatch, seed, tile_sets):
    """Groups of true copies that don't come apart, among such that do."""
    monkeypatch.setattr(ngram_join, "TILE_SETS", tile_sets)
    texts = near_copies(seed, 110) + sharing_a_passage(60, 20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = brute_components([shingles(t) for t in texts])
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.similar_documents(docs).collect()} == dict(enumerate(want))


def test_shuffles_go_with_the_tables_they_made(spark, monkeypatch):
    """they stayed until the driver collected its garbage, all steps' side by side."""
    files = lambda: set(re.findall(r"shuffle_(\d+)_", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))
    write, left = ngram_join.materialize, {}

    def watched(df, name, **how):
        before = files()
        found = write(df, name, **how)
        until = time.time() + 10
        while files() - before and time.time() < until and name in ("join-survivors", "join-sets", "join-members"):
            time.sleep(0.1)
        left[name] = files() - before
        return found

    monkeypatch.setattr(ngram_join, "materialize", watched)
    texts = near_copies(14, 60)
    ngram_join.join_classes(spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, digest long, text string"))
    assert not left["join-survivors"] and not left["join-sets"] and not left["join-members"]


@pytest.mark.parametrize("small", [0, 250_000])
def test_components_by_rounds_and_at_once(spark, monkeypatch, small):
    """Also where no task may contract what is left."""
    monkeypatch.setattr(stars, "SMALL", small)
    r = random.Random(17)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {x["node"]: x["root"] for x in stars.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    root = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}
