"""Operators against brute force, exact round trips and held-out labels."""

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracewright.llm import decontamination, language_id, mixing, ngram_join, quality_rules, rule_classifier, sharding, token_counts, warc
from tracewright.llm import shingles as shingle_sets
from tracewright.llm.components import components
from tracewright.llm.queries import LANG_TARGETS

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- op1 ----------------------------------------------------------------------------------


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    got = rule_classifier.classify(docs, labels).join(labels, "doc_id")
    rows = got.where("held_out").collect()
    assert len(rows) > 40
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.93
    # the held-out labels have no say in the scores
    flipped = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(CAST(CAST(doc_id AS string) AS binary)), 5) = 0 THEN 1 - quality ELSE quality END AS quality")
    a = {r["doc_id"]: r["score"] for r in got.collect()}
    b = {r["doc_id"]: r["score"] for r in rule_classifier.classify(docs, flipped).collect()}
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_rules_are_the_paths_of_the_trees(spark):
    """Compiled rules hold for a row exactly where a walk down the trees passes their node."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    r, names = random.Random(21), list(rule_classifier.STATISTICS)
    rows = [(i, *[r.choice([0.0, 0.1, 0.5, r.random()]) for _ in names]) for i in range(300)]
    df = spark.createDataFrame(rows, ", ".join(["id long", *[f"{n} double" for n in names]]))
    label = (F.col(names[0]) + F.col(names[1]) * F.col(names[2]) > 0.6).cast("double")
    data = df.select(label.alias("label"), array_to_vector(F.array(*names)).alias("features"))
    forest = RandomForestClassifier(numTrees=4, maxDepth=3, seed=2).fit(data)

    def walked(node, row, path=()):
        """The bounds of each node on the row's way down."""
        if path:
            yield rule_classifier.simplified(list(path))
        if node.getClass().getSimpleName() != "LeafNode":
            at, name = float(node.split().threshold()), names[node.split().featureIndex()]
            above = row[name] > at
            yield from walked(node.rightChild() if above else node.leftChild(), row, (*path, rule_classifier.Bound(name, above, at)))

    for tree in forest.trees:
        root = tree._java_obj.rootNode()
        rules = sorted(set(rule_classifier.tree_rules(root, names)), key=repr)
        found = df.select("*", F.array(*[rule_classifier.matches(x) for x in rules]).alias("hit")).collect()
        for row in found[:60]:
            passed = set(walked(root, row))
            assert [x in passed for x in rules] == list(row["hit"])
    model = rule_classifier.Ensemble(tuple((x, 0.5 + i) for i, x in enumerate(rules)), -0.25)
    for row in df.select("*", model.score().alias("score")).collect()[:60]:
        z = -0.25 + sum(w for x, w in model.rules if all((row[b.statistic] > b.at) == b.above for b in x))
        assert abs(row["score"] - 1 / (1 + np.exp(-z))) < 1e-12


# -- op2 ----------------------------------------------------------------------------------

PARTS = ["a", "b ", "the ", " ", "  ", "\n", "\n\n", "\t", "é", "ñ ", "中", "文", "'s", "'t ", "1", "23", "<|endoftext|>", "<|end", "!!", "　", " ", "\xa0", "\x1c", "\x85", "😀", "\r\n", "x" * 30]


@pytest.mark.parametrize(("chunk", "overlap"), [(65536, 256), (8192, 256), (64, 8), (200, 16)])
def test_token_counts_are_the_librarys(chunk, overlap):
    from tokenizers import Tokenizer

    r = random.Random(chunk)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 400))) for _ in range(300)] + ["y" * 500, "文" * 500, "a b " * 200]
    want = [len(e.ids) for e in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_texts(TOKENIZER, texts, chunk, overlap) == want


def test_token_counts_of_documents(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = read(spark, sf_dir, "documents")
    t = Tokenizer.from_file(TOKENIZER)
    want = {r["doc_id"]: (len(r["text"].encode()), len(t.encode(r["text"], add_special_tokens=False).ids)) for r in docs.collect()}
    got = token_counts.count_tokens(docs, TOKENIZER, chunk=1000, overlap=64).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want


# -- op4 ----------------------------------------------------------------------------------


def brute_components(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(sets))]


def near_copies(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    bases = [[r.choice(vocabulary) for _ in range(r.randint(3, 80))] for _ in range(5)]
    shared = [r.choice(vocabulary) for _ in range(25)]
    texts = []
    for _ in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(vocabulary) + r.choice(["", "x"])
        texts.append(" ".join(w + (shared if r.random() < 0.3 else [])))
    return texts


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize(("seed", "tile_sets", "chunk"), [(1, 512, 1_000_000), (2, 7, 1_000_000), (3, 512, 200), (4, 7, 200)])
def test_similar_documents_against_all_pairs(spark, monkeypatch, seed, tile_sets, chunk):
    """Also with tiles far too small for the groups, and with frequent n-grams set apart."""
    monkeypatch.setattr(ngram_join, "TILE_SETS", tile_sets)
    if chunk < 1000:
        for name, value in (("CHUNK", chunk), ("IN_CHUNK", 2), ("IN_ALL", 3)):
            monkeypatch.setattr(ngram_join, name, value)
    texts = near_copies(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute_components([shingles(t) for t in texts])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_documents(docs).collect()}
    assert got == {i: (len(shingles(t)), want[i]) for i, t in enumerate(texts)}


def test_common_ngrams_that_are_not_set_apart(spark, monkeypatch):
    """A passage in a third of all texts, too rare in each chunk to be known as frequent, and copies in many tasks."""
    monkeypatch.setattr(ngram_join, "IN_CHUNK", 10**9)
    texts = near_copies(7, 90)
    texts += texts[:20] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    want = brute_components([shingles(t) for t in texts])
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.similar_documents(docs).collect()} == dict(enumerate(want))


@pytest.mark.parametrize("piece", [1 << 17, 40, 3])
def test_shingles_are_those_of_a_loop(monkeypatch, piece):
    monkeypatch.setattr(shingle_sets, "PIECE", piece)
    r = random.Random(5)
    texts = ["".join(r.choice(["a", "B", "cd ", " ", "\n", "\x0b", "é", "\xa0", "x y ", "文"]) for _ in range(r.randint(0, 90))) for _ in range(300)] + [None, "", " ", "w" * 500 + " v"]
    sets = list(shingle_sets.ngram_sets([None if t is None else t.encode() for t in texts]))

    def loop(t):
        w = [x for x in re.split("[\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()

    want = [loop(t) for t in texts]
    assert [len(s) for s in sets] == [len(w) for w in want] and all((np.diff(s.astype(object)) > 0).all() for s in sets if len(s) > 1)
    held = [set(s.tolist()) for s in sets]
    assert all(len(held[i] & held[j]) == len(want[i] & want[j]) for i in range(len(texts)) for j in range(0, i, 7))


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    a, near, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"a{i}" for i in range(39)), " ".join(f"b{i}" for i in range(40))
    rows = [(2, a, "x"), (5, near, "x"), (5, b, "x"), (7, b, "x"), (7, b, "y"), (2, a, "z"), (8, " ", "x"), (8, "", "x"), (8, "", "y"), (None, a, "x")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, note string, head_id int, digest int")
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == sorted([(2, a), (5, b), (8, " "), (8, ""), (0, a)])
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in ngram_join.similar_documents(docs).collect())
    assert got == sorted([(2, 2), (5, 2), (5, 5), (7, 5), (7, 5), (2, 2), (8, 8), (8, 8), (8, 8), (0, 0)])


def test_trie_finds_every_link():
    r = np.random.default_rng(3)
    for _ in range(30):
        base = [r.integers(0, 300, r.integers(1, 60)).astype(np.uint64) for _ in range(4)]
        seen = {}
        for _ in range(70):
            x = base[r.integers(4)]
            y = np.unique(np.concatenate([x[r.random(len(x)) > r.choice([0, 0.05, 0.1])], r.integers(0, 2000, r.integers(0, 5)).astype(np.uint64)]))
            if len(y):
                seen[y.tobytes()] = y
        sets = list(seen.values())
        want = brute_components([set(s.tolist()) for s in sets])
        root = list(range(len(sets)))
        for a, b in ngram_join.linked_pairs(sets):
            x, y = (min(root[a], root[b]), max(root[a], root[b]))
            root = [x if v == y else v for v in root]
        assert root == want


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)] + [(200, 201 + i) for i in range(50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and all(got[201 + i] == 200 for i in range(50))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_roots(edges):
    """The smallest reachable node of each node, by widening sets."""
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    root = {}
    for start in sorted(near):
        if start not in root:
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = start
                    todo += near[x]
    return root


def test_components_of_random_graphs(spark):
    r = random.Random(8)
    for n, m, parts in ((40, 30, 1), (300, 280, 16), (300, 900, 5)):
        edges = [(r.randrange(-n, n), r.randrange(-n, n)) for _ in range(m)]
        hub, path = [(5000 + i, 4000) for i in range(200)], [(9000 + (i * 37) % 101, 9000 + ((i + 1) * 37) % 101) for i in range(100)]
        edges += hub + path + hub[:20] + [(None, 3), (4, None), (6, 6)]
        found = components(spark.createDataFrame(edges, "a long, b long").repartition(parts)).collect()
        assert {x["node"]: x["root"] for x in found} == plain_roots(edges) and len(found) == len(plain_roots(edges))


def test_contraction_in_chunks_keeps_a_node_s_edges_together(monkeypatch):
    from tracewright.llm import components as module

    monkeypatch.setattr(module, "HELD", 3)
    r = random.Random(2)
    for _ in range(20):
        edges = sorted((r.randrange(10, 60), r.randrange(0, 10)) for _ in range(80))
        batches = [pa.RecordBatch.from_pydict({"a": [x for x, _ in part], "b": [y for _, y in part]}) for part in (edges[i : i + 4] for i in range(0, 80, 4))]
        for by_node in (False, True):
            out = [(x, y) for b in module._contract(iter(batches), by_node) for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            assert plain_roots(out) == plain_roots(edges) and all(x > y for x, y in out)
        for node in {x for x, _ in edges}:
            own = [y for x, y in edges if x == node]
            linked = plain_roots([e for e in out if e[0] in (node, *own)])
            assert len({linked.get(x, x) for x in (node, *own)}) == 1


# -- op5 ----------------------------------------------------------------------------------


def test_raking_meets_all_marginals():
    r = np.random.default_rng(1)
    mass = r.random((4, 3, 5)) + 0.05
    goals = [np.array(x) / sum(x) for x in ([4, 3, 2, 1], [5, 3, 2], [1, 1, 2, 3, 3])]
    fit = mixing.rake(mass, goals)
    for axis, goal in enumerate(goals):
        assert np.allclose(fit.sum(axis=tuple(i for i in range(3) if i != axis)), goal, atol=1e-8)
    p, weight = mixing.inclusion(mass, fit, 0.5 * mass.sum())
    assert p.max() <= 1 and abs((mass * p).sum() - 0.5 * mass.sum()) < 1e-6
    weighted = mass * p * weight
    assert np.allclose(weighted.sum(axis=(1, 2)) / weighted.sum(), goals[0], atol=1e-8)


def test_mix_expects_its_targets(spark):
    docs = mixing.prepared(read(spark, "/root/testdata/sf0.01", "documents"))
    target = {"lang": {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}}
    rows = mixing.mix(docs, targets=target, budget=0.5).collect()
    expected = Counter()
    for r in rows:
        expected[r["lang"]] += r["p"] * r["weight"] * r["n_tokens"]
    assert all(abs(expected[k] / sum(expected.values()) - v) < 1e-6 for k, v in target["lang"].items())
    assert abs(sum(r["p"] for r in rows) - sum(r["kept"] for r in rows)) < 4 * len(rows) ** 0.5
    assert [r["kept"] for r in mixing.mix(docs, targets=target, budget=0.5).orderBy("doc_id").collect()] == [r["kept"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_kept_tokens_meet_the_marginals_without_weights(spark):
    """Also where the budget asks scarce cells for more than they have."""
    docs = mixing.prepared(read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "source", "lang")).drop("text")
    rows = mixing.mix(docs, targets=LANG_TARGETS).collect()
    total, expected = sum(r["n_tokens"] for r in rows), sum(r["p"] * r["n_tokens"] for r in rows)
    for d in mixing.DIMENSIONS:
        had, got = Counter(), Counter()
        for r in rows:
            had[r[d]] += r["n_tokens"]
            got[r[d]] += r["p"] * r["n_tokens"]
        raw = {k: LANG_TARGETS[d].get(k, 0) if d in LANG_TARGETS else v**0.7 for k, v in had.items()}
        assert all(abs(got[k] / expected - v / sum(raw.values())) < 1e-6 for k, v in raw.items())
        # no more can be kept than the scarcest category allows
        assert expected / total <= min(had[k] / total / (v / sum(raw.values())) for k, v in raw.items() if v) + 1e-9
    assert max(r["p"] for r in rows) <= 1 and all(abs(r["weight"] - 1) < 1e-6 for r in rows)


def test_bounded_raking_keeps_the_most():
    mass, even = np.array([[[4.0], [1.0]], [[1.0], [4.0]]]) / 10, [np.array([0.5, 0.5]), np.array([0.8, 0.2]), np.array([1.0])]
    fit = mixing.rake(mass, even)
    got = mixing.largest(mass, fit, 0.9)
    assert (got <= mass + 1e-9).all() and np.allclose(got.sum(axis=(1, 2)) / got.sum(), even[0], atol=1e-7) and np.allclose(got.sum(axis=(0, 2)) / got.sum(), even[1], atol=1e-7)
    # the first column holds 0.5 and is 0.8 of what is kept; its rows hold 0.4 and 0.1, and the
    # second row can be half of all only with 0.1 + 0.2 * kept of it
    assert 0.325 < got.sum() < 1 / 3 + 1e-6 and got.sum() > 1.03 * fit.sum() / (fit / mass).max()
    assert abs(mixing.largest(mass, fit, 0.2).sum() - 0.2) < 1e-9
    assert mixing.largest(np.zeros((0, 0, 0)), np.zeros((0, 0, 0)), 0.0).shape == (0, 0, 0)


# -- op6 ----------------------------------------------------------------------------------


def plain_lpt(sizes, shards):
    """Loads of the shards, each item placed by a search of the least load."""
    load = [0] * shards
    for size in sorted(sizes, reverse=True):
        load[load.index(min(load))] += size
    return load


@pytest.mark.parametrize("seed", range(6))
def test_schedule_is_lpt(seed):
    r = random.Random(seed)
    sizes = [(size, r.choice([1, 2, 7, 8, 9, 100, 1000])) for size in r.sample(range(1, 400), 40)]
    placed = sharding.schedule(sizes, 8)
    assert {size: sum(n) for size, n in placed} == dict(sizes)
    assert [sum(size * n[s] for size, n in placed) for s in range(8)] == plain_lpt([x for x, n in sizes for _ in range(n)], 8)
    assert sharding.schedule([], 8) == []


def test_shards_of_documents_are_those_of_lpt(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents").unionByName(read(spark, "/root/testdata/sf0.01", "documents").where("doc_id % 3 = 0"))
    groups = Counter()
    for x in docs.collect():
        groups[x["text"] or ""] += len((x["text"] or "").encode()) + 16
    load = Counter()
    for x in sharding.assign(docs, shards=7).collect():
        load[x["shard"]] += x["size"]
    assert [load[s] for s in range(7)] == plain_lpt(groups.values(), 7)


def test_shards_are_even_and_whole(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    rows = sharding.assign(docs, shards=40).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(text)
    load, home, slots = Counter(), {}, {}
    for r in rows:
        load[r["shard"]] += r["size"]
        assert home.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["size"] == len(text[r["doc_id"]].encode()) + 16
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(load.values()) / (sum(load.values()) / 40) < 1.05


# -- op7 ----------------------------------------------------------------------------------


def test_leaks_against_all_alignments(spark, sf_dir):
    items = [(r["item_id"], r["text"]) for r in read(spark, sf_dir, "benchmark").collect()]
    docs = read(spark, sf_dir, "documents")
    got = {r["doc_id"]: {x["item_id"]: x["edits"] for x in r["leaks"]} for r in decontamination.find_leaks(docs, read(spark, sf_dir, "benchmark")).collect()}
    words = {i: decontamination.word_ids(t) for i, t in items}
    for r in docs.collect():
        a = decontamination.word_ids(r["text"])
        want = {i: d for i, w in words.items() if (d := decontamination.passage_distance(w, a)[0]) <= decontamination.allowed(len(w), decontamination.ERRORS)}
        assert got[r["doc_id"]] == want
    assert any(got.values())


def test_recall_of_edited_passages(spark):
    r = random.Random(4)
    items = [(x["item_id"], x["text"]) for x in read(spark, "/root/testdata/sf0.01", "benchmark").collect()]
    fill = [w for x in read(spark, "/root/testdata/sf0.001", "documents").collect() for w in x["text"].split()][:20_000]
    index, found, total = decontamination.Items(items), 0, 0
    for _ in range(300):
        i, text = r.choice(items)
        w = text.split()
        k = decontamination.allowed(len(decontamination.word_ids(text)), decontamination.ERRORS)
        for _ in range(r.randint(0, k)):
            at, what = r.randrange(len(w)), r.random()
            if what < 0.4:
                w[at] = r.choice(fill)
            elif what < 0.7:
                w.insert(at, r.choice(fill))
            else:
                del w[at]
        a = decontamination.word_ids(" ".join(r.choices(fill, k=30) + w + r.choices(fill, k=30)))
        if plain_distance(decontamination.word_ids(text).tolist(), a.tolist()) <= k:
            total += 1
            found += i in {x[0] for x in index.leaks(a)}
    assert total > 200 and found / total >= 0.99


def plain_words(text):
    """A normalisation of its own: lower case, then runs of letters, marks and digits, joined over punctuation."""
    words = ["".join(c for c in w if c.isalnum() or unicodedata.category(c)[0] in "M") for w in unicodedata.normalize("NFC", text.lower()).split()]
    return [w for w in words if w]


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, word in enumerate(item):
        nxt = [i + 1]
        for j, other in enumerate(text):
            nxt.append(min(row[j] + (word != other), row[j + 1] + 1, nxt[j] + 1))
        row = nxt
    return min(row)


@pytest.mark.parametrize("place", ["first", "last", "any"])
@pytest.mark.parametrize("kind", ["insert", "replace", "delete"])
def test_recall_by_length_kind_and_place_of_edits(kind, place):
    """As many edits as allowed, in items of 1 to 60 words: exact up to decontamination.SHORT words."""
    r = random.Random(kind + place)
    vocabulary = [f"v{i}" for i in range(3000)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    missed, tried = Counter(), Counter()
    for n in [*range(1, 21), 25, 30, 45, 60]:
        for _ in range(12):
            item, k = words(n), decontamination.allowed(n, decontamination.ERRORS)
            own = list(item)
            for _ in range(k):
                at = {"first": 0, "last": len(own) - 1, "any": r.randrange(len(own))}[place]
                own[at : at + (kind != "insert")] = [] if kind == "delete" else words(1)
            text = words(25) + own + words(25)
            assert plain_distance(item, text) <= k
            tried[n] += 1
            missed[n] += not decontamination.Items([(1, " ".join(item))]).leaks(decontamination.word_ids(" ".join(text)))
    assert not any(missed[n] for n in range(1, decontamination.SHORT + 1))
    assert sum(missed.values()) <= 0.01 * sum(tried.values())


def test_leaks_in_capitals_and_other_punctuation(spark):
    items = [
        (1, "La publicación de la región mostró cómo la educación pública cambió según la opinión de más de cien jóvenes en España durante el último año"),
        (2, "L'été dernier, les élèves français étaient déjà passés près du château où l'hôtel fermé côtoyait la forêt très âgée et la rivière gelée"),
        (3, "Über die schönen Hügel führt ein schmaler Weg, der früher für Händler und Könige gefährlich war und später völlig überflüssig würde"),
    ]
    fill = "hier steht noch etwas anderes das mit den fragen nichts zu tun hat und lang genug ist"
    shapes = [str, str.upper, str.title, lambda t: unicodedata.normalize("NFD", t.upper()), lambda t: "« " + t.replace(" ", " — ", 3).replace(" ", "\xa0") + " »", lambda t: "“" + t.replace("'", "’") + "…”"]
    texts = [(i * 10 + k, f"{fill} {shape(t)} {fill}") for i, t in items for k, shape in enumerate(shapes)] + [(99, fill.upper())]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: {x["item_id"]: x["edits"] for x in r["leaks"]} for r in decontamination.find_leaks(docs, bench).collect()}
    for doc_id, text in texts:
        own = plain_words(text)
        dist = {i: (plain_distance(plain_words(t), own), len(plain_words(t))) for i, t in items}
        assert got[doc_id] == {i: d for i, (d, n) in dist.items() if d <= n // 5}
    assert all(got[d] == {d // 10: 0} for d, _ in texts[:-1]) and not got[99]
    assert [r["doc_id"] for r in decontamination.clean_documents(docs, bench).collect()] == [99]
    for ascii_text in ("A-b, C.\x1cd -- e\x0bF_g\x00h", "", " ... "):
        both = decontamination.word_ids(ascii_text + " ñ")
        assert both[:-1].tolist() == decontamination.word_ids(ascii_text).tolist()


# -- op8 ----------------------------------------------------------------------------------


def test_archives_hold_a_dictionary_and_one_frame_a_record(spark, sf_dir, tmp_path):
    pages = read(spark, sf_dir, "pages")
    path = warc.write_archives(pages.coalesce(2), f"file://{tmp_path}/a")
    want = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    back = {r["page_id"]: bytes(r["payload"]) for r in warc.read_archives(spark, path).where("record_type = 'response'").collect()}
    assert all(want[k] == v for k, v in back.items()) and len(back) == len(want)
    for f in (tmp_path / "a").glob("part-*"):
        data = f.read_bytes()
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
        assert len(list(warc.read_archive(data))) == data.count(warc.SEPARATOR.encode()) - 1
        for broken in (data[:-9], data[:200], data[:8], b"junk" + data):
            with pytest.raises(Exception):  # noqa: B017
                list(warc.read_archive(broken))


def test_records_are_validated():
    raw = warc.record(1, "http://a", b"abc", "a9993e364706816aba3e25717850c26c9cd0d89d", None)
    assert warc.parse(raw)[-1] == b"abc"
    for bad in (raw.replace(b"abc", b"abd"), raw[:-1], raw.replace(b"WARC/1.1", b"WARC/9"), raw.replace(b"Content-Length: 3", b"Content-Length: 4"), raw.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc.BadArchive):
            warc.parse(bad)


# -- op10 ---------------------------------------------------------------------------------


def brute_repeat(w):
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(hit)


def test_repeated_words_against_a_loop(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice("ab" if r.random() < 0.3 else "abcdef") for _ in range(r.randint(0, 60))) for _ in range(150)]
    texts += [" ".join(["a"] * n) for n in (7, 8, 9, 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["n_repeat_words"] for x in quality_rules.measure(docs).collect()}
    assert got == {i: brute_repeat(t.split()) for i, t in enumerate(texts)}


def test_policies_and_ablation_work_on_bits(spark, sf_dir):
    book = quality_rules.ledger(quality_rules.measure(read(spark, sf_dir, "documents"))).select("doc_id", "fail_bits")
    rows = [r["fail_bits"] for r in book.collect()]
    for policy in (quality_rules.BASE, quality_rules.V1, quality_rules.V2, quality_rules.Policy("soft", quality_rules.V2.rules, 1)):
        mask = policy.mask()
        kept = lambda b, m=mask, p=policy: bin(b & m).count("1") <= p.allowed
        assert sum(r["kept"] for r in quality_rules.apply_policy(book, policy).collect()) == sum(map(kept, rows))
        got = {r["rule"]: (r["n_failed"], r["n_only"], r["n_kept_without"]) for r in quality_rules.ablation(book, policy).collect()}
        for rule in (x for x in quality_rules.RULES if x.name in policy.rules):
            rest = mask & ~rule.mask
            without = [bin(b & rest).count("1") <= policy.allowed for b in rows]
            only = sum(1 for b, w in zip(rows, without, strict=True) if b & rule.mask and w and not kept(b))
            assert got[rule.name] == (sum(1 for b in rows if b & rule.mask), only, sum(without))


# -- op9 ----------------------------------------------------------------------------------


def test_posteriors_against_a_loop(spark):
    """The fusion for each page from counts over all others, in plain Python, with the model's likelihoods given."""
    r = random.Random(6)
    vocabulary = {"de": ["das", "haus", "und", "baum", "nicht"], "en": ["the", "house", "and", "tree", "not"], "fr": ["la", "maison", "et", "arbre", "pas"]}
    train = spark.createDataFrame([(" ".join(r.choices(v, k=30)), k) for k, v in vocabulary.items() for _ in range(5)], "text string, lang string")
    langs, log_p = language_id.train(train)
    assert langs == ["de", "en", "fr"]
    rows = []
    for i in range(120):
        k = r.choice(langs)
        words = r.choices(vocabulary[k], k=r.randint(0, 6)) + r.choices(vocabulary[r.choice(langs)], k=r.randint(0, 3))
        host = r.choice([f"a.{k}.org", "b.x.com", "c.x.com", f"d.{k}", None])
        rows.append((i, None if host is None else f"http://{host}/{r.choice(['', 'de/', 'p'])}", f"<html{r.choice(['', ' lang=' + k, ' lang=en'])}><p>{' '.join(words)}</p></html>", words, host))
    got = {x["page_id"]: x for x in language_id.identify(spark.createDataFrame([x[:3] for x in rows], "page_id long, url string, html string"), (langs, log_p)).collect()}

    def softmax(v):
        e = np.exp(v - v.max())
        return e / e.sum()

    ll = [sum((log_p[:, language_id.features(w)].sum(axis=1) for w in words), np.zeros(3)) * language_id.TEMPER for *_, words, _ in rows]
    p = [softmax(x) for x in ll]
    domain = [None if h is None else ".".join(h.split(".")[-2:]) for *_, h in rows]
    suffix = ["/de" if (u or "").endswith("/de/") else "." + h.split(".")[-1] if h and len(h.split(".")[-1]) == 2 else None for _, u, _, _, h in rows]
    declared = [re.search("lang=(..)", h)[1] if "lang=" in h else None for _, _, h, _, _ in rows]
    total = sum(p)
    prior = (total + 1) / (total.sum() + 3)

    def masses(keys):
        found = {}
        for key, x in zip(keys, p, strict=True):
            if key is not None:
                found[key] = found.get(key, 0) + x
        return found

    def smoothed(mass, own, above):
        rest = np.maximum(mass - own, 0) if mass is not None else np.zeros(3)
        return (rest + language_id.HOST_STRENGTH * above) / (rest.sum() + language_id.HOST_STRENGTH)

    hosts, domains, fields = masses([x[4] for x in rows]), masses(domain), (masses(declared), masses(suffix))
    for i, row in enumerate(rows):
        z = ll[i] - ll[i].max() + np.log(smoothed(hosts.get(row[4]), p[i], smoothed(domains.get(domain[i]), p[i], prior)))
        for mass, key in zip(fields, (declared[i], suffix[i]), strict=True):
            if key is not None:
                m = mass[key]
                z = z + np.log((m + language_id.FIELD_STRENGTH * m.sum() / total.sum()) / (total + language_id.FIELD_STRENGTH))
        post = softmax(z)
        assert abs(got[i]["confidence"] - post.max()) < 1e-5 and (got[i]["lang"] == langs[int(post.argmax())] or np.ptp(np.sort(post)[-2:]) < 1e-5)
        assert (got[i]["declared"], got[i]["suffix"], got[i]["host"]) == (declared[i], suffix[i], row[4])


def test_every_labelled_language_has_a_model(spark):
    rows = [(f"w{i}a w{i}b w{i}c", f"l{i:02d}") for i in range(70)] + [("copy copy copy", "l00")] * 500
    langs, log_p = language_id.train(spark.createDataFrame(rows, "text string, lang string"), sample_rows=10_000)
    assert len(langs) == 70 and log_p.shape[0] == 70
    pages = spark.createDataFrame([(1, None, "<p>w69a w69b</p>"), (2, None, "")], "page_id long, url string, html string")
    got = {r["page_id"]: r["lang"] for r in language_id.identify(pages, (langs, log_p)).collect()}
    assert got[1] == "l69"


def test_languages_of_held_out_documents(spark):
    """Documents that the sample didn't hold, as pages that say nothing of their language."""
    docs = read(spark, "/root/testdata/sf0.01", "documents").where("text IS NOT NULL AND lang IS NOT NULL AND n_chars > 40")
    seen, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    pages = held.selectExpr("doc_id AS page_id", "CAST(NULL AS string) AS url", "replace(text, '<', ' ') AS html", "lang AS truth")
    got = language_id.identify(pages, language_id.train(seen)).join(pages.select("page_id", "truth"), "page_id").collect()
    assert len(got) > 300 and sum(r["lang"] == r["truth"] for r in got) / len(got) > 0.9


# -- op5: topics ----------------------------------------------------------------------------


def test_topics_follow_the_terms(spark):
    r = random.Random(12)
    themes = [[f"{t}{i}" for i in range(12)] for t in ("star", "cook", "law", "ship")]
    rows = [(i, " ".join(r.choices(themes[i % 4], k=40)), i % 4) for i in range(400)] + [(900, None, 9), (901, " ", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, theme int")
    model = mixing.fit_topics(docs, topics=4)
    got = mixing.with_topic(docs, model).collect()
    pairs = {(x["theme"], x["topic"]) for x in got}
    assert len(pairs) == 5 and len({t for _, t in pairs}) == 5 and (9, mixing.NONE) in pairs
    again = mixing.with_topic(docs.repartition(3), mixing.fit_topics(docs.repartition(5), topics=4)).collect()
    assert {x["doc_id"]: x["topic"] for x in again} == {x["doc_id"]: x["topic"] for x in got}
    named = mixing.prepared(docs.withColumnRenamed("theme", "topic"))
    assert {x["topic"] for x in named.collect()} == {0, 1, 2, 3, 9}


def test_every_source_is_raked_by_itself(spark):
    rows = [(i, f"s{i % 300}", "en", "t", 10) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n_tokens long")
    cells, known = mixing.cell_weights(docs, {"lang": {"en": 1.0}})
    assert len(cells) == 300 and set(known) == {"lang"} and all(abs(p - 0.8) < 1e-6 for *_, p, _ in cells)
