"""Lexical search, the conversation trie and repeated passages against plain Python, with nulls,
empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tracewright.llm import conversation_trie, lexical_search, shingles, substring_dedup

# -- op11 ---------------------------------------------------------------------------------


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k):
    held = [(i, Counter(plain_terms(t)), len(plain_terms(t))) for i, t in docs]
    n_docs, total = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for q, (item, text) in enumerate(items):
        scored = []
        for i, c, n in held:
            score = 0
            for t in plain_terms(text):
                if c[t]:
                    m = 75 + (25 * n * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(q, item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return out


@pytest.mark.parametrize(("shard", "block", "short", "most"), [(4096, 64, 1024, 10**6), (16, 4, 8, 100), (7, 3, 0, 300)])
def test_search_against_all_documents(spark, monkeypatch, shard, block, short, most):
    for name, value in (("SHARD", shard), ("BLOCK", block), ("SHORT", short), ("PIECE", 64)):
        monkeypatch.setattr(lexical_search, name, value)
    r = random.Random(shard)
    words = [f"w{i}" for i in range(30)] + ["Élan", "文字", "A1", "don't", "x_y"]
    text = lambda n: r.choice([" ", "\n", "-"]).join(r.choice(words[: r.choice([3, 12, 35])]) for _ in range(n))
    docs = [(i, text(r.choice([1, 5, 30, 200]))) for i in range(150)] + [(200, None), (201, ""), (None, "w1 w2"), (None, "w1 w2"), (7, "w1 w2"), (7, "w1 w2"), (300, " ,;\x00"), (301, "w1 " * 3000)]
    items = [(i, text(r.choice([1, 4, 25]))) for i in range(12)] + [(3, "w1 w1 W2"), (3, "w1 w1 W2"), (None, "w3"), (50, None), (51, ""), (52, "nowhere"), (53, "!")]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, score long, rank int").repartition(3)
    got = lexical_search.search(d, spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, query int").coalesce(1), k=20, most_terms=most)
    assert sorted(map(repr, ((x["query"], x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in got.collect()))) == sorted(map(repr, plain_search(docs, items, 20)))


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == lexical_search.search(docs, items.limit(0)).count() == 0
    # one document that holds every term: ln((2 + 2) / (2 + 1)) for each
    assert [r["score"] for r in lexical_search.search(docs, items).collect()] == [2 * 287 * (1_000_000_000 // (1000 + 1200))]


def test_blocks_below_the_best_are_skipped():
    n = 1024
    sizes = lexical_search.np.ones(n, int)
    tf = lexical_search.np.where(lexical_search.np.arange(n) < 64, 9, 1)
    shard = lexical_search.Shard(lexical_search.np.arange(n), lexical_search.np.zeros(n, bool), tf, sizes, lexical_search.np.zeros(n, int), tf, n, int(tf.sum()))
    best = lexical_search.Best(5)
    assert n > lexical_search.SHORT - 1 and shard.search(lexical_search.np.array([0]), lexical_search.np.array([3]), best) <= n // lexical_search.BLOCK
    lexical_search.SHORT, held = 10, lexical_search.SHORT
    try:
        best = lexical_search.Best(5)
        assert shard.search(lexical_search.np.array([0]), lexical_search.np.array([3]), best) == 1 and best.ids.tolist() == [0, 1, 2, 3, 4]
    finally:
        lexical_search.SHORT = held


# -- op12 ---------------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    base = lambda c: c - int(math.fmod(c, 100))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(base(c), [])[:h] + turns[h:]
    members = defaultdict(set)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].add(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    digest = lambda p, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest(p, m)) for p, m in members.items())


def conversations(seed):
    r = random.Random(seed)
    texts = ["hello", "", None, "tell me", "é文😀", "more", "bye " * 50]
    rows = []
    for c in [0, 1, 2, 3, 5, 7, 99, 100, 101, 102, 103, 150, 205, 206, 207, 307, 308, -3, -150, 12_345, 10**12 + 7]:
        for t in range(r.choice([0, 1, 2, 3, 5, 8, 12])):
            rows.append((c, r.choice([t, t, t, None, 3]), r.choice(["user", "assistant", None]), r.choice(texts)))
    rows += [(c, t, "user", "same") for c in range(400, 440) for t in range(3)] + [(None, 0, "user", "lost"), (500, None, None, None), (500, None, None, None)]
    return rows


COLUMNS = "conv_id long, turn long, role string, text string, at int, depth string"


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 14), (2, 2)])
def test_trie_against_lists(spark, monkeypatch, seed, block):
    monkeypatch.setattr(conversation_trie, "BLOCK", block)
    monkeypatch.setattr(conversation_trie, "PIECE", 7)
    rows = conversations(seed)
    got = conversation_trie.prefix_trie(spark.createDataFrame([(*x, 1, "d") for x in rows], COLUMNS).repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == plain_trie(rows)


def test_trie_with_hashes_that_clash(spark, monkeypatch):
    """Different texts of one hash are told apart, and bases under which orders don't count are dropped."""
    monkeypatch.setattr(conversation_trie, "_code", lambda role, text: conversation_trie.F.length(text).cast("long"))
    bases = conversation_trie._bases
    monkeypatch.setattr(conversation_trie, "_bases", lambda attempt: [1, 1, 1] if attempt == 0 else bases(attempt))
    rows = conversations(4) + [(c, t, "user", x) for c, own in ((600, "abcde"), (700, "bacde"), (800, "edcba")) for t, x in enumerate(own * 2)]
    got = conversation_trie.prefix_trie(spark.createDataFrame([(*x, 1, "d") for x in rows], COLUMNS))
    assert sorted(tuple(r) for r in got.collect()) == plain_trie(rows)
    monkeypatch.setattr(conversation_trie, "_bases", lambda attempt: [1, 1, 1])
    with pytest.raises(RuntimeError):
        conversation_trie.fingerprinted(conversation_trie.ordered_turns(spark.createDataFrame([(*x, 1, "d") for x in rows], COLUMNS)), 100, 6, attempts=2)


def test_trie_of_nothing(spark):
    assert conversation_trie.prefix_trie(spark.createDataFrame([], COLUMNS)).count() == 0
    assert conversation_trie.prefix_trie(spark.createDataFrame([(None, 1, "u", "t", 1, "d")], COLUMNS)).count() == 0


# -- op13 ---------------------------------------------------------------------------------


def plain_repeats(docs, least):
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in docs]
    first = {}
    at = lambda d, s: ((d is None, d or 0), s)
    for (d, _), w in zip(docs, words, strict=True):
        for s in range(len(w) - least + 1):
            key = tuple(w[s : s + least])
            first[key] = min(first.get(key, at(d, s)), at(d, s))
    out = []
    for (d, _), w in zip(docs, words, strict=True):
        gone = {i for s in range(len(w) - least + 1) if first[tuple(w[s : s + least])] < at(d, s) for i in range(s, s + least)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "piece", "part"), [(20, 1 << 17, 1 << 16), (20, 300, 64), (4, 100, 8)])
def test_repeats_against_all_windows(spark, monkeypatch, least, piece, part):
    monkeypatch.setattr(substring_dedup, "PIECE", piece)
    monkeypatch.setattr(shingles, "PIECE", piece)
    monkeypatch.setattr(substring_dedup, "SLICE", part)
    r = random.Random(least + piece)
    words = [f"w{i}" for i in range(200)] + ["É", "文", "\xa0", "Aa", "aA"]
    run = lambda n: [r.choice(words) for _ in range(n)]
    passages = [run(n) for n in (5, 19, 20, 21, 40, 90)]
    docs = []
    for i in range(80):
        w = run(r.choice([0, 3, 30]))
        for _ in range(r.choice([0, 1, 2, 4])):
            p = list(r.choice(passages))
            if r.random() < 0.4:
                p[r.randrange(len(p))] = r.choice(words)
            w += p[r.choice([0, 0, 3]) :] + run(r.choice([0, 1, 10]))
        docs.append((i, r.choice([" ", "\n", " \t "]).join(w)))
    docs += [docs[5], docs[5], (9, docs[8][1]), (None, docs[8][1]), (None, docs[8][1]), (100, None), (101, ""), (102, " \n "), (103, "a " * 90), (104, "a b " * 300), (105, " ".join(run(900) * 2)), (106, "x" * 2000 + " y")]
    d = spark.createDataFrame([(*x, 1, "s") for x in docs], "doc_id long, text string, at int, spans string").repartition(3)
    got = substring_dedup.remove_repeats(d, least)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == plain_repeats(docs, least)
    assert substring_dedup.remove_repeats(d.limit(0), least).count() == 0
