"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import pytest

from tracewright.llm import decontamination, language_id, line_dedup, mixing, ngram_join, quality_rules, rule_classifier, sharding, token_counts, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PROSE = "the quick brown fox jumps over the lazy dog and then it sleeps under the old tree until the evening comes again"
LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(40_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, w long, lines string, n long, cls long, token long, size long, shard int, slot long, kept boolean, leaks string, p double, known string, doc string, host string, row string"
CLASH = (None, "x", 7, "y", 3, 4, 5, 6, 1, 2, True, "z", 0.5, "k", "d", "h", "r")
ROWS = [
    (1, PROSE, "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \n\t \r\n", "fr", None), (5, LONG, "en", "a"), (5, LONG, "en", "a"), (6, PROSE, "de", "b"), (None, PROSE + " x", None, None), (7, "Ünï çødé 文字 😀", "es", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + CLASH for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (6, 1), (7, None)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(10, PROSE), (11, None), (12, ""), (None, PROSE), (13, "one two")], "item_id long, text string")


def one(df, key, value):
    return [r for r in df.collect() if r[key] == value]


def test_classifier(docs, none, labels):
    got = rule_classifier.classify(docs, labels)
    assert got.count() == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got.collect())
    assert rule_classifier.classify(none, labels).count() == 0
    assert {r["score"] for r in rule_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_token_counts(docs, none):
    got = token_counts.count_tokens(docs, TOKENIZER)
    assert got.count() == len(ROWS)
    assert [(r["n_bytes"], r["n_tokens"]) for r in one(got, "doc_id", 2) + one(got, "doc_id", 3)] == [(0, 0), (0, 0)]
    assert one(got, "doc_id", 5)[0]["over_limit"] and len({tuple(r) for r in one(got, "doc_id", 5)}) == 1
    assert token_counts.count_tokens(none, TOKENIZER).count() == 0


def test_line_dedup(spark, none):
    rows = [(i, "same\nown " + str(i), "h") for i in range(6)] + [(90, "same\nx", None), (91, None, "h"), (92, "same", "small"), (93, "same\nonce", "two"), (94, "same\nmore " + "long " * 50_000, "two"), (95, "half", "ten"), *((96 + i, f"x{i}", "ten") for i in range(9)), (95, "third", "ten"), (None, "same\nq", "h")]
    pages = spark.createDataFrame([r + (1, "z") for r in rows], "page_id long, text string, site string, keys long, lines string")
    f = __import__("pyspark.sql.functions", fromlist=["col"])
    got = line_dedup.dedup_lines(pages, f.col("site"), line_dedup.text_lines(f.col("text")))
    by = {r["page_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()}
    assert by[0] == (2, 1, "own 0") and by[90] == (2, 0, "same\nx") and by[91] == (0, 0, "") and by[92] == (1, 0, "same") and by[93] == (2, 1, "once") and by[94][:2] == (2, 1) and len(by[94][2]) == 250_004 and by[96] == (1, 0, "x0") and by[None] == (2, 1, "q")
    assert line_dedup.dedup_lines(pages.limit(0), f.col("site"), line_dedup.text_lines(f.col("text"))).count() == 0


def test_ngram_join(docs, none):
    got = ngram_join.similar_documents(docs)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()}
    assert got.count() == len(ROWS) and by[1] == by[6] == (18, 1) and by[2] == (0, 2) and by[4] == (0, 4) and by[None][1] is None and by[7] == (1, 7)
    assert ngram_join.similar_documents(none).count() == 0
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns or set(left.columns) == set(docs.columns)
    assert sorted(r["doc_id"] for r in left.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 4, 5, 7] and left.where("doc_id IS NULL").count() == 1
    assert ngram_join.one_of_each(none).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(mixing.prepared(docs.select("doc_id", "text", "source", "lang", "p", "kept").withColumnRenamed("p", "old_p")))
    rows = got.collect()
    assert len(rows) == len(ROWS) and all(r["kept"] and r["p"] == 1.0 for r in rows if r["doc_id"] in (2, 3, 4))
    assert mixing.mix(mixing.prepared(none)).count() == 0


def test_sharding(docs, none):
    rows = sharding.assign(docs, shards=3).collect()
    assert len(rows) == len(ROWS) and {r["size"] for r in rows if r["doc_id"] in (2, 3)} == {16}
    for key in (1, 6), (2, 3):
        assert len({r["shard"] for r in rows if r["doc_id"] in key}) == 1
    for s in {r["shard"] for r in rows}:
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    assert sharding.assign(none, shards=3).count() == 0


def test_decontamination(docs, none, items):
    got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontamination.find_leaks(docs, items).collect()}
    assert got[1] == got[6] == got[None] == [10] and got[2] == got[3] == got[5] == got[7] == []
    assert decontamination.find_leaks(none, items).count() == 0
    assert all(not r["leaks"] for r in decontamination.find_leaks(docs, items.limit(0)).collect())
    blocks = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontamination.find_leaks(docs, items, most_words=1).collect()}
    assert blocks == got
    left = decontamination.clean_documents(docs, items)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4, 5, 5, 7]
    assert decontamination.clean_documents(none, items).count() == 0


def test_warc(spark):
    big = "<p>" + "x" * 1200
    rows = [(1, "http://a/\n1", big), (2, None, big), (3, "u", None), (3, "u", None), (4, "u", "small"), (5, "u", "small"), (6, "u", big), (None, "u", big), (7, "ü", "文" * 100_000)]
    pages = spark.createDataFrame([r + (9, "q") for r in rows], "page_id long, url string, html string, payload long, refers_to string")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert got == {1: (1203, "revisit", 6), 2: (1203, "revisit", 6), 3: (0, "response", None), 4: (5, "response", None), 5: (5, "response", None), 6: (1203, "response", None), 7: (300_000, "response", None), None: (1203, "revisit", 6)}
    assert warc.round_trip(pages).count() == len(rows)
    unnamed = warc.round_trip(pages.where("page_id IS NULL").unionAll(pages.where("page_id IS NULL"))).collect()
    assert [(r["page_id"], r["record_type"], bytes(r["payload"]).decode()) for r in unnamed] == [(None, "response", big)] * 2
    assert warc.round_trip(pages).where("page_id = 3").count() == 2
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("most", [200_000, 0])
def test_warc_with_several_payloads_of_a_page(spark, monkeypatch, most):
    """Also with references too many to be sent to all tasks."""
    monkeypatch.setattr(warc, "MOST_BROADCAST", most)
    a, b, c = ("<p>" + x * 1200 for x in "abc")
    rows = [(5, a), (5, b), (9, a), (6, a), (6, c), (9, c), (6, "d" * 1200), (6, "d" * 1200)]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    found = warc.round_trip(pages).collect()
    text = {hashlib.sha1(h.encode()).hexdigest(): h for _, h in rows}
    assert sorted((r["page_id"], text[r["payload_digest"]], r["refers_to"] or 0) for r in found) == sorted((i, h, 9 if i != 9 and h in (a, c) else 0) for i, h in rows)
    stored = {bytes(r["payload"]).decode() for r in found if r["record_type"] == "response"}
    assert stored == set(text.values())
    assert all(bytes(r["payload"]) == b"" for r in found if r["record_type"] == "revisit")


def test_language(spark, docs):
    train = spark.createDataFrame([("the house and the tree " * 5, "en"), ("das haus und der baum " * 5, "de"), (None, "en"), ("x", None)], "text string, lang string")
    rows = [(1, "http://h.org/a", "<p>the tree and the house</p>"), (2, None, None), (3, "http://h.org/", ""), (None, "bad", "<html lang=de><p>das haus"), (3, "http://h.org/", "")]
    pages = spark.createDataFrame([r + ("x", 1) for r in rows], "page_id long, url string, html string, host string, ll int")
    got = language_id.identify(pages, language_id.train(train)).collect()
    by = {r["page_id"]: r["lang"] for r in got}
    assert len(got) == 5 and by[1] == "en" and by[None] == "de" and by[2] in ("de", "en")
    assert language_id.identify(pages.limit(0), language_id.train(train)).count() == 0
    assert {r["lang"] for r in language_id.identify(pages, language_id.train(train.limit(0))).collect()} == {None}


def test_quality_rules(docs, none):
    by = {r["doc_id"]: r for r in quality_rules.assess(docs).collect()}
    assert by[2]["base_failed"] and by[2]["n_words"] == by[3]["n_words"] == by[4]["n_words"] == 0 and by[5]["n_words"] == 80_000
    assert quality_rules.assess(docs).count() == len(ROWS) and quality_rules.assess(none).count() == 0
    kept = quality_rules.accepted(docs)
    assert kept.columns == docs.columns and 1 in [r["doc_id"] for r in kept.collect()]
    assert quality_rules.accepted(none).count() == 0
