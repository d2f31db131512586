"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time evaluation.

Documents are searched where they lie, for a stated set of queries:

1.  One pass over all texts counts words and keeps, for each document, how often it holds each
    term of any query. Its written result also gives N, L and the terms' document frequencies.
2.  Each task goes through its documents in shards with an inverted index of their own. For a
    query, the lists of a shard that are short in all are summed term at a time into
    accumulators. Those are one more list from then on, with bounds for blocks of documents like
    every long list; blocks are visited in the documents' order, and a block whose bounds don't
    add up to the score of the k-th best document so far is skipped, long lists and all.
3.  Tasks return their k best of each query, which meet in two steps.

Scores are integers, so results don't hang on how documents are dealt to tasks. Queries are sent
to all tasks, in blocks of at most ``most_terms`` terms; documents are searched once for a block.

Defined results: terms are maximal runs of ASCII letters, digits and characters outside ASCII,
with A-Z lower-cased; a null text has none. Every row of the query table is a query of its own,
also where rows repeat; queries without terms, or whose terms no document holds, find nothing;
a null item_id passes through. Repeated documents each take a rank; a null doc_id comes after
all others of the same score. An empty table on either side gives an empty result; other columns
are ignored. Texts are read whole, in pieces.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import materialize, small_batches

MOST_TERMS = 500_000
#: Documents and postings of a shard, documents of a block, postings of a query's short lists.
SHARD, POSTINGS, BLOCK, SHORT = 4096, 1 << 20, 64, 1024
PIECE = 1 << 20
#: Term bytes stay, A-Z become a-z, all others become blanks.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece; pieces end between terms."""
    at = 0
    while at < len(raw):
        cut = _BREAK.search(raw, min(len(raw), at + PIECE))
        end = cut.start() if cut else len(raw)
        yield raw[at:end].translate(_TERM).split()
        at = end


def terms(text: str | None) -> list[bytes]:
    return [t for p in pieces((text or "").encode("utf-8", "surrogatepass")) for t in p]


@dataclass
class Queries:
    """A block of queries over one vocabulary: terms as numbers, with how often each query has them."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    counts: list[np.ndarray]


def queries_of(rows: list[tuple[int | None, str | None]]) -> Queries:
    vocabulary: dict[bytes, int] = {}
    found = Queries([i for i, _ in rows], vocabulary, [], [])
    for _, text in rows:
        own = Counter(vocabulary.setdefault(t, len(vocabulary)) for t in terms(text))
        found.terms.append(np.fromiter(own.keys(), np.int64, len(own)))
        found.counts.append(np.fromiter(own.values(), np.int64, len(own)))
    return found


def blocks(items: DataFrame, id_col: str, text_col: str, most_terms: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """Queries in blocks of bounded size."""
    held, size = [], 0
    for r in items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        held.append((r["i"], r["t"]))
        size += 1 + len(terms(r["t"]))
        if size >= most_terms:
            yield held
            held, size = [], 0
    if held:
        yield held


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms of the whole text), and the vocabulary's terms it holds with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for b in batches:
            sizes, ids, counts, ends = [], [], [], [0]
            for raw in b.column(1).cast(pa.binary()).to_pylist():
                n, own = 0, {}
                for words in pieces(raw or b""):
                    n += len(words)
                    found = Counter(words)
                    for t in known & found.keys():
                        own[t] = own.get(t, 0) + found[t]
                sizes.append(n)
                ids += [vocabulary[t] for t in own]
                counts += own.values()
                ends.append(len(ids))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((ids, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


def statistics(book: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each of ``size`` terms, summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total, some = np.zeros(size, np.int64), 0, 0
        for b in batches:
            n = b.column(0).to_numpy()
            total, some = total + int(n.sum()), some + int((n > 0).sum())
            df += np.bincount(b.column(1).flatten().to_numpy(), minlength=size)
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *own.tolist()], pa.int32()), pa.array([some, total, *df[own].tolist()], pa.int64())], names=["term", "n"])

    sums = {r["term"]: r["n"] for r in book.select("n", "terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return sums.get(-2, 0), sums.get(-1, 0), np.array([sums.get(t, 0) for t in range(size)], np.int64)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Best:
    """The k best documents of a query so far: highest scores, then smallest ids (null last)."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.nulls = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """Documents below this score can't be among the best; 1 while there is room."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        s, i, n = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.nulls, nulls])
        top = np.lexsort((i, n, -s))[: self.k]
        self.scores, self.ids, self.nulls = s[top], i[top], n[top]


class Shard:
    """Inverted index of some documents: for each term its documents (ascending) and impacts."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, n_docs: int, total: int):
        self.ids, self.nulls, self.docs = ids, nulls, len(ids)
        self.blocks = -(-self.docs // BLOCK)
        doc = np.repeat(np.arange(self.docs), sizes)
        m = 75 + (25 * lengths * n_docs) // max(1, total)
        order = np.argsort(term, kind="stable")
        self.doc, term = doc[order], term[order]
        self.impact = (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))[order]
        self.names, self.starts = np.unique(term, return_index=True)
        self.stops = np.append(self.starts[1:], len(term))
        self.long: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def places(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the wanted terms there are, and their places in the index."""
        at = np.searchsorted(self.names, wanted)
        there = (at < len(self.names)) & (self.names[np.minimum(at, len(self.names) - 1)] == wanted) if len(self.names) else np.zeros(len(wanted), bool)
        return np.flatnonzero(there), at[there]

    def blocked(self, values: np.ndarray) -> np.ndarray:
        """The largest value of each block."""
        return np.pad(values, (0, self.blocks * BLOCK - self.docs)).reshape(self.blocks, BLOCK).max(axis=1)

    def long_list(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        """Impacts by document, and the largest of each block."""
        if place not in self.long:
            impacts = np.zeros(self.docs, np.int64)
            own = slice(self.starts[place], self.stops[place])
            impacts[self.doc[own]] = self.impact[own]
            self.long[place] = impacts, self.blocked(impacts)
        return self.long[place]

    def search(self, wanted: np.ndarray, factors: np.ndarray, best: Best) -> int:
        """Put a query's documents to its best; how many blocks were evaluated."""
        there, place = self.places(wanted)
        if not len(there):
            return 0
        factor, length = factors[there], (self.stops - self.starts)[place]
        order = np.argsort(length, kind="stable")
        short = int(np.searchsorted(np.cumsum(length[order]), SHORT, "right"))
        accumulated = np.zeros(self.docs, np.int64)
        for i in order[:short].tolist():
            own = slice(self.starts[place[i]], self.stops[place[i]])
            accumulated[self.doc[own]] += factor[i] * self.impact[own]  # a list has a document once
        bound, lists = self.blocked(accumulated), [(int(factor[i]), *self.long_list(int(place[i]))) for i in order[short:].tolist()]
        for f, _, tops in lists:
            bound = bound + f * tops
        seen = 0
        for b in np.flatnonzero(bound >= best.least).tolist():
            if bound[b] < best.least:
                continue
            seen += 1
            own = slice(b * BLOCK, min(self.docs, (b + 1) * BLOCK))
            scores = accumulated[own].copy()
            for f, impacts, _ in lists:
                scores += f * impacts[own]
            good = np.flatnonzero(scores >= best.least)
            if len(good):
                best.add(scores[good], self.ids[own][good], self.nulls[own][good])
        return seen


def _shards(batches: Iterator[pa.RecordBatch], n_docs: int, total: int) -> Iterator[Shard]:
    held, docs, size = [], 0, 0

    def made() -> Shard:
        t = pa.Table.from_batches(held)
        column = lambda name: t.column(name).combine_chunks()
        ids, terms_of, counts = column("doc_id"), column("terms"), column("counts")
        sizes = terms_of.value_lengths().to_numpy()
        return Shard(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), column("n").to_numpy(), sizes, terms_of.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy(), n_docs, total)

    for b in batches:
        if b.num_rows:
            held.append(b)
            docs, size = docs + b.num_rows, size + len(b.column(2).flatten())
        if docs >= SHARD or size >= POSTINGS:
            yield made()
            held, docs, size = [], 0, 0
    if held:
        yield made()


def best_of_tasks(book: DataFrame, queries: Queries, weight: np.ndarray, n_docs: int, total: int, k: int) -> DataFrame:
    """query, task, doc_id, score: the k best documents of each query in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        task = context.partitionId() if context else 0
        best = [Best(k) for _ in queries.ids]
        factors = [c * weight[t] for t, c in zip(queries.terms, queries.counts, strict=True)]
        for shard in _shards(batches, n_docs, total):
            for q, own in enumerate(best):
                shard.search(queries.terms[q], factors[q], own)
        for q, own in enumerate(best):
            if n := len(own.scores):
                columns = [pa.array([q] * n, pa.int64()), pa.array([task] * n, pa.int64()), pa.array(own.ids, pa.int64(), mask=own.nulls), pa.array(own.scores, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "task", "doc_id", "score"])

    return book.mapInArrow(run, "query long, task long, doc_id long, score long")


def _best(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, most_terms: int = MOST_TERMS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """item_id, query (the query's number), rank, doc_id, score: the k best documents of each query."""
    spark = docs.sparkSession
    small_batches(spark)
    found, first = None, 0
    for rows in blocks(items, item_col, query_col, most_terms):
        queries = queries_of(rows)
        book = materialize(postings(docs, queries.vocabulary, id_col, text_col), "postings")
        n_docs, total, df = statistics(book, len(queries.vocabulary))
        near = best_of_tasks(book, queries, weights(n_docs, df), n_docs, total, k)
        near = _best(near.withColumn("near", F.floor(F.col("task") / 64)), k, "query", "near").drop("rank")
        top = _best(near, k, "query")
        names = F.array(*[F.lit(i).cast("long") for i in queries.ids])
        top = top.select(F.get(names, F.col("query").cast("int")).alias("item_id"), (F.col("query") + first).alias("query"), "rank", "doc_id", "score")
        found, first = top if found is None else found.unionByName(top), first + len(rows)
    return spark.createDataFrame([], "item_id long, query long, rank int, doc_id long, score long") if found is None else found
