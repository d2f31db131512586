"""Benchmark decontamination by a random-walk embedding of edit distance.

A passage of a document leaks an item if at most ``errors`` of the item's words were
inserted, deleted or replaced. Search and proof:

1.  Windows. Of an item's runs of SEED words (fewer for short items) an edit spoils SEED at
    most, so a leaking passage still has a known number of them. Runs are looked up for every
    place of every text, and leave the item-sized windows that can leak any item at all. This
    loses nothing; which item a window may leak is left to the tables.
2.  Embedding. Window and item are mapped by the same random walk (at each step a random bit
    for the step and the word under the pointer says whether the pointer moves on), which
    turns edit distance into Hamming distance, within a quadratic factor.
3.  Bit sampling. Items are stored in hash tables, by keys of the symbols at random steps of
    several walks; the keys of an embedded window are looked up there, and the items of its
    buckets are its candidates. Steps are drawn from the part of a walk that hardly any pointer
    has left, and keys that hold padding count for nothing. The number of tables follows from
    the wanted recall and the share of steps that may differ.
    A walk over up to SHORT words has too few steps for that: such an item is a candidate of
    every window the run filter leaves for it, so it is searched exactly.
4.  Proof. Candidates are compared by exact edit distance between the item and the best
    passage of the text around the window.

Documents are searched where they lie: nothing is shuffled. Items are sent to all tasks,
which is right for benchmarks up to ``most_words`` words in all; above that the items are dealt
into blocks of that size, and the documents are searched once for each block.

Defined results: words are compared by Unicode case folding, in NFKC and without punctuation;
a null text has no words and leaks nothing; null ids pass through; items
without words, or with a null id, are left out; items shorter than SEED words must occur
exactly; repeated rows each give a row; an empty table gives an empty result, and without
items nothing leaks; other columns are ignored in ``find_leaks``. Texts are searched whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import small_batches
from .wordhash import folded_hashes

ERRORS, SEED, WALKS, RECALL, BITS = 0.2, 3, 4, 0.999, 2
MOST_WORDS = 2_000_000
#: Words of items that are searched without tables.
SHORT = 16


def word_ids(text: str | None) -> np.ndarray:
    """64-bit ids of a text's words (between Unicode white space) without case and punctuation
    of any script, see ``wordhash.folded``."""
    return folded_hashes(text or "")


def runs(a: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words."""
    h = np.zeros(max(0, len(a) - k + 1), dtype=np.uint64)
    for i in range(k):
        h = (h ^ a[i : len(a) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def allowed(n: int, errors: float) -> int:
    return int(n * errors)


def seed_length(n: int, errors: float) -> int:
    """Words that any leaking passage shares with its item in a row, SEED at most."""
    k = allowed(n, errors)
    return max(1, min(SEED if k else n, (n - k) // (k + 1)))


def least_runs(item: np.ndarray, errors: float) -> int:
    """Places of an item's runs that any leaking passage has too: an edit spoils k of them at most."""
    n, k = len(item), seed_length(len(item), errors)
    return max(1, n - k + 1 - k * allowed(n, errors))


def _coin(step: int, walk: int, words: np.ndarray) -> np.ndarray:
    """The random bit of a step for each word."""
    salt = np.uint64(((step + 1) * 0x9E3779B97F4A7C15 + (walk + 1) * 0xC2B2AE3D27D4EB4F) & (2**64 - 1))
    h = (words ^ salt) * np.uint64(0xFF51AFD7ED558CCD)
    return ((h ^ (h >> np.uint64(33))) >> np.uint64(17)) & np.uint64(1)


def walk_length(n: int) -> int:
    """Steps that a pointer, which moves on at every other step, spends within n words but for rare cases."""
    return max(1, int(2 * n - 2 * math.sqrt(2 * n)))


def embed(windows: np.ndarray, walk: int) -> np.ndarray:
    """Random-walk embedding of equally long rows of words, a symbol for each step.

    A pointer that has left its row gives the padding symbol 0 from then on.
    """
    rows, n = windows.shape
    padded = np.concatenate([windows, np.zeros((rows, 1), np.uint64)], axis=1)
    at, each, out = np.zeros(rows, np.int64), np.arange(rows), np.empty((rows, walk_length(n)), np.uint64)
    for step in range(out.shape[1]):
        here = padded[each, at]
        out[:, step] = here
        at = np.minimum(n, at + _coin(step, walk, here).astype(np.int64))
    return out


def tables(n: int, errors: float, recall: float = RECALL, bits: int = BITS) -> np.ndarray:
    """The sampled steps of each table (a row) for items of n words.

    Walks of edit distance k differ in about 2 k steps for each edit as they resynchronise, at
    most in all; a table of ``bits`` steps agrees with the chance (1 - share)^bits, and enough
    tables are taken for the recall.
    """
    steps = walk_length(n)
    share = min(0.75, 2.0 * max(1, 2 * allowed(n, errors)) / (2 * n) + 0.1)
    bits = min(bits, steps)
    count = max(4, math.ceil(math.log(1 - recall) / math.log(1 - (1 - share) ** bits)))
    rng = np.random.default_rng(n * 7919 + bits)
    return np.stack([rng.choice(steps, size=bits, replace=False) for _ in range(count)])


def table_keys(windows: np.ndarray, steps: np.ndarray, walk: int) -> np.ndarray:
    """The key of each window in each table of a walk; 0 where it holds padding.

    Every other walk goes backwards: a walk that meets an edit early is out of step for long.
    """
    symbols = embed(windows[:, ::-1] if walk % 2 else windows, walk)[:, steps]
    keys = np.full(symbols.shape[:2], walk + 1, np.uint64) + np.arange(len(steps), dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for i in range(steps.shape[1]):
        keys = (keys ^ symbols[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return np.where((symbols == 0).any(axis=2), np.uint64(0), keys)


def passage_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance between the item and any passage of the text, and where it ends."""
    row = np.zeros(len(text) + 1, dtype=np.int64)
    steps = np.arange(len(text) + 1)
    for i, word in enumerate(item):
        nxt = np.empty_like(row)
        nxt[0] = i + 1
        nxt[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(nxt - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


class Items:
    """Items of a block: their runs, and the hash tables of their embeddings."""

    def __init__(self, items: list[tuple[int, str]], errors: float = ERRORS, recall: float = RECALL):
        words = [(i, word_ids(t)) for i, t in items]
        words = [(i, w) for i, w in words if len(w)]
        self.ids, self.words, self.errors = [i for i, _ in words], [w for _, w in words], errors
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        grouped: dict[int, list[tuple[int, int, int]]] = {}
        for place, w in enumerate(self.words):
            k = seed_length(len(w), errors)
            for at, h in enumerate(runs(w, k)):
                grouped.setdefault(k, []).append((int(h), place, at))
        for k, rows in grouped.items():
            rows.sort()
            self.by_length[k] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))
        self.least = np.array([least_runs(w, errors) for w in self.words], np.int64)
        self.sieve = {k: self._sieve(v[0]) for k, v in self.by_length.items()}
        self.steps = {n: tables(n, errors, recall) for n in set(self.sizes.tolist())}
        self.buckets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, steps in self.steps.items():
            if n <= SHORT:
                continue
            own = np.flatnonzero(self.sizes == n)
            keys = np.concatenate([table_keys(np.stack([self.words[i] for i in own]), steps, walk) for walk in range(WALKS)], axis=1)
            place, keys = np.repeat(own, keys.shape[1])[keys.ravel() != 0], keys.ravel()[keys.ravel() != 0]
            order = np.argsort(keys, kind="stable")
            self.buckets[n] = keys[order], place[order]

    @staticmethod
    def _sieve(hashes: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << 20, dtype=bool)
        bits[(hashes >> np.uint64(44)).astype(np.int64)] = True
        return bits

    def windows(self, a: np.ndarray) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
        """For each length of long items the first words of the windows that can leak one of them, and
        the same for each short item: windows at runs shared with an item of whose runs the text
        has as many as any leaking passage has."""
        found: dict[int, list[np.ndarray]] = {}
        short: dict[int, list[np.ndarray]] = {}
        for k, (hashes, place, at) in self.by_length.items():
            h = runs(a, k)
            near = np.flatnonzero(self.sieve[k][(h >> np.uint64(44)).astype(np.int64)])
            if not len(near):
                continue
            low, high = np.searchsorted(hashes, h[near], "left"), np.searchsorted(hashes, h[near], "right")
            width = high - low
            total = int(width.sum())
            if not total:
                continue
            row = np.arange(total) + np.repeat(low - (np.cumsum(width) - width), width)
            distinct = np.unique(row)
            enough = np.bincount(place[distinct], minlength=len(self.words)) >= self.least
            keep = enough[place[row]]
            item, start = place[row[keep]], np.repeat(near, width)[keep] - at[row[keep]]
            size = self.sizes[item]
            for n in np.unique(size[size > SHORT]).tolist():
                found.setdefault(n, []).append(start[size == n])
            for i in np.unique(item[size <= SHORT]).tolist():
                short.setdefault(i, []).append(start[item == i])
        every = lambda starts: {k: np.unique(np.concatenate(x)) for k, x in starts.items()}
        return every(found), every(short)

    def candidates(self, a: np.ndarray) -> dict[int, np.ndarray]:
        """For each item the windows that fall into one of its buckets; all that are left of a short one."""
        found: dict[int, list[np.ndarray]] = {}
        long, short = self.windows(a)
        for n, starts in long.items():
            starts = starts[(starts > -n) & (starts < len(a))]
            keys, place = self.buckets[n]
            padded = np.concatenate([np.zeros(n, np.uint64), a, np.zeros(2 * n, np.uint64)])
            for part in np.split(starts, range(WINDOWS, len(starts), WINDOWS)):
                rows = padded[(part + n)[:, None] + np.arange(n)[None, :]]
                own = np.concatenate([table_keys(rows, self.steps[n], walk) for walk in range(WALKS)], axis=1)
                start, own = np.repeat(part, own.shape[1]), own.ravel()
                low = np.searchsorted(keys, own, "left")
                width = np.where(own != 0, np.searchsorted(keys, own, "right") - low, 0)
                hit = np.repeat(low - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
                item, at = place[hit], np.repeat(start, width)
                for i in np.unique(item).tolist():
                    found.setdefault(i, []).append(at[item == i])
        return short | {i: np.unique(np.concatenate(x)) for i, x in found.items()}

    def leaks(self, a: np.ndarray) -> list[tuple[int, int, int]]:
        """(item id, edit distance, word where the passage ends) of the items a text leaks."""
        found = []
        for place, starts in self.candidates(a).items():
            item = self.words[place]
            n, k = len(item), allowed(len(item), self.errors)
            best: tuple[int, int] | None = None
            for low, high in spans(starts, n, k, len(a)):
                d, end = passage_distance(item, a[low:high])
                if d <= k and (best is None or d < best[0]):
                    best = (d, low + end)
            if best:
                found.append((self.ids[place], *best))
        return found


#: Windows that are embedded at once.
WINDOWS = 4096


def spans(starts: np.ndarray, n: int, k: int, words: int) -> list[tuple[int, int]]:
    """The parts of a text around windows of n words, k more on both sides; parts that overlap are one."""
    found: list[tuple[int, int]] = []
    for s in starts.tolist():
        low, high = max(0, s - k), min(words, s + n + k)
        if found and low <= found[-1][1]:
            found[-1] = found[-1][0], high
        else:
            found.append((low, high))
    return found


_INDEX: list = [None, None]


def index_of(items: list[tuple[int, str]], errors: float, recall: float) -> Items:
    """The index of a block, kept by the Python worker until another block is asked for."""
    key = hash((tuple(items), errors, recall))
    if _INDEX[0] != key:
        _INDEX[:] = key, Items(items, errors, recall)
    return _INDEX[1]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size."""
    held: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        held.append((r["i"], r["t"]))
        size += len(r["t"].split())
        if size >= most_words:
            yield held
            held, size = [], 0
    if held:
        yield held


def _search(rows: DataFrame, items: list[tuple[int, str]], errors: float, recall: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(items, errors, recall)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("end_word", pa.int64())]))
        for b in batches:
            found = [[{"item_id": i, "edits": d, "end_word": e} for i, d, e in sorted(index.leaks(word_ids(t)))] for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, kind)], names=[*b.schema.names[:-1], "leaks"])

    kinds = [f"`{n}` {k}" for n, k in rows.dtypes[:-1]]
    return rows.mapInArrow(run, ", ".join([*kinds, "leaks array<struct<item_id: long, edits: int, end_word: long>>"]))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, recall: float = RECALL, most_words: int = MOST_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and leaks (item_id, edits, end_word) of each row of docs."""
    small_batches(docs.sparkSession)
    found = docs.select(F.col(id_col).alias("doc_id"), F.expr("CAST(array() AS array<struct<item_id: long, edits: int, end_word: long>>)").alias("all"), F.col(text_col).alias("text"))
    for b in blocks(benchmark, "item_id", "text", most_words):
        searched = _search(found.withColumn("_text", F.col("text")), b, errors, recall)
        found = searched.select("doc_id", F.array_sort(F.concat("all", "leaks")).alias("all"), "text")
    return found.select("doc_id", F.col("all").alias("leaks"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without those that leak an item, with all their columns."""
    small_batches(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("_text", F.col(f"c{names.index(text_col)}"))
    for b in blocks(benchmark, "item_id", "text", options.get("most_words", MOST_WORDS)):
        searched = _search(plain, b, options.get("errors", ERRORS), options.get("recall", RECALL))
        plain = searched.where(F.size("leaks") == 0).drop("leaks").withColumn("_text", F.col(f"c{names.index(text_col)}"))
    return plain.drop("_text").toDF(*names)
