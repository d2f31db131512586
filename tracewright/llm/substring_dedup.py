"""Removal of repeated passages by winnowed seeds that are extended to both sides.

A window of ``least`` words is a repeat if its words also start earlier: in a document with a
smaller id, or earlier in the same one. Words covered by a repeat go.

1.  Winnowing. Every window chooses an anchor: of its runs of a few words the one of the least
    hash, the leftmost if there are several. Equal windows choose equal anchors at the same place,
    so nothing else need be joined. Neighbouring windows mostly share their anchor; together
    they are its seed, which reaches as far to both sides as its windows do.
2.  Seeds whose anchor occurs once, which are most of unrepeated text, are out.
3.  Extension. Seeds of one anchor that agree in all of their reach, a class, are repeats of the
    earliest one as they stand. An anchor's classes differ at the edges of passages: the earliest
    seed of each class is extended word by word, a row for each of its windows, and its windows
    are compared one by one with those of the anchor's other classes.
4.  Maximal repeats are what a document's repeats cover together; its text is cut by them.

Groups are never gathered: classes and windows are reduced to the earliest one and a count by
partial aggregation, and met again by joins that Spark can split, so a passage in a third of all
documents is spread like any other.

Defined results: words are runs without ASCII white space, compared as they are; a null text has
none; rows that share a doc_id are the same document (a window is no repeat of one at the same
start), and a null doc_id comes after all others; repeated rows each give a row; an empty table
gives an empty result; other columns are ignored. Texts are read whole, very long ones in slices.
Words and windows are compared by 64-bit hashes, windows among those of one anchor.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import AS_THEY_ARE, PIECE, finish, powers, word_hashes, words_in
from .util import discard, materialize, small_batches

LEAST = 20
#: Words of a long text that are winnowed at once.
SLICE = 1 << 16
_BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")
DOC = ("nul", "doc", "digest")


def anchor_words(least: int) -> int:
    """Words of an anchor: about a third of a window."""
    return max(1, 3 * least // 10)


class Runs:
    """Hashes of runs of words of any length."""

    def __init__(self, words: np.ndarray):
        rise, self.fall = powers(max(1, len(words)))
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * rise[: len(words)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return finish((self.sums[stop] - self.sums[start]) * self.fall[start])


def winnowed(words: np.ndarray, ends: np.ndarray, least: int) -> dict[str, np.ndarray]:
    """Seeds of documents laid end to end (``ends``: for each word where its document stops):
    anchor, reach (its hash), shape (of the reach around the anchor), at (the anchor), low and
    high (its first and last window)."""
    k = anchor_words(least)
    choices = least - k + 1
    n = len(words)
    starts = np.flatnonzero(np.arange(n) + least <= ends)
    if not len(starts):
        none = np.empty(0, np.int64)
        return {"anchor": none, "reach": none, "shape": none, "at": none, "low": none, "high": none}
    runs, every = Runs(words), np.arange(n - k + 1)
    anchors = runs.of(every, every + k)
    at = starts + np.lib.stride_tricks.sliding_window_view(anchors, choices)[starts].argmin(axis=1)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    low, high, at = starts[first], starts[np.append(first[1:], len(at)) - 1], at[first]
    return {"anchor": anchors[at].view(np.int64), "reach": runs.of(low, high + least).view(np.int64), "shape": (at - low) * choices + (high - low), "at": at, "low": low, "high": high}


def seeds_of(texts: list[bytes | None], least: int) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """(numbers of texts, their seeds), for some texts at a time, or a slice of a long one."""
    held: list[tuple[int, bytes]] = []

    def together() -> tuple[np.ndarray, dict[str, np.ndarray]]:
        begin, words = words_in(b" ".join(t for _, t in held), AS_THEY_ARE)
        stops = np.searchsorted(begin, np.cumsum([len(t) + 1 for _, t in held]))
        sizes = np.diff(stops, prepend=0)
        seeds = winnowed(words, np.repeat(stops, sizes), least)
        own = np.searchsorted(stops, seeds["at"], "right")
        before = np.append(0, stops)[own]
        for name in ("at", "low", "high"):
            seeds[name] = seeds[name] - before
        return np.array([i for i, _ in held], np.int64)[own], seeds

    size = 0
    for i, text in enumerate(texts):
        text = text or b""
        if size + len(text) > PIECE and held:
            yield together()
            held, size = [], 0
        if len(text) <= PIECE:
            held.append((i, text))
            size += len(text) + 1
            continue
        words, edge = word_hashes(text, AS_THEY_ARE), 2 * least  # no seed reaches further than a window to either side
        for low in range(0, len(words), SLICE):
            since = max(0, low - edge)
            part = words[since : low + SLICE + edge]
            seeds = winnowed(part, np.full(len(part), len(part)), least)
            inside = (seeds["at"] >= low - since) & (seeds["at"] < low - since + SLICE)
            seeds = {name: x[inside] + (since if name in ("at", "low", "high") else 0) for name, x in seeds.items()}
            yield np.full(len(seeds["at"]), i), seeds
    if held:
        yield together()


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """DOC (what tells documents apart) and text."""
    i, t = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(i.isNull().alias("nul"), F.coalesce(i.cast("long"), F.lit(0)).alias("doc"), F.xxhash64(t).alias("digest"), t.alias("text"))


_DOC_KINDS = "nul boolean, doc long, digest long"


def _seeds(rows: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, s in seeds_of(b.column(3).cast(pa.binary()).to_pylist(), least):
                columns = [c.take(pa.array(own)) for c in b.columns[:3]]
                columns += [pa.array(s["anchor"]), pa.array(s["reach"]), pa.array(s["shape"], pa.int32()), pa.array(s["at"])]
                yield pa.RecordBatch.from_arrays(columns, names=[*DOC, "anchor", "reach", "shape", "at"])

    return rows.mapInArrow(run, f"{_DOC_KINDS}, anchor long, reach long, shape int, at long")


def _windows(rows: DataFrame, least: int) -> DataFrame:
    """The windows of a document's open seeds: anchor, window (its hash), at (its start)."""
    k = anchor_words(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (text, seeds) in enumerate(zip(b.column(3).cast(pa.binary()).to_pylist(), b.column(4).to_pylist(), strict=True)):
                words = word_hashes(text, AS_THEY_ARE)
                own = np.array([(s["at"], s["low"], s["high"]) for s in seeds], np.int64)
                own = own[np.argsort(own[:, 1])]
                for part in np.split(own, np.searchsorted(own[:, 1], np.arange(SLICE, len(words), SLICE))):
                    if not len(part):
                        continue
                    since = part[0, 1]
                    runs = Runs(words[since : part[-1, 2] + least])
                    at, low, size = part[:, 0] - since, part[:, 1] - since, part[:, 2] - part[:, 1] + 1
                    start = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                    columns = [c.take(pa.array(np.full(len(start), i))) for c in b.columns[:3]]
                    columns += [pa.array(np.repeat(runs.of(at, at + k), size).view(np.int64)), pa.array(runs.of(start, start + least).view(np.int64)), pa.array(start + since)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*DOC, "anchor", "window", "at"])

    return rows.mapInArrow(run, f"{_DOC_KINDS}, anchor long, window long, at long")


def _place() -> Column:
    """The order of documents and of places in them."""
    return F.struct("nul", "doc", "at")


def _firsts(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n"))


def repeats(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """DOC and spans (array of low, high) of words covered by repeats, for documents that have any."""
    c, choices = F.col, least - anchor_words(least) + 1
    rows = _documents(docs, id_col, text_col)
    seeds = materialize(_seeds(rows, least), "seeds")
    often = materialize(seeds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "often")
    live = materialize(seeds.join(often, "anchor"), "live")
    discard(seeds, often)
    # classes of an anchor: the earliest seed of each, and whether there are others
    classes = materialize(_firsts(live, "anchor", "reach", "shape"), "classes")
    several = materialize(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_classes")).where("n_classes > 1").select("anchor", F.lit(True).alias("open")), "several")
    told = materialize(classes.join(several, "anchor", "left").where("n > 1 OR open"), "told")
    low = c("at") - F.floor(c("shape") / choices)
    met = live.join(told.select("anchor", "reach", "shape", "first", "open"), ["anchor", "reach", "shape"]).select(
        *DOC, "at", low.alias("low"), (low + c("shape") % choices).alias("high"), (_place() > c("first")).alias("again"), F.coalesce("open", F.lit(False)).alias("open")
    )
    met = materialize(met.where("again OR open"), "met")
    discard(live, classes, several, told)
    # what is left to extend word by word
    asked = materialize(met.where("open AND NOT again").groupBy(*DOC).agg(F.collect_set(F.struct("at", "low", "high")).alias("seeds")), "asked")
    windows = materialize(_windows(rows.join(asked, [*DOC]).select(*DOC, "text", "seeds"), least), "windows")
    earliest = materialize(_firsts(windows, "anchor", "window").where("n > 1"), "earliest")
    later = windows.join(earliest, ["anchor", "window"]).where(_place() > c("first")).select(*DOC, c("at").alias("low"), c("at").alias("high"))
    spans = met.where("again").select(*DOC, "low", "high").unionByName(later).select(*DOC, F.struct("low", (c("high") + least).alias("high")).alias("span"))
    found = materialize(spans.groupBy(*DOC).agg(F.collect_set("span").alias("spans")), "repeats")
    discard(met, asked, windows, earliest)
    return found


def cut(text: bytes, spans: list[dict] | None) -> tuple[int, int, bytes]:
    """Words of a text, those within spans, and the others joined by one space."""
    edges: dict[int, int] = {}
    for s in spans or ():
        edges[s["low"]] = edges.get(s["low"], 0) + 1
        edges[s["high"]] = edges.get(s["high"], 0) - 1
    turns = [(at, depth) for at, depth in zip(sorted(edges), np.cumsum([edges[x] for x in sorted(edges)]).tolist(), strict=True)]
    gone = []  # maximal repeats: (low, high)
    for at, depth in turns:
        if depth and (not gone or gone[-1][1] is not None):
            gone.append([at, None])
        elif not depth:
            gone[-1][1] = at
    parts, n, removed, at, i = [], 0, 0, 0, 0
    while at < len(text):
        blank = _BLANK.search(text, min(len(text), at + PIECE))
        end = blank.start() if blank else len(text)
        words, kept, own = text[at:end].split(), [], 0
        stop = n + len(words)
        while i < len(gone) and gone[i][0] < stop:
            low, high = max(gone[i][0], n), min(gone[i][1], stop)
            kept += words[own : low - n]
            removed, own = removed + high - low, high - n
            if gone[i][1] > stop:
                break
            i += 1
        kept += words[own:]
        if kept:
            parts.append(b" ".join(kept))
        n, at = stop, end
    return n, removed, b" ".join(parts)


def remove_repeats(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, text (the kept words, joined by one space)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [cut(t, s) for t, s in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True)]
            n, removed, texts = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    found = repeats(docs, least, id_col, text_col)
    rows = _documents(docs, id_col, text_col).join(found, [*DOC], "left")
    rows = rows.select(F.when(~F.col("nul"), F.col("doc")).alias("doc_id"), "text", "spans")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")
