"""Token counts of whole texts by overlap resynchronisation.

A huge text is cut into chunks that overlap. Each chunk is encoded by itself, with offsets,
and two neighbours are spliced at a boundary inside their overlap that both encodings have
and that provably doesn't depend on where a chunk was cut; where the overlap has none, it is
widened, at worst to all that is left of the text.

Proven boundary (byte-level BPE with the usual word pattern): every alternative of the
pattern takes white space in its first position only, or takes white space alone. So a
white-space character after a character that isn't white space always begins a new piece,
whatever stands before or after, and BPE never merges across pieces. Special strings hold no
white space, so they don't cross such a boundary either. As a further check, both encodings
must have a token beginning at the boundary.

By the same proof texts of one chunk are counted piece by piece: a piece's count never depends
on its surroundings, so it is asked from the library once and remembered.

Defined results: a null text counts as empty (0 bytes, 0 tokens); null ids pass through;
repeated rows each give a row; an empty table gives an empty result; other columns are
ignored. Texts of any length are counted whole.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import small_batches

#: Characters that are white space to no library, and a cut after one of them.
SAFE = "!-~À-ɏ"
CUT = re.compile(f"(?<=[{SAFE}])[ \\n\\t]")
CHUNK, OVERLAP, REMEMBERED = 8192, 256, 400_000


def splice_count(text: str, starts: Callable[[str], list[int]], chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, encoded in overlapping chunks.

    starts(t) gives the offset of each token of t, in order. The left chunk counts up to the splice,
    the next one begins there: it was encoded from the chunk's start, and only what follows
    the splice is kept of it.
    """
    done, begin, kept_from = 0, 0, 0  # tokens counted; where the open chunk begins; from where its tokens count
    end, here = min(len(text), chunk), starts(text[:chunk])
    while end < len(text):
        width, at = overlap, None
        while at is None:
            low = max(kept_from + 1, end - width)
            there = starts(text[low : low + chunk])
            mine = {begin + a for a in here[bisect_left(here, low - begin) :]}
            theirs = {low + a for a in there[: bisect_left(there, end - low)]}
            good = [p for p in (m.start() for m in CUT.finditer(text, low + 1, end)) if p in mine and p in theirs]
            if good:
                at = good[len(good) // 2]
            elif low == kept_from + 1:  # nothing to splice at in the whole chunk: it grows
                end = min(len(text), 2 * end - begin)
                here = starts(text[begin:end])
                if end == len(text):
                    break
            width *= 2
        if at is not None:
            done += bisect_left(here, at - begin) - bisect_left(here, kept_from - begin)
            begin, kept_from, end, here = low, at, min(len(text), low + chunk), there
    return done + len(here) - bisect_left(here, kept_from - begin)


class Pieces(dict):
    """Tokens of a space and the piece after it. A piece whose end proves no cut gets UNSURE."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, seen: set[str]) -> None:
        new = list(seen.difference(self))
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(seen)
        for piece, n in zip(new, self.encoded([" " + x for x in new]), strict=True):
            self[piece] = n if SAFE_END.search(piece) else UNSURE

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, by cutting at proven boundaries only."""
        cut = [t.split(" ") for t in texts]
        firsts = self.encoded([x[0] for x in cut])
        self.learn(set().union(*(x[1:] for x in cut)))
        found = []
        for text, parts, first in zip(texts, cut, firsts, strict=True):
            n = first + sum(map(self.__getitem__, parts[1:])) if len(parts) == 1 or SAFE_END.search(parts[0]) else UNSURE
            found.append(n if n >= 0 else sum(self.encoded(proven_pieces(text))))
        return found


SAFE_END = re.compile(f"[{SAFE}]$")
UNSURE = -(1 << 60)


def proven_pieces(text: str) -> list[str]:
    """Cut a text at proven boundaries; joined again they are the text."""
    cuts = [0, *(m.start() for m in CUT.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """The tokenizer of a file, kept for the life of the worker."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.processors import ByteLevel

        tokenizer = Tokenizer.from_file(path)
        tokenizer.post_processor = ByteLevel(trim_offsets=False)  # so that offsets are where tokens begin
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _LOADED[path] = Pieces(tokenizer)
    return _LOADED[path]


def count_texts(path: str, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Tokens of each text: huge ones by overlapping chunks, the others by pieces."""
    pieces = load(path)

    def starts(t: str) -> list[int]:
        return [a for a, _ in pieces.tokenizer.encode(t, add_special_tokens=False).offsets]

    short = iter(pieces.count([t for t in texts if len(t) <= chunk]))
    return [next(short) if len(t) <= chunk else splice_count(t, starts, chunk, overlap) for t in texts]


def count_tokens(
    docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of docs.

    path names the tokenizer file, which every executor must have.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = count_texts(path, b.column(1).to_pylist(), chunk, overlap)
            size = pc.binary_length(b.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    counts = rows.mapInArrow(counted, f"doc_id {id_type}, n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
