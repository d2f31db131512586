"""WARC archives in Zstandard frames: writer and reader.

An archive begins with a skippable frame that holds the compression dictionary (the layout
that is published for WARC files in Zstandard), followed by one frame for each record. Spark
writes the archives with its text writer: a row is a frame, and the line separator is an
empty skippable frame, which every Zstandard decoder steps over. So the files reach any file
system Spark can write, under its commit protocol; a lost executor's files are never seen.
The reader takes whole archives (a partition of pages each, so as large as an input split, or
as a partition of the shuffle where there are many revisits) and decodes frame after frame.

Defined results: a null html is an empty payload; a null url is left out of the record; a page
of a null page_id has a record named by its digest, task and ordinal, which is read back as
null, and which revisits a page with an id but is never revisited; repeated rows give
repeated records (equal payloads of one page_id never refer to each other), and different
payloads of one page_id are records of their own, each a revisit or not; an empty table
gives an empty result; other columns are ignored. Payloads of any length are whole.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import materialize, shared_path, small_batches

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGIC = 0x184D2A50
FRAME_MAGIC = 0xFD2FB528
VERSION = "WARC/1.1"
SEPARATOR = struct.pack("<II", SKIPPABLE_MAGIC, 0).decode("ascii")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

#: The dictionary is trained on so many pages at most, each of at most so many bytes.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 16384, 65536
REVISIT_FROM = 1000
#: So many references are sent to all tasks; more of them are joined by a shuffle of the pages.
MOST_BROADCAST = 200_000
FIELDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


class BadArchive(ValueError):
    """An archive that breaks the format: what is wrong and where."""


# -- one record -------------------------------------------------------------------------


def urn(page_id: int | None, spare: str = "") -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:page:null:{spare}>"


def page_of(name: str) -> int | None:
    own = name.removeprefix("<urn:page:").removesuffix(">")
    return None if own.startswith("null:") else int(own)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, spare: str = "") -> bytes:
    """One WARC record; a revisit carries the digest and length of its payload, not the payload.
    ``spare`` names the record where the page has no id."""
    body = payload if refers_to is None else b""
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": urn(page_id, f"{digest}.{spare}"),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else "".join(url.split()),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": None if refers_to is None else PROFILE,
        "WARC-Refers-To": None if refers_to is None else urn(refers_to),
        "WARC-Payload-Length": str(len(payload)),
        "Content-Type": "text/html; charset=utf-8",
        "Content-Length": str(len(body)),
    }
    lines = [VERSION, *(f"{k}: {v}" for k, v in head.items() if v is not None)]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """The fields of a record, after checks of version, headers, lengths and digest."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] != VERSION:
        raise BadArchive(f"not a {VERSION} record: {raw[:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    if len(fields) != len(lines) - 1:
        raise BadArchive(f"a header is broken or given twice: {lines[1:]}")
    if missing := {"WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Payload-Digest", "WARC-Payload-Length", "Content-Length"} - set(fields):
        raise BadArchive(f"headers are missing: {sorted(missing)}")
    size, full = int(fields["Content-Length"]), int(fields["WARC-Payload-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise BadArchive(f"{fields['WARC-Record-ID']}: Content-Length {size}, but {len(rest) - 4} bytes stand there")
    body, digest, kind = rest[:size], fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    refers = fields.get("WARC-Refers-To")
    if kind == "response" and (hashlib.sha1(body).hexdigest() != digest or full != size):
        raise BadArchive(f"{fields['WARC-Record-ID']}: the payload doesn't match its digest or length")
    if kind not in ("response", "revisit") or (kind == "revisit") != (refers is not None):
        raise BadArchive(f"{fields['WARC-Record-ID']}: type {kind} with reference {refers}")
    return page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, full, digest, None if refers is None else page_of(refers), body


# -- frames -----------------------------------------------------------------------------


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends: its blocks are walked by their headers."""
    import zstandard

    pos = at + zstandard.frame_header_size(data[at : at + 18])
    checksum = data[at + 4] & 4
    while True:
        block = int.from_bytes(data[pos : pos + 3], "little")
        size = 1 if (block >> 1) & 3 == 1 else block >> 3
        pos += 3 + size
        if pos > len(data):
            raise BadArchive(f"the frame at byte {at} is cut short")
        if block & 1:
            return pos + (4 if checksum else 0)


def read_archive(content: bytes) -> Iterator[tuple]:
    """The records of one archive."""
    import zstandard

    data, pos = memoryview(content), 0
    plain = zstandard.ZstdDecompressor()
    decoder = plain
    while pos < len(data):
        if len(data) - pos < 8:
            raise BadArchive(f"{len(data) - pos} bytes are left over")
        magic, size = struct.unpack_from("<II", data, pos)
        if magic & 0xFFFFFFF0 == SKIPPABLE_MAGIC:
            held = bytes(data[pos + 8 : pos + 8 + size])
            if len(held) != size:
                raise BadArchive("a skippable frame is cut short")
            if magic == DICTIONARY_MAGIC and pos == 0:
                if held[:4] == struct.pack("<I", FRAME_MAGIC):
                    held = plain.decompress(held)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
            pos += 8 + size
        elif magic == FRAME_MAGIC:
            end = frame_end(data, pos)
            yield parse(decoder.decompress(data[pos:end]))
            pos = end
        else:
            raise BadArchive(f"no frame begins at byte {pos}")


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


# -- Spark ------------------------------------------------------------------------------


def described(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    raw = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.octet_length(raw).cast("long").alias("size"), F.sha1(raw).alias("payload_digest")
    )


def references(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """page_id, payload_digest, refers_to of the payloads that revisit another page's: those of at least ``least``
    bytes that the page with the largest id also has. Only payloads had twice are joined."""
    meta = materialize(described(pages).where(F.col("size") >= least).select("page_id", "payload_digest"), "warc-digests")
    first = meta.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"), F.count_if(F.col("page_id").isNull()).alias("unnamed"))
    twice = first.where((F.col("refers_to") != F.col("least")) | (F.col("refers_to").isNotNull() & (F.col("unnamed") > 0))).select("payload_digest", "refers_to")
    return meta.join(twice, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "payload_digest", "refers_to").distinct()


def train_dictionary(pages: DataFrame, html_col: str = "html") -> bytes:
    """A dictionary from a bounded sample of pages; empty where they are too few to train one."""
    import zstandard

    html = F.col(html_col)
    fit = pages.where(F.octet_length(html).between(64, SAMPLE_BYTES)).select(html.alias("h"), F.xxhash64(html).alias("at"))
    last = fit.select("at").distinct().orderBy("at").limit(SAMPLE_ROWS).agg(F.max("at").alias("at")).first()["at"]
    if last is None:
        return b""
    # each page once, though a third of them may be the same
    sample = [r["h"].encode() for r in fit.where(F.col("at") <= last).groupBy("at").agg(F.first("h").alias("h")).orderBy("at").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes() if len(sample) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, path: str, level: int = 3, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Write each partition of pages as one archive under path, which is returned."""
    spark = pages.sparkSession
    small_batches(spark)
    dictionary = train_dictionary(pages, html_col)
    refs = materialize(references(pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))), "warc-references").toDF("ref_id", "ref_digest", "refers_to")
    refs = F.broadcast(refs) if refs.count() <= MOST_BROADCAST else refs
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")
    )
    same = F.col("page_id").eqNullSafe(F.col("ref_id")) & (F.sha1("payload") == F.col("ref_digest"))
    rows = rows.join(refs, same, "left").select("page_id", "url", "payload", "refers_to")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        task, nth = TaskContext.get().partitionId(), 0
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        encoder = zstandard.ZstdCompressor(level=level, dict_data=own, write_checksum=True, write_content_size=True)
        begun = not dictionary
        for b in batches:
            out = [] if begun else [skippable(DICTIONARY_MAGIC, dictionary)]
            begun = begun or b.num_rows > 0
            for page_id, url, payload, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.append(encoder.compress(record(page_id, url, payload, hashlib.sha1(payload).hexdigest(), refers, f"{task}.{nth}")))
                nth += 1
            yield pa.RecordBatch.from_arrays([pa.array(out if begun else [], pa.binary())], names=["frame"])

    rows.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)
    return path


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path; a broken archive ends the job with its fault."""
    small_batches(spark)
    archives = spark.read.format("binaryFile").load(path).select("path", "content")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in FIELDS.split(", ")]
        for b in batches:
            for place, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held: list[tuple] = []
                try:
                    for r in read_archive(content.as_buffer()):
                        held.append(r)
                        if len(held) == 256:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                            held = []
                except BadArchive as fault:
                    raise BadArchive(f"{place}: {fault}") from fault
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return archives.mapInArrow(records, FIELDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder and read them back."""
    return read_archives(pages.sparkSession, write_archives(pages, shared_path(pages.sparkSession, "warc")))
