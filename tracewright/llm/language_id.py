"""Language identification by fusing evidence the Bayesian way.

A page's posterior over languages is the product of

* the likelihood of its visible text under character and word models,
* the chance of its declared markup language, and of its address suffix, in each language,
* a prior of its host, smoothed towards its domain and that towards all pages.

The text models come from a bounded sample of labelled documents. Everything else is counted
over all pages by grouped aggregation of the posteriors that text alone gives; a page's own
share is taken out of its host's counts, so that it doesn't vouch for itself.

Defined results: a null or empty page has no text evidence; an address without a host has
the prior of all pages; missing declarations and suffixes say nothing; null ids pass
through; repeated rows each give a row; an empty table gives an empty result, and without
labelled documents every language is null; where posteriors tie, the language that comes first
by name wins; other columns are ignored. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_dedup import host_of, visible_lines
from .util import materialize, small_batches

BUCKETS, SAMPLE_ROWS = 1 << 15, 4000
#: Overlapping n-grams aren't independent; their log-likelihood counts for this share.
TEMPER = 0.2
#: Pages that a level's counts are worth against the level above it.
HOST_STRENGTH, FIELD_STRENGTH = 20.0, 5.0


def features(word: str) -> list[int]:
    """Buckets of a word: itself, and its character trigrams with its ends marked."""
    import xxhash

    w = f"^{word}$"
    parts = [w, *(w[i : i + 3] for i in range(max(1, len(w) - 2)))]
    return [xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


class _Features(dict):
    def __missing__(self, word: str) -> list[int]:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = features(word)
        return value


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and log P(bucket | language), from a sample of about ``sample_rows`` distinct
    texts, as many of each language, that a hash of the text picks. The counts are added up by
    Spark; the driver gets languages x BUCKETS numbers at most, and every labelled language has a model."""
    small_batches(docs.sparkSession)
    labelled = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    key = F.xxhash64("text", F.lit(1))
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct(key).alias("n"))  # one row a language
    counts_of = {r["lang"]: max(1, r["n"]) for r in sizes.collect()}
    langs = sorted(counts_of)
    if not langs:
        return [], np.zeros((0, BUCKETS))
    share = {x: min(1.0, sample_rows / len(langs) / n) for x, n in counts_of.items()}
    bound = F.create_map(*[F.lit(v) for x in langs for v in (x, int(share[x] * 1_000_000) + 1)])
    picked = labelled.withColumn("key", key).where(F.pmod("key", F.lit(1_000_000)) < F.element_at(bound, F.col("lang")))
    picked = picked.groupBy("lang", "key").agg(F.first("text").alias("text")).select("lang", "text")  # copies count once

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, memo = np.zeros((len(langs), BUCKETS), np.int64), _Features()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = [f for w in text.lower().split() for f in memo[w]]
                held[langs.index(lang)] += np.bincount(np.array(found, dtype=np.int64), minlength=BUCKETS)
        x, y = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(held[x, y], pa.int64())], names=["l", "f", "n"])

    counts = np.zeros((len(langs), BUCKETS))
    for r in picked.mapInArrow(count, "l long, f long, n long").groupBy("l", "f").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["l"], r["f"]] = r["n"]
    smooth = counts + 0.5
    return langs, np.log(smooth / smooth.sum(axis=1, keepdims=True))


def text_scores(rows: DataFrame, log_p: np.ndarray) -> DataFrame:
    """Replace the last column, text, by ``ll``: tempered log-likelihoods, largest 0."""
    langs = len(log_p)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = log_p.astype(np.float32)

        class Rows(dict):
            """The place of each word's scores in a growing table."""

            def __init__(self):
                super().__init__()
                self.table = np.zeros((1 << 12, langs), np.float32)

            def __missing__(self, word: str) -> int:
                at = len(self)
                if at == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[at] = model[:, features(word)].sum(axis=1)
                self[word] = at
                return at

        memo = Rows()
        for b in batches:
            if len(memo) > 300_000:
                memo = Rows()
            found = []
            for text in b.column(b.num_columns - 1).to_pylist():
                w = (text or "").lower().split()
                at = np.fromiter(map(memo.__getitem__, w), dtype=np.int64, count=len(w))
                ll = memo.table[at].sum(axis=0, dtype=np.float64) * TEMPER if len(at) else np.zeros(langs)
                found.append((ll - ll.max(initial=-np.inf)).tolist() if langs else [])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.float64()))], names=[*b.schema.names[:-1], "ll"])

    kinds = [f"`{n}` {k}" for n, k in rows.dtypes[:-1]]
    return rows.mapInArrow(score, ", ".join([*kinds, "ll array<double>"]))


def declared_language(html: Column) -> Column:
    found = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    return F.when(found != "", found)


def address_suffix(url: Column) -> Column:
    """What an address says of its language: a two-letter first path segment, else the last
    label of its host if it is a country's (two letters)."""
    segment = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    country = F.regexp_extract(host_of(url), r"\.([a-z]{2})$", 1)
    return F.when(segment != "", F.concat(F.lit("/"), segment)).when(country != "", F.concat(F.lit("."), country))


def domain_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)


def _softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def _plus(*arrays: Column) -> Column:
    total = arrays[0]
    for a in arrays[1:]:
        total = F.zip_with(total, a, lambda x, y: x + y)
    return total


def _sums(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """Posterior mass by language for each key, as one array."""
    each = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)]
    return rows.groupBy(*keys).agg(*each).select(*keys, F.array(*[f"s{i}" for i in range(n)]).alias("mass"))


def _field(rows: DataFrame, n: int, name: str, prior: np.ndarray, total: np.ndarray) -> DataFrame:
    """log P(value | language) of a field; values are two or three letters, so they are few."""
    mass = _sums(rows.where(F.col(name).isNotNull()), n, name)
    size = F.aggregate("mass", F.lit(0.0), lambda a, x: a + x)
    share = float(1.0 / max(1.0, total.sum()))
    back = F.array(*[F.lit(float(t)) for t in total])
    log = F.zip_with("mass", back, lambda m, t: F.log((m + FIELD_STRENGTH * size * share) / (t + FIELD_STRENGTH)))
    return mass.select(name, log.alias(f"{name}_log"))


def identify(pages: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, suffix and host of each page."""
    langs, log_p = model
    small_batches(pages.sparkSession)
    url, html = F.col(url_col), F.col(html_col)
    rows = pages.select(
        F.col(id_col).alias("page_id"), host_of(url).alias("host"), declared_language(html).alias("declared"), address_suffix(url).alias("suffix"),
        F.array_join(visible_lines(html), "\n").alias("text"),
    )
    if not langs:
        none = F.lit(None).cast("string")
        return rows.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("text_lang"), "declared", "suffix", "host")
    n = len(langs)
    scored = text_scores(rows, log_p).withColumn("p", _softmax(F.col("ll"))).withColumn("domain", domain_of(F.col("host")))
    scored = materialize(scored, "language-text")

    top = _sums(scored, n).first()
    total = np.array([v or 0.0 for v in top["mass"]]) if top else np.zeros(n)
    prior = (total + 1.0) / (total.sum() + n)
    const = lambda v: F.array(*[F.lit(float(x)) for x in v])
    domains = materialize(_sums(scored.where("domain IS NOT NULL"), n, "domain").withColumnRenamed("mass", "domain_mass"), "language-domains")
    hosts = materialize(_sums(scored.where("host IS NOT NULL"), n, "host").withColumnRenamed("mass", "host_mass"), "language-hosts")
    declared = _field(scored, n, "declared", prior, total)
    suffix = _field(scored, n, "suffix", prior, total)

    def smoothed(mass: Column, above: Column) -> Column:
        """Counts without the page itself, smoothed towards the level above."""
        rest = F.zip_with(F.coalesce(mass, F.col("p")), F.col("p"), lambda m, p: F.greatest(m - p, F.lit(0.0)))
        size = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(rest, above, lambda r, a: (r + HOST_STRENGTH * a) / (size + HOST_STRENGTH))

    # pages without a host are many null keys, which a join would send to one task
    placed = scored.where("host IS NOT NULL").join(hosts, "host", "left").join(domains, "domain", "left")
    unplaced = scored.where("host IS NULL").select("*", *[F.lit(None).cast("array<double>").alias(f"{x}_mass") for x in ("host", "domain")])
    joined = placed.unionByName(unplaced).join(F.broadcast(declared), "declared", "left").join(F.broadcast(suffix), "suffix", "left")
    host_prior = smoothed(F.col("host_mass"), smoothed(F.col("domain_mass"), const(prior)))
    zero = const(np.zeros(n))
    post = joined.withColumn("prior", F.transform(host_prior, lambda v: F.log(v))).withColumn("post", _softmax(_plus(F.col("ll"), F.col("prior"), F.coalesce("declared_log", zero), F.coalesce("suffix_log", zero))))
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    return post.select("page_id", best(F.col("post")).alias("lang"), F.array_max("post").alias("confidence"), best(F.col("p")).alias("text_lang"), "declared", "suffix", "host")
