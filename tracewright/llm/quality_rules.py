"""Quality rules as a bitmask ledger.

Every rule is evaluated once over a document's measurements and leaves one bit; the
ledger keeps bits and measurements. Policies are versioned sets of bits, so a policy can
be applied, changed or taken apart rule by rule without touching a text again.

Defined results: a null text counts as empty (no words, base rule ``few_words`` fails); a
null id passes through; repeated rows each give a row; an empty table gives an empty
ledger; other columns of the input are ignored, whatever their names. Very long texts are
measured whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import let, words

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """One rule: its bit and the condition under which a document fails it."""

    bit: int
    name: str
    fails: Callable[[Callable[[str], Column]], Column]

    @property
    def mask(self) -> int:
        return 1 << self.bit


#: Bits are never reused: a retired rule keeps its number.
RULES: tuple[Rule, ...] = (
    Rule(0, "few_words", lambda m: m("n_words") < 20),
    Rule(1, "repeated_windows", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
    Rule(2, "symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule(3, "short_words", lambda m: 2 * m("word_chars") < 5 * m("n_words")),
    Rule(4, "long_words", lambda m: m("word_chars") > 15 * m("n_words")),
    Rule(5, "duplicate_lines", lambda m: 10 * m("n_dup_lines") > 3 * m("n_lines")),
    Rule(6, "capitals", lambda m: 2 * m("n_upper") > m("n_letters")),
    Rule(7, "few_letters", lambda m: 2 * m("n_letters") < m("word_chars")),
    Rule(8, "exclamations", lambda m: 10 * m("n_exclaim") > m("n_words")),
)


@dataclass(frozen=True)
class Policy:
    """A named version: documents failing more than ``allowed`` of its rules are rejected."""

    version: str
    rules: tuple[str, ...]
    allowed: int = 0

    def mask(self, rules: Sequence[Rule] = RULES) -> int:
        return sum(r.mask for r in rules if r.name in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
V1 = Policy("v1", BASE.rules + ("symbols", "short_words", "long_words", "capitals", "few_letters", "exclamations"))
V2 = Policy("v2", V1.rules + ("duplicate_lines",))


def _count(text: Column, keep: str) -> Column:
    """Characters of a text in the class ``keep``."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")


def _same_as_neighbour(rows: Column, field: str) -> Callable[[Column, Column], Column]:
    def same(x: Column, i: Column) -> Column:
        before, after = F.get(rows, i - 1)[field], F.get(rows, i + 1)[field]
        return F.coalesce(before == x[field], F.lit(False)) | F.coalesce(after == x[field], F.lit(False))

    return same


def _repeated(w: Column, hashes: Column) -> Column:
    """Words within windows that occur twice. Windows are grouped by hash first; only those
    whose hash recurs are spelled out and compared as strings, so the count is exact."""

    def spelled(by_hash: Column) -> Column:
        recurring = F.filter(by_hash, _same_as_neighbour(by_hash, "h"))
        return F.array_sort(
            F.transform(recurring, lambda p: F.struct(F.array_join(F.slice(w, p["at"] + 1, WINDOW), " ").alias("t"), p["at"].alias("at")))
        )

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(x - F.get(at, i - 1), F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return let(
        by_hash,
        lambda s: let(
            spelled(s),
            lambda t: let(F.array_sort(F.transform(F.filter(t, _same_as_neighbour(t, "t")), lambda p: p["at"])), covered),
        ),
    )


def repeat_words(w: Column) -> Column:
    """Words lying in any 8-word window found twice or more in the text."""

    def over(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_repeated(w, h)),
        )

    return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(let(w, over))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """Measurements of each document, all in one projection over the text.

    The first column is doc_id, or, if ``whole``, ``doc``: all of the row as a struct, so that
    no column of the input can clash with a measurement.
    """
    first = F.struct("*").alias("doc") if whole else F.col(id_col).alias("doc_id")
    rows = docs.select(first, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("w", words(F.col("t"))).withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    w, lines, t = F.col("w"), F.col("lines"), F.col("t")
    return rows.select(
        rows.columns[0],
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _count(t, r"#*$%&|<>").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words"),
        _count(t, r"\p{L}").alias("n_letters"),
        _count(t, r"\p{Lu}").alias("n_upper"),
        _count(t, r"!").alias("n_exclaim"),
    )


def ledger(measured: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``fail_bits``: bit r.bit is set where the document fails rule r."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(r.fails(F.col), F.lit(r.mask).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("fail_bits", bits)


def apply_policy(book: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES, out: str = "kept") -> DataFrame:
    """Add the policy's verdict, true for documents that stay."""
    failed = F.bit_count(F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long")))
    return book.withColumn(out, failed <= policy.allowed)


def ablation(book: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """What each rule of a policy does: documents failing it, documents only it rejects,
    and documents kept if it were left out.

    Documents are counted by bit pattern first, so that everything after works on at most
    2^rules rows, however many documents there are.
    """
    mask = F.lit(policy.mask(rules)).cast("long")
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    own = [r for r in rules if r.name in policy.rules]
    each = patterns.select("bits", "n", F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.mask).cast("long").alias("m")) for r in own])).alias("r"))
    failed, rest = F.col("bits").bitwiseAND(F.col("r.m")) != 0, F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.m")))) <= policy.allowed
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy(F.lit(policy.version).alias("policy"), F.col("r.rule").alias("rule")).agg(
        count(failed).alias("n_failed"), count(failed & rest & (F.bit_count("bits") > policy.allowed)).alias("n_only"), count(rest).alias("n_kept_without")
    )


def assess(docs: DataFrame, policy: Policy = V1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements, failure bits, the base verdict and the policy's."""
    book = apply_policy(apply_policy(ledger(measure(docs, id_col, text_col)), BASE, out="base_ok"), policy, out="policy_ok")
    return book.select("*", (~F.col("base_ok")).alias("base_failed"), (F.col("base_ok") & F.col("policy_ok")).alias("kept"))


def accepted(docs: DataFrame, policy: Policy = V1, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass the base rules and the policy, with their own columns."""
    book = ledger(measure(docs, text_col=text_col, whole=True))
    both = apply_policy(apply_policy(book, BASE, out="base_ok"), policy, out="policy_ok")
    return both.where("base_ok AND policy_ok").select("doc.*")
