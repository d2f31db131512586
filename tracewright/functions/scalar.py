"""Scalar functions on columns of an event log, all within whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens that tell a control payload.
CONTROL_HINTS = ("$ST$Pos", "$CO$Pos", "$ST$EnaCls", "CSWI", "CILO")
POSITIVE_WORDS = ("1", "true", "yes", "attack", "anomaly", "malicious", "masquerade", "failed-control", "likely-attack")
NEGATIVE_WORDS = ("0", "false", "no", "normal", "benign")


def text(c: Column) -> Column:
    """Trimmed text, "" for null."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_text(*sources: Column) -> Column:
    """The first source that isn't blank, trimmed; "" if all are."""
    return F.coalesce(*[blank_to_null(text(c)) for c in sources], F.lit(""))


def parse_int(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("bigint")


def parse_number(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def parse_timestamp(c: Column) -> Column:
    """ISO time or null."""
    return c.cast("string").try_cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone is."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", zero, ts.cast("timestamp_ntz"))


def channel_key(src: Column, dst: Column, direction: Column, service: Column) -> Column:
    return F.concat_ws("|", text(src), text(dst), text(direction), text(service))


def payload_bytes(hex_text: Column) -> Column:
    """Bytes of a hex string for detection: null if empty or of odd length."""
    n = F.length(text(hex_text))
    return F.when((n > 0) & (n % 2 == 0), F.floor(n / 2).cast("long"))


def payload_bytes_or_zero(hex_text: Column) -> Column:
    """Bytes of a hex string for features: odd lengths are floored, missing is 0."""
    return F.floor(F.length(text(hex_text)) / 2).cast("long")


def has_control_hint(raw: Column) -> Column:
    found = F.lit(False)
    for token in CONTROL_HINTS:
        found = found | F.coalesce(raw, F.lit("")).contains(token)
    return found


def distinct_sorted(items: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != ""))))


def split_list(c: Column, by: str = ";") -> Column:
    """Trimmed distinct parts of a list kept as text, in order."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), by), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def fingerprint(tag: Column, src: Column, dst: Column, service: Column, reasons: Column, *more: Column) -> Column:
    """What repeats of an alert have in common; of the reasons the first three in order."""
    first = F.array_join(F.slice(distinct_sorted(reasons), 1, 3), ";")
    return F.concat_ws("|", tag, src, dst, service, first, *[F.coalesce(c.cast("string"), F.lit("")) for c in more])


def calendar(df: DataFrame, us: str = "us") -> DataFrame:
    """Hour, weekday (Monday 0), quarter of an hour and off-hours of microseconds.

    A time that is null has hour and weekday -1, and counts as off hours.
    """
    sec = F.floor(F.col(us) / 1_000_000)
    day = F.floor(sec / 86400)
    hour = F.coalesce(F.floor(F.pmod(sec, F.lit(86400)) / 3600), F.lit(-1)).cast("int")
    return (
        df.withColumn("hour_of_day", hour)
        .withColumn("day_of_week", F.coalesce(F.pmod(day + 3, F.lit(7)), F.lit(-1)).cast("int"))
        .withColumn("bucket_15m", (F.floor(sec / 900) * 900).cast("long"))
        .withColumn("is_off_hours", ((F.col("hour_of_day") < 6) | (F.col("hour_of_day") >= 20)).cast("int"))
    )


def actor(src: Column, origin: Column) -> Column:
    return F.concat_ws("|", src, F.when(origin != "", origin).otherwise("<NO_ORIGIN>"))


def joint_key(*parts: Column) -> Column:
    """Parts joined by "|"; "" if any part is blank."""
    whole = F.lit(True)
    for p in parts:
        whole = whole & (F.coalesce(p, F.lit("")) != "")
    return F.when(whole, F.concat_ws("|", *parts)).otherwise("")


def group_key(columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *[text(F.col(c)) for c in columns]) if columns else F.lit("all")


def guarded_ratio(a: Column, b: Column) -> Column:
    return a / (b + 1)


def finite(c: Column, limit: float | None = None) -> Column:
    """Zero for null, NaN, infinities and, if a limit is given, larger magnitudes."""
    odd = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    if limit is not None:
        odd = odd | (F.abs(c) > limit)
    return F.when(odd, F.lit(0.0)).otherwise(c)


def entity_prefix(c: Column) -> Column:
    """What stands before the first underscore."""
    return F.regexp_extract(c, r"^([^_]+)", 1)


def label_codes(df: DataFrame, column: str, out: str, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS) -> DataFrame:
    """0/1 labels: if any value is a number only 0 and 1 count, else the word sets do."""
    number = parse_number(F.col(column))
    numeric = df.agg(F.coalesce(F.max(number.isNotNull()), F.lit(False)).alias("numeric"))
    word = F.lower(text(F.col(column)))
    by_word = F.when(word.isin(list(positive)), 1.0).when(word.isin(list(negative)), 0.0)
    coded = F.when(F.col("numeric"), F.when(number.isin(0.0, 1.0), number)).otherwise(by_word)
    return df.crossJoin(F.broadcast(numeric)).withColumn(out, coded).drop("numeric")


def json_text(raw: Column, path: str, default: str | None = None) -> Column:
    """A nested value by path as text; default where it or the document is missing."""
    found = F.get_json_object(raw, path)
    return found if default is None else F.coalesce(found, F.lit(default))
