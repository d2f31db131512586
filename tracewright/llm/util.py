"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, discard_tables, materialize, shared_dir, shared_path, ship

__all__ = ["SPACE", "discard", "discard_tables", "held_out", "let", "materialize", "shared_dir", "shared_path", "small_batches", "unused", "words"]

#: ASCII white space, which separates words everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Make ready for Python on the executors: this package is sent there, and Arrow batches
    are bounded by rows, as one document can be of any length."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, also within lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text: maximal runs without ASCII white space; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the fold no label is learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0
