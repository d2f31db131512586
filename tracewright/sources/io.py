"""Reading and writing event logs and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import BLOCK, running_by_key

#: Columns of a raw capture, all read as text; nested ones hold JSON.
RAW_COLUMNS = (
    "wtimestamp", "timestamp", "direction", "service", "pdu_type", "src_ip", "dst_ip", "stream_id", "session_id",
    "src_port", "dst_port", "frame_len", "invoke_id", "is_control", "control_op_count", "new_connection",
    "control_object", "control_action", "control_field", "variable_list_name", "summary",
    "control_parameters", "control_value", "variables", "control_variables", "data", "access_result", "dissection", "raw_mms_hex",
)
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])


CSV = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """file, place, number (from 1 in its file) and record: the records of CSV files, however many
    lines their quoted fields span, also where a file is read by many tasks.

    Lines are read as text, which splits a file anywhere. A line begins a record if the number of
    quotes before it in its file is even. That number is a running sum within a block of a split's lines,
    and over the blocks' totals; only the lines of records that span several are brought together.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.rtrim(F.col("value"), F.lit("\r")).alias("record"), F.col("value")
    )
    # a split holds any number of lines, so its lines are dealt into blocks, too
    block = F.struct("split", F.floor(F.col("at") / BLOCK).alias("part"))
    quotes = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("long")
    counted = running_by_key(lines.withColumn("quotes", quotes), ["file"], {"before": ("sum", F.col("quotes"))}, ["at"], inclusive=False, block=block)
    begins = F.col("before") % 2 == 0
    alone = begins & (F.col("quotes") % 2 == 0)
    counted = counted.withColumns({"begins": begins, "alone": alone}).where(~(F.col("alone") & (F.trim("record") == "")))
    wanted = {"number": ("sum", F.col("begins").cast("long")), "place": ("last", F.when(F.col("begins"), F.struct("split", "at")))}
    placed = running_by_key(counted, ["file"], wanted, ["at"], block=block)
    parts = placed.where(~F.col("alone")).groupBy("file", "place").agg(F.max("number").alias("number"), F.array_sort(F.collect_list(F.struct("split", "at", "value"))).alias("parts"))
    joined = F.rtrim(F.array_join(F.transform("parts", lambda x: x["value"]), "\n"), F.lit("\r"))
    return placed.where("alone").select("file", "place", "number", "record").unionByName(parts.select("file", "place", "number", joined.alias("record")))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSVs with a header and fields of any length, quotes and line breaks within; ``columns``
    reads just those. Columns are found by their names in the header, which the files share.

    A file of any size is read by many tasks (``csv_records``).
    """
    declared = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    kinds = {f.name: f.dataType for f in declared}
    header = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in column_names(spark, path)])
    found = csv_records(spark, path).where("number > 1").select(F.from_csv("record", _ddl(header), CSV).alias("r"))
    value = lambda f: F.col("r").getField(f.name) if f.name in header.fieldNames() else F.lit(None)
    wanted = [f for f in declared if columns is None or f.name in columns]
    out = found.select(*[value(f).cast(f.dataType).alias(f.name) for f in wanted])
    return out.select(*columns) if columns else out


def _ddl(schema: T.StructType) -> str:
    return ", ".join("`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString()) for f in schema)


def column_names(spark: SparkSession, path: str) -> list[str]:
    """The header of a CSV; nothing but its first line is parsed."""
    return spark.read.options(header=True, quote='"', escape='"').csv(path).columns


def write_csv(df: DataFrame, path: str, compressed: bool = False) -> None:
    """Arrays become text joined by ";"; all declared columns are written, also if the first row lacks them."""
    flat = [F.array_join(c, ";").alias(c) if k.startswith("array<") else F.to_json(c).alias(c) if k.startswith(("struct", "map")) else F.col(c) for c, k in df.dtypes]
    df.select(*flat).write.options(header=True, quote='"', escape='"', compression="gzip" if compressed else "none").csv(path)


def write_json_lines(df: DataFrame, path: str, compressed: bool = False) -> None:
    """One object a line, without its null fields."""
    df.write.options(compression="gzip" if compressed else "none", ignoreNullFields=True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def with_line_numbers(df: DataFrame, out: str = "line") -> DataFrame:
    """Number rows from 1 in the order in which they are read.

    Partitions are numbered by themselves; their first numbers come from a count of rows per
    partition, a table with one row each. The input must read the same way twice, as files do.
    """
    spot = F.monotonically_increasing_id()
    rows = df.withColumn("_at", spot)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    rows = rows.withColumn("_part", part).withColumn("_place", place)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    return rows.join(F.broadcast(first), "_part").withColumn(out, F.col("_first") + F.col("_place") + 1).drop("_at", "_part", "_place", "_first")


def first_lines(df: DataFrame, most: int, line: str = "line") -> DataFrame:
    """The first rows by number, not any: all of them if ``most`` is 0."""
    return df.where(F.col(line) <= most) if most else df


def write_model(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str, names: Sequence[str] = ("meta", "service_prob", "channel_stats", "origin_ctl")) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
