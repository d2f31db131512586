"""Fixed-length windows over the rows of each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ordering

#: Label columns by preference, after the one that is asked for.
LABEL_COLUMNS = ("supervised_is_anomaly", "is_anomaly")


def label_column(df: DataFrame, wanted: str | None = None) -> str:
    """The asked-for label column if the table has it, else the first usual one it has."""
    for name in ([wanted] if wanted else []) + list(LABEL_COLUMNS):
        if name in df.columns:
            return name
    raise ValueError(f"no label column among {df.columns}")


def windows(rows: DataFrame, features: Sequence[str], size: int = 8, step: int = 1, least: int = 0, label: str = "label", mode: str = "end", keep: Sequence[str] = ()) -> DataFrame:
    """The last ``size`` rows up to each row of a group, every ``step`` rows.

    rows: grp, us, line, label and the features. A group needs max(size, least) rows. The
    label is the last row's, or with mode "any" the largest (then a window with a missing
    label is dropped). Steps stay an array of structs, oldest first; ``flatten`` widens it.
    A group's rows are dealt into blocks by their places, and each block hands its last rows, as
    many as a window needs of them, to the next one, so a group of any size is spread over tasks.
    """
    block = max(ordering.BLOCK, size)
    placed = ordering.group_places(rows, "end_index").withColumns({"_block": F.floor(F.col("end_index") / block), "_own": F.lit(True)})
    if least > size:
        groups = rows.groupBy(F.col("grp").alias("_grp")).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= least)
        placed = placed.join(groups, F.col("grp").eqNullSafe(F.col("_grp")), "left_semi")
    ahead = placed.where(F.col("end_index") % block > block - size).withColumns({"_block": F.col("_block") + 1, "_own": F.lit(False)})
    frame = Window.partitionBy("grp", "_block").orderBy("end_index").rowsBetween(-(size - 1), 0)
    framed = (
        placed.unionByName(ahead).withColumn("steps", F.collect_list(F.struct(*features)).over(frame))
        .withColumn("start_line", F.first("line").over(frame))
        .withColumn("positives", F.coalesce(F.sum(label).over(frame), F.lit(0)))
        .withColumn("missing", F.sum(F.col(label).isNull().cast("int")).over(frame))
        .withColumn("any_label", F.max(label).over(frame))
    )
    full = framed.where(F.col("_own") & (F.col("end_index") >= size - 1) & ((F.col("end_index") - (size - 1)) % step == 0))
    full = full.where("missing = 0") if mode == "any" else full.where(F.col(label).isNotNull())
    return full.select(
        "grp", (F.col("end_index") - (size - 1)).alias("start_index"), "end_index", "start_line", F.col("line").alias("end_line"), F.col("us").alias("end_us"),
        "positives", (F.col("any_label") if mode == "any" else F.col(label)).alias(label), *keep, "steps",
    )


def flatten(found: DataFrame, features: Sequence[str], size: int = 8) -> DataFrame:
    """One column for each feature and step: <feature>_t_minus_k ... <feature>_t0."""
    rest = [c for c in found.columns if c != "steps"]
    name = lambda f, k: f"{f}_t_minus_{k}" if k else f"{f}_t0"
    return found.select(*rest, *[F.col("steps")[size - 1 - k][f].alias(name(f, k)) for k in range(size - 1, -1, -1) for f in features])


def tensor_scale(found: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, mean, std over all rows and steps; a spread below 1e-6 counts as 1."""
    each = found.select(F.explode("steps").alias("s")).select(*[F.col(f"s.{f}").cast("double").alias(f) for f in features])
    stats = each.agg(*[x for f in features for x in (F.avg(f).alias(f"{f}__mean"), F.stddev_pop(f).alias(f"{f}__std"))])
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f"{f}__mean").alias("mean"), F.when(F.col(f"{f}__std") < 1e-6, 1.0).otherwise(F.col(f"{f}__std")).alias("std")) for f in features]
    return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def scaled(found: DataFrame, features: Sequence[str], scale: DataFrame) -> DataFrame:
    """Steps standardized by ``tensor_scale`` of the training part; one row of constants is broadcast."""
    wide = scale.groupBy().pivot("feature", list(features)).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
    joined = found.crossJoin(F.broadcast(wide))
    fields = lambda x: F.struct(*[((x[f].cast("double") - F.col(f"{f}_mean")) / F.col(f"{f}_std")).alias(f) for f in features])
    return joined.withColumn("steps", F.transform("steps", fields)).select(*found.columns)
