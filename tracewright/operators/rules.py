"""Deterministic detectors over the reasons and features of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import split_list
from .evaluation import confusion, rates

#: Reasons that prove a violation, and those that only hint at one.
HARD = (
    "report_without_matching_write",
    "report_ctlnum_regression",
    "report_ctlnum_below_write_baseline",
    "unexpected_octet_identity_in_control_context",
    "report_origin_not_seen_in_writes",
)
MODERATE = ("last_appl_error",)


def reason_flags(rows: DataFrame, reasons: str = "protocol_reasons") -> DataFrame:
    """A flag for each known reason, hard, moderate only, their number and sorted list."""
    active = F.when(F.trim(F.col(reasons)) != "[]", split_list(F.col(reasons))).otherwise(F.array().cast("array<string>"))
    found = rows.withColumn("_a", F.coalesce(active, F.array().cast("array<string>")))
    has = lambda names: F.arrays_overlap("_a", F.array(*[F.lit(n) for n in names]))
    flags = {f"is_{n}": F.array_contains("_a", n).cast("int") for n in (*HARD, *MODERATE)}
    more = {
        "hard": has(HARD).cast("int"),
        "moderate_only": (has(MODERATE) & ~has(HARD)).cast("int"),
        "violations": F.size("_a"),
        "violation_list": F.array_join(F.array_sort("_a"), ";"),
    }
    return found.withColumns({**flags, **more}).drop("_a")


def escalate(rows: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Add escalated: some row of the same scenario is a hard violation. Rows without a
    scenario are not. The flag informs; predictions don't use it."""
    hit = rows.where((F.col("hard") == 1) & F.col(scenario).isNotNull()).select(scenario).distinct().withColumn("escalated", F.lit(1))
    return rows.join(hit, scenario, "left").withColumn("escalated", F.coalesce("escalated", F.lit(0)))


def predict(rows: DataFrame, moderate: bool = True) -> DataFrame:
    """predicted and confidence (3 hard, 1 moderate only, 0 neither), row by row."""
    soft = (F.col("moderate_only") == 1) if moderate else F.lit(False)
    hard = F.col("hard") == 1
    return rows.withColumn("predicted", (hard | soft).cast("int")).withColumn("confidence", F.when(hard, 3).when(soft, 1).otherwise(0))


def level_metrics(rows: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Rates over rows, over scenarios (any row counts) and over seed rows, as three rows."""
    hit = F.col("predicted") == 1
    by_scenario = rows.where(F.col(scenario).isNotNull()).groupBy(scenario).agg(F.max("label").alias("label"), F.max("predicted").alias("predicted"))
    parts = {"row": rows, "scenario": by_scenario, "seed": rows.where("role = 'core' OR label = 0")}
    found = [rates(confusion(df, hit)).withColumn("level", F.lit(name)) for name, df in parts.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def strict_score(rows: DataFrame, protocol_from: float = 45.0, score_from: float = 1.0, sequence: bool = False, sequence_needs_protocol: bool = False) -> DataFrame:
    """One point each for origin, counter and protocol, a quarter for sequences if wanted."""
    on = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    falls = lambda c: F.coalesce(F.col(c), F.lit(0)) < 0
    flag = lambda c: c.cast("int")
    origin = on("origin_new_src") | on("src_new_origin")
    ctl = on("has_ctl") & (on("ctl_regression") | on("ctl_reused") | falls("ctl_delta_actor_object"))
    raw = on("has_seq") & (on("seq_regression") | on("seq_reused") | falls("seq_delta"))
    high = F.coalesce(F.col("protocol_score"), F.lit(0.0)) >= protocol_from
    counts: Column = (raw & high if sequence_needs_protocol else raw) if sequence else F.lit(False)
    score = flag(origin) + flag(ctl) + flag(high) + 0.25 * flag(counts)
    return rows.withColumns(
        {"strict_origin": flag(origin), "strict_ctl": flag(ctl), "strict_sequence_raw": flag(raw), "strict_sequence": flag(counts), "strict_protocol": flag(high), "strict_score": score}
    ).withColumn("strict_predicted", flag(F.col("strict_score") >= score_from))


def summary(branches: dict[str, DataFrame]) -> DataFrame:
    """One row per detector (each a table of one row of rates), best F1 first."""
    rows = [df.select(F.lit(name).alias("branch"), "precision", "recall", "f1") for name, df in branches.items()]
    found = rows[0]
    for r in rows[1:]:
        found = found.unionByName(r)
    return found.orderBy(F.desc_nulls_last("f1"), "branch")


