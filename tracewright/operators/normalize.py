"""Nested records become flat tables.

Known shapes are read with from_json and struct access. Values of unknown depth
({type, value} trees) are flattened in pre-order by one Arrow UDF, on the few rows that
have a control hint; everything else on top of that is higher-order functions.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import CONTROL_HINTS, blank_to_null, has_control_hint

#: Where the fields of a dissection stand, and what they are called.
DISSECTION = {
    "frame_number": "frame.number",
    "frame_mms_size": "frame.size",
    "src_mac": "ethernet.source_mac",
    "dst_mac": "ethernet.destination_mac",
    "prp_sequence": "prp.sequence",
    "prp_lan_id": "prp.lan_id",
    "prp_lsdu_size": "prp.lsdu_size",
    "ipv4_ttl": "ipv4.ttl",
    "tcp_seq": "tcp.seq",
    "tcp_ack": "tcp.ack",
    "tcp_flags": "tcp.flags",
    "tcp_window": "tcp.window",
    "mms_payload_size": "mms_pdu_details.total_payload_size",
    "mms_first_tag": "mms_pdu_details.first_tag",
}
PARAMETERS = {
    "origin_identifier": "originIdentifier",
    "origin_category": "originCategory",
    "ctl_num": "ctlNum",
    "ctl_timestamp": "timestamp",
    "ctl_test": "test",
    "ctl_check": "check",
}
LABELS = (
    "final_tag",
    "seed_is_attack",
    "supervised_is_anomaly",
    "scenario_id",
    "scenario_role",
    "scenario_seed_count",
    "scenario_member_count",
    "scenario_group_key",
    "scenario_window_start_line",
    "scenario_window_end_line",
    "scenario_core_start_line",
    "scenario_core_end_line",
    "scenario_start_timestamp",
    "scenario_end_timestamp",
    "scenario_duration_seconds",
)
_BLANK_IS_MISSING = ("src_mac", "dst_mac", "tcp_flags", "mms_first_tag")


def safe_json(raw: Column) -> Column:
    """Valid JSON text, with single quotes read as double ones where that helps; else null."""
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    own = blank_to_null(F.trim(raw))
    return F.coalesce(valid(own), valid(F.translate(own, "'", '"')))


def canonical_timestamp(*sources: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in sources])


def pass_through(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Scalars as they are, blanks as null."""
    return [blank_to_null(F.col(c).cast("string")).alias(c) for c in columns if c in df.columns]


def text_schema(paths: Iterable[str]) -> T.StructType:
    """The nested structure in which every path ends in a text."""
    children: dict[str, list[str]] = {}
    for path in paths:
        name, _, rest = path.partition(".")
        children.setdefault(name, []).extend([rest] if rest else [])
    return T.StructType([T.StructField(n, text_schema(below) if below else T.StringType()) for n, below in children.items()])


DISSECTION_SCHEMA = text_schema(DISSECTION.values())
PARAMETER_SCHEMA = text_schema(f"{p}.value" for p in PARAMETERS.values())


def dissection_fields(parsed: Column) -> dict[str, Column]:
    """Fourteen fields of a dissection (of DISSECTION_SCHEMA); the two beside prp.sequence only where that is given."""
    found = {}
    for name, path in DISSECTION.items():
        value = parsed
        for step in path.split("."):
            value = value[step]
        found[name] = blank_to_null(value) if name in _BLANK_IS_MISSING else value
    for name in ("prp_lan_id", "prp_lsdu_size"):
        found[name] = F.when(found["prp_sequence"].isNotNull(), found[name])
    return found


def parameter_fields(parsed: Column) -> dict[str, Column]:
    """Values of typed control parameters, {name: {type, value}} (of PARAMETER_SCHEMA)."""
    return {name: parsed[path]["value"] for name, path in PARAMETERS.items()}


def control_value_fields(raw: Column) -> dict[str, Column]:
    return {"ctl_val_type": F.get_json_object(raw, "$.type"), "ctl_val": F.get_json_object(raw, "$.value")}


def unless_same(a: Column, b: Column) -> Column:
    """a, unless it is the same JSON value as b (compared parsed)."""
    parsed = lambda c: F.to_json(F.try_parse_json(c))
    return F.when(~parsed(a).eqNullSafe(parsed(b)), a)


def merge_labels(records: DataFrame, labels: DataFrame, columns: Sequence[str] = LABELS) -> DataFrame:
    """Left join of label columns by line; of repeated lines the last (by pos) counts."""
    own = [c for c in columns if c in labels.columns]
    last = labels.where("line IS NOT NULL").groupBy("line").agg(F.max_by(F.struct(*own), "pos").alias("l"))
    kept = records.drop(*[c for c in own if c in records.columns])
    return kept.join(last, "line", "left").select(*kept.columns, *[F.col(f"l.{c}").alias(c) for c in own])


def array_text(c: Column) -> Column:
    """An array as compact JSON text."""
    return F.to_json(c)


def normalize(events: DataFrame, scalars: Sequence[str], structured: Sequence[str] = ("variables", "data", "access_result"), drop: Sequence[str] = ()) -> DataFrame:
    """The flat record of each raw event (line and the raw text columns)."""
    has = lambda c: F.col(c) if c in events.columns else F.lit(None).cast("string")
    json_of = {c: safe_json(has(c)) for c in ("dissection", "control_parameters", "control_value", "control_variables", *structured)}
    ready = events.withColumns({f"_{c}": v for c, v in json_of.items()})
    # columns of their own, so that each text is parsed once for all its fields
    ready = ready.withColumns({"_d": F.from_json("_dissection", DISSECTION_SCHEMA), "_p": F.from_json("_control_parameters", PARAMETER_SCHEMA)})
    fields = {**dissection_fields(F.col("_d")), **parameter_fields(F.col("_p")), **control_value_fields(F.col("_control_value"))}
    columns = [F.col("line"), canonical_timestamp(has("wtimestamp"), has("timestamp")).alias("event_time"), *pass_through(events, scalars)]
    columns += [F.col(f"_{c}").alias(c) for c in structured]
    columns += [v.alias(k) for k, v in fields.items()]
    columns.append(unless_same(F.col("_control_variables"), F.col("_variables")).alias("control_variables"))
    return ready.select(*columns).drop(*drop)


# -- trees of unknown depth --------------------------------------------------------------

WALK = T.ArrayType(
    T.StructType(
        [
            T.StructField("item", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("type", T.StringType()),
            T.StructField("sval", T.StringType()), T.StructField("ival", T.LongType()), T.StructField("bval", T.BooleanType()),
        ]
    )
)


class Walked:
    """Nodes of some trees, column by column."""

    def __init__(self):
        self.item, self.depth, self.type, self.sval, self.ival, self.bval = [], [], [], [], [], []

    def add(self, item: int, depth: int, kind: str, value) -> None:
        flag, text = isinstance(value, bool), isinstance(value, str)
        whole = isinstance(value, int) and not flag and -(1 << 63) <= value < 1 << 63
        self.item.append(item)
        self.depth.append(depth)
        self.type.append(kind)
        self.sval.append(value if text else None)
        self.ival.append(value if whole else None)
        self.bval.append(value if flag else None)

    def walk(self, value, item: int, depth: int) -> None:
        if isinstance(value, dict):
            kind = value.get("type")
            if isinstance(kind, str):
                self.add(item, depth, kind, value.get("value"))
            for x in value.values():
                self.walk(x, item, depth + 1)
        elif isinstance(value, list):
            for i, x in enumerate(value):
                self.walk(x, i if depth == 0 else item, depth + 1)
        elif isinstance(value, str):
            self.add(item, depth, "", value)

    def array(self, ends: list[int]) -> pa.Array:
        kinds = {"item": pa.int32(), "depth": pa.int32(), "type": pa.string(), "sval": pa.string(), "ival": pa.int64(), "bval": pa.bool_()}
        nodes = pa.StructArray.from_arrays([pa.array(getattr(self, n), k) for n, k in kinds.items()], names=list(kinds))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nodes)


@F.arrow_udf(WALK)
def walk_tree(raw: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Typed values, and plain strings with type "", in pre-order; item is the top-level place."""
    for part in raw:
        found, ends = Walked(), [0]
        for text in part.to_pylist():
            try:
                found.walk(json.loads(text), -1, 0) if text else None
            except ValueError:
                pass
            ends.append(len(found.item))
        yield found.array(ends)


def of_type(walked: Column, kind: str, field: str) -> Column:
    """Values of a type, in order."""
    return F.transform(F.filter(walked, lambda x: (x["type"] == kind) & x[field].isNotNull()), lambda x: x[field])


def with_hint(c: Column) -> Column:
    found = F.lit(False)
    for token in CONTROL_HINTS:
        found = found | c.contains(token)
    return found


def control_refs(variables: Column, access: Column) -> Column:
    """Sorted distinct strings with a control hint: anywhere in variables, and top-level visible strings of the result."""
    plain = F.transform(F.filter(variables, lambda x: (x["type"] == "") & with_hint(x["sval"])), lambda x: x["sval"])
    top = F.transform(F.filter(access, lambda x: (x["type"] == "visible-string") & (x["depth"] == 1) & x["sval"].isNotNull() & with_hint(x["sval"])), lambda x: x["sval"])
    return F.array_sort(F.array_distinct(F.concat(plain, top)))


def report_entries(access: Column) -> Column:
    """(origin, ctl) of each structure: every octet string in it with its first unsigned, each pair once."""
    items = F.array_distinct(F.transform(F.filter(access, lambda x: (x["type"] == "structure") & (x["depth"] == 1)), lambda x: x["item"]))

    def of_item(i: Column) -> Column:
        inside = F.filter(access, lambda x: x["item"] == i)
        ctl = F.get(of_type(inside, "unsigned", "ival"), F.lit(0))
        return F.transform(F.array_sort(F.array_distinct(of_type(inside, "octet-string", "sval"))), lambda o: F.struct(o.alias("origin"), ctl.alias("ctl")))

    return F.array_distinct(F.flatten(F.transform(items, of_item)))


def report_sequence(access: Column) -> dict[str, Column]:
    """Name (of a control block, else the first visible string) and sequence number of a report."""
    top = F.filter(access, lambda x: x["depth"] == 1)
    visible = of_type(top, "visible-string", "sval")
    block = F.filter(visible, lambda v: v.contains("$RP$") | F.lower(v).contains("urcb") | F.lower(v).contains("brcb"))
    return {"report_name": F.coalesce(F.get(block, F.lit(0)), F.get(F.filter(visible, lambda v: v != ""), F.lit(0)), F.lit("")), "report_seq": F.get(of_type(top, "unsigned", "ival"), F.lit(0))}


def payload_values(events: DataFrame) -> DataFrame:
    """line and what the control payloads of its row say: report, refs, identities, flags, entries, report name and number.

    Rows in a control context (is_control, or a hint in variables or access_result) have refs,
    identities, flags and entries; identities also come from control_parameters. Reports
    outside of one have a name and a number only. A report without a name of its own has that
    of its variable list. is_control, control_parameters and variable_list_name may be missing.
    No other rows reach the UDF.
    """
    given = lambda c, kind: F.col(c).cast(kind) if c in events.columns else F.lit(None).cast(kind)
    within = F.coalesce(given("is_control", "int") == 1, F.lit(False)) | has_control_hint(F.col("variables")) | has_control_hint(F.col("access_result"))
    rows = events.withColumn("_within", F.coalesce(within, F.lit(False))).where(F.col("report") | F.col("_within"))
    tree = lambda c, opening: walk_tree(F.when(F.ltrim(c).startswith(opening), c))
    walked = rows.select(
        "line", "report", "_within", given("variable_list_name", "string").alias("listed"), tree(safe_json(F.col("variables")), "[").alias("v"),
        tree(safe_json(F.col("access_result")), "[").alias("a"), tree(safe_json(given("control_parameters", "string")), "{").alias("p"),
    )
    a = F.col("a")
    octets = F.concat(of_type(a, "octet-string", "sval"), of_type(F.col("p"), "octet-string", "sval"))
    control = {
        "refs": control_refs(F.col("v"), a),
        "identities": F.array_sort(F.array_distinct(octets)),
        "flags": F.transform(of_type(a, "boolean", "bval"), lambda x: x.cast("string")),
        "entries": report_entries(a),
    }
    gated = [F.when(F.col("_within"), c).otherwise(F.slice(c, 1, 0)).alias(n) for n, c in control.items()]
    said = report_sequence(a)
    name = F.coalesce(F.nullif(said["report_name"], F.lit("")), F.trim("listed"), F.lit(""))
    return walked.select("line", "report", *gated, name.alias("report_name"), said["report_seq"].alias("report_seq"))
