"""What nested payloads say, against plain Python over random records."""

import json
import random

from tracewright.operators import normalize, protocol
from tracewright.session import ship

HINTS = ("$ST$Pos", "$CO$Pos", "$ST$EnaCls", "CSWI", "CILO")


def octets(x):
    if isinstance(x, dict):
        if x.get("type") == "octet-string" and isinstance(x.get("value"), str):
            yield x["value"]
        for v in x.values():
            yield from octets(v)
    elif isinstance(x, list):
        for v in x:
            yield from octets(v)


def test_only_a_control_context_names_identities(spark):
    ship(spark)
    r = random.Random(3)
    leaf = lambda: {"type": r.choice(["octet-string", "visible-string", "unsigned"]), "value": r.choice(["rogue", "own", "x$CO$Pos", 4])}
    rows, want = [], {}
    for line in range(200):
        access = [leaf() for _ in range(r.randint(0, 3))] + [{"type": "structure", "value": [leaf(), leaf()]}] * r.randint(0, 1)
        parameters = {"originIdentifier": leaf(), "ctlNum": {"type": "unsigned", "value": 3}}
        variables = [{"name": r.choice(["plain", "q CSWI1"])}]
        control, report = r.choice([0, 1, None]), r.random() < 0.4
        a, p = r.choice([(access, parameters), (access, [parameters]), ({"value": access}, parameters)])
        raw = json.dumps(variables), json.dumps(a), json.dumps(p)
        rows.append((line, *raw, control, report, "RPT"))
        within = control == 1 or any(h in raw[0] or h in raw[1] for h in HINTS)
        if within or report:
            found = sorted(set(octets([a if isinstance(a, list) else [], p if isinstance(p, dict) else {}]))) if within else []
            want[line] = (found, within)
    raw = spark.createDataFrame(rows, "line long, variables string, access_result string, control_parameters string, is_control int, report boolean, variable_list_name string")
    got = {x["line"]: x for x in normalize.payload_values(raw).collect()}
    assert {k: v["identities"] for k, v in got.items()} == {k: v for k, (v, _) in want.items()}
    assert all(within or not (got[k]["refs"] or got[k]["flags"] or got[k]["entries"]) for k, (_, within) in want.items())
    assert all(x["report_name"] for x in got.values())


def test_the_error_token(spark):
    df = spark.createDataFrame([(1, '[{"name": "LastApplError"}]'), (2, "[]"), (3, None)], "line long, variables string")
    assert [r[0] for r in df.orderBy("line").select(protocol.last_appl_error(df["variables"])).collect()] == [True, False, False]
