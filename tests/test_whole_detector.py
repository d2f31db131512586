"""The whole detector, nested payloads and all, against one plain pass over the rows."""

import json
import math
import random
from collections import Counter, defaultdict, deque

import pytest

from tracewright.operators import baseline, detector, normalize, ordering
from tracewright.session import ship

S = 1_000_000
HINTS = ("$ST$Pos", "$CO$Pos", "$ST$EnaCls", "CSWI", "CILO")
LEVEL = {"normal": 0, "failed-control": 1, "likely-attack": 2}
NAMES = tuple(LEVEL)
SCHEMA = (
    "line long, us long, src string, dst string, direction string, service string, stream string, action string, object string, origin string, ctl long, invoke long, write boolean, report boolean, size double, "
    "is_control int, variable_list_name string, variables string, access_result string, control_parameters string"
)


def generated(seed, n):
    r = random.Random(seed)
    leaf = lambda: r.choice([{"type": "octet-string", "value": r.choice(["g1", "g2", "g3", ""])}, {"type": "visible-string", "value": r.choice(["E1", "a$CO$Pos", "E.brcb01", "E$RP$x"])}, {"type": "unsigned", "value": r.randint(0, 6)}, {"type": "boolean", "value": r.random() < 0.5}])
    t, rows = 0, []
    for line in range(1, n + 1):
        t += r.choice([0, 1, 2, 4, 9, 35, -8, 130 if r.random() < 0.1 else 0]) * S
        service = r.choice(["WRITE", "WRITE", "READ", "UNCONFIRMED", "UNCONFIRMED"])
        control = r.choice([0, 1, 1, None])
        origin, ctl = r.choice(["g1", "g1", "g2", ""]), r.choice([None, 1, 2, 3, 4])
        access = [leaf() for _ in range(r.randint(0, 2))] + [{"type": "structure", "value": [leaf() for _ in range(r.randint(1, 3))]} for _ in range(r.randint(0, 2))]
        access = access if r.random() < 0.6 else []
        variables = [r.choice(["plain", "x CSWI1", {"name": "y$ST$Pos"}, "LastApplError" if r.random() < 0.2 else "z"])]
        parameters = {"originIdentifier": {"type": "octet-string", "value": origin}, "ctlNum": {"type": "unsigned", "value": ctl}}
        report = service == "UNCONFIRMED" and r.random() < 0.8
        rows.append((
            line, None if r.random() < 0.06 else t, r.choice("ab"), "x", "REQUEST", service, "s", r.choice(["SBOw", "Oper", ""]), r.choice(["o1", "o2", ""]), origin, ctl, r.choice([None, *range(1, 9)]),
            service == "WRITE" and control == 1, report, r.choice([None, 10.0, 12.0, 90.0]), control, "RPT" if report else "", json.dumps(variables), json.dumps(access), json.dumps(parameters),
        ))
    if r.random() < 0.5:  # answers come the other way
        rows = [(*x[:2], "x", x[2], *x[4:]) if x[5] == "UNCONFIRMED" else x for x in rows]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return rows, [dict(zip(names, x, strict=True)) for x in rows]


def typed(x, kind, python):
    """Values of a type, a parent's before its children's."""
    if isinstance(x, dict):
        v = x.get("value")
        if x.get("type") == kind and isinstance(v, python) and (python is bool or not isinstance(v, bool)):
            yield v
        for y in x.values():
            yield from typed(y, kind, python)
    elif isinstance(x, list):
        for y in x:
            yield from typed(y, kind, python)


def strings(x):
    return [x] if isinstance(x, str) else [s for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()) for s in strings(y)]


def hinted(s):
    return any(h in s for h in HINTS)


class Plain:
    """The detector's state and one row's step."""

    def __init__(self, model, o):
        self.o, self.end = o, model["meta"].first()["train_end"]
        self.stats = {(r["channel"], r["metric"]): r for r in model["channel_stats"].collect()}
        self.p = {r["combo"]: r["p"] for r in model["service_prob"].collect()}
        self.armed, self.invoke_high, self.ids, self.ctl_high, self.uses, self.objects = {}, {}, defaultdict(dict), {}, Counter(), defaultdict(set)
        self.known, self.counts, self.leader, self.ctls = set(), Counter(), None, defaultdict(set)
        self.recent, self.report_ctl, self.numbers, self.arrived, self.live, self.sent, self.out = defaultdict(deque), {}, {}, {}, defaultdict(deque), {}, {}

    def writes(self, e, detected, hit):
        key, us = (e["src"], e["dst"], e["object"], e["ctl"]), e["us"]
        if e["action"] == "SBOw":
            self.armed[key] = e
        elif e["action"] == "Oper":
            was = self.armed.pop(key, None)
            if was is None:
                hit(2, "oper_without_matching_sbow")
            elif None not in (was["us"], us) and us - was["us"] > self.o.pair_us:
                hit(1, f"late_oper_after_{(us - was['us']) / S:.3f}s")
        ch, invoke, ctl, origin = key[:2], e["invoke"], e["ctl"], e["origin"]
        if invoke is None:
            hit(1, "missing_invoke_id_on_write")
        else:
            if invoke < self.invoke_high.get(ch, invoke):
                hit(1, "write_invoke_id_regression")
            if invoke in self.ids[ch]:
                hit(2, "duplicate_write_invoke_id")
            self.ids[ch].setdefault(invoke)
            if len(self.ids[ch]) > self.o.memory:
                del self.ids[ch][next(iter(self.ids[ch]))]
            self.invoke_high[ch] = max(invoke, self.invoke_high.get(ch, invoke))
        party = (*ch, origin or "UNKNOWN")
        if ctl is not None:
            if ctl < self.ctl_high.get(party, ctl):
                hit(1, "write_ctlnum_regression")
            self.ctl_high[party] = max(ctl, self.ctl_high.get(party, ctl))
            self.uses[party, ctl] += 1
            self.objects[party, ctl] |= {e["object"]} - {""}
            if len(self.objects[party, ctl]) > 1:
                hit(2, "write_ctlnum_reused_across_objects")
            if self.uses[party, ctl] > 2:
                hit(1, "write_ctlnum_reused_excessively")
        if self.leader and origin and origin != self.leader:
            hit(2, "unexpected_origin_identifier")
        if detected and origin:
            self.known.add(origin)
            self.counts[origin] += 1
            if self.leader is None or self.counts[origin] > self.counts[self.leader]:
                self.leader = origin
            if ctl is not None:
                self.ctls[origin].add(ctl)
        if ctl is not None and us is not None:
            recent = self.recent[*ch, origin, ctl]
            recent.append(us)
            while recent[0] < us - 3 * self.o.match_us:
                recent.popleft()

    def number(self, e, name, seq, origin, refs, hit):
        key = e["src"], e["dst"], name, origin or "UNKNOWN", ";".join(refs) or "*"
        top, was = self.numbers.get(key, (None, None))
        fresh = top is None or None not in (was, e["us"]) and e["us"] - was > self.o.reset_us
        if not fresh and top - seq > self.o.tolerance:
            hit(1, "report_seq_regression")
        if not fresh and top == seq:
            hit(1, "report_seq_duplicate")
        self.numbers[key] = (seq if fresh else max(top, seq)), e["us"]

    def entry(self, e, origin, ctl, hit):
        if not origin:
            return
        strange = bool(self.known) and origin not in self.known
        if strange:
            hit(2, "report_origin_not_seen_in_writes")
        if ctl is None:
            return
        key, held = (e["src"], e["dst"], origin), self.ctls[origin]
        if ctl < self.report_ctl.get(key, ctl):
            hit(1, "report_ctlnum_regression")
        self.report_ctl[key] = max(ctl, self.report_ctl.get(key, ctl))
        if held and ctl < min(held):
            hit(1, "report_ctlnum_below_write_baseline")
        elif held and ctl <= max(held) and ctl not in held:
            hit(1, "report_ctlnum_not_seen_in_writes")
        recent = self.recent[e["dst"], e["src"], origin, ctl]
        while e["us"] is not None and recent and recent[0] < e["us"] - 3 * self.o.match_us:
            recent.popleft()
        last = None if e["us"] is None else next((w for w in reversed(recent) if w <= e["us"]), None)
        if last is None or e["us"] - last > self.o.match_us:
            if strange:
                hit(2, "report_without_matching_write")
            elif self.o.strict or ctl not in held:
                hit(1, "report_without_matching_write")

    def statistics(self, e):
        ch, us, found, score = "|".join((e["src"], e["dst"], e["direction"], e["service"])), e["us"], [], 0.0
        gap = None
        if us is not None:
            gap = None if ch not in self.arrived else (us - self.arrived[ch]) / S
            self.arrived[ch] = us
            while self.live[ch] and self.live[ch][0] < us - self.o.window_us:
                self.live[ch].popleft()
            self.live[ch].append(us)
        live = 0 if us is None else len(self.live[ch])
        for metric, value, name, base, slope, cap in (("interarrival", gap, "interarrival_outlier", 5, 4, 25), ("size", e["size"], "payload_size_outlier", 4, 3, 20)):
            m = self.stats.get((ch, metric))
            if m and value is not None and value >= 0 and m["n"] >= 20 and m["std"] > 0 and (z := abs(value - m["mean"]) / m["std"]) >= 3:
                found.append(name)
                score += min(cap, base + slope * (z - 3))
        p = self.p.get(e["direction"] + "|" + e["service"], 0.0)
        if p <= 0.005:
            found.append("rare_service_combo")
            score += min(20, 4 - 3 * math.log(max(p, 1e-9)))
        m = self.stats.get((ch, "rate"))
        if m and m["n"] >= 5 and live:
            if (z := (live - m["mean"]) / max(m["std"], 0.5)) >= 3:
                found.append("rate_spike")
                score += min(25, 5 + 4 * (z - 3))
        elif live >= 25:
            found.append("unknown_channel_rate_spike")
            score += 12
        return found, min(100.0, score)

    def row(self, e):
        reasons, level = [], 0

        def hit(severity, reason):
            nonlocal level
            level = max(level, severity)
            if reason not in reasons:
                reasons.append(reason)

        detected = e["us"] is None or self.end is None or e["us"] > self.end
        access, variables, parameters = (json.loads(e[c]) for c in ("access_result", "variables", "control_parameters"))
        within = e["is_control"] == 1 or hinted(e["variables"]) or hinted(e["access_result"])
        name, seq = "", None
        if e["report"]:
            visible = [x["value"] for x in access if x["type"] == "visible-string"]
            name = next((v for v in visible if "$RP$" in v or "urcb" in v.lower() or "brcb" in v.lower()), next((v for v in visible if v), "")) or e["variable_list_name"] or "RPT"
            seq = next((x["value"] for x in access if x["type"] == "unsigned"), None)
        if "LastApplError" in e["variables"]:
            hit(1, "last_appl_error")
        if e["write"]:
            self.writes(e, detected, hit)
        refs, flags, entries = [], [], []
        if within:
            refs = sorted({s for s in strings(variables) if hinted(s)} | {x["value"] for x in access if x["type"] == "visible-string" and hinted(x["value"])})
            flags = ["true" if v else "false" for v in typed(access, "boolean", bool)]
            if self.known and any(x not in self.known for x in {*typed([access, parameters], "octet-string", str)}):
                hit(2, "unexpected_octet_identity_in_control_context")
            for item in (x for x in access if x["type"] == "structure"):
                ctl = next(typed(item, "unsigned", int), None)
                entries += [(o, ctl) for o in sorted(set(typed(item, "octet-string", str))) if (o, ctl) not in entries]
            if seq is not None:
                for origin in dict.fromkeys(o for o, _ in entries):
                    self.number(e, name, seq, origin, refs, hit)
            for origin, ctl in entries:
                self.entry(e, origin, ctl, hit)
        stat_reasons, stat = self.statistics(e)
        if not detected:
            return
        protocol = (0.0, 45.0, 70.0)[level] + min(20.0, 5.0 * max(0, len(reasons) - 1))
        total = min(100.0, protocol + stat)
        tag = NAMES[2 if level == 2 or total >= 70 else 1 if level == 1 or total >= 40 else 0]
        origins, ctls = sorted({o for o, _ in entries} - {""}), sorted({c for _, c in entries} - {None})
        key = tag, e["src"], e["dst"], e["service"], *sorted({*reasons, *stat_reasons})[:3], "|", *origins, *ctls, seq, "|", *refs, "|", *flags
        self.out["packet", e["line"]] = (sorted(reasons), NAMES[level], stat_reasons, protocol, round(total, 6), tag, self.quiet(tag != "normal", key, e["us"]), origins, ctls, seq, refs, flags)

    def quiet(self, alert, key, us):
        if not alert or us is None:
            return False
        if key in self.sent and us - self.sent[key] < self.o.quiet_us:
            return True
        self.sent[key] = us
        return False

    def run(self, rows):
        for e in rows:
            self.row(e)
        for e in sorted(self.armed.values(), key=lambda e: e["line"]):
            key = "pending", e["src"], e["dst"], e["service"], e["object"], e["ctl"], e["origin"]
            self.out["synthetic", e["line"]] = (["sbow_without_matching_oper"], NAMES[1], [], 45.0, 45.0, NAMES[1], self.quiet(True, key, e["us"]), None, None, None, None, None)
        return self.out


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 14), (2, 64)])
def test_every_alert_is_the_plain_pass(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ordering, "BLOCK", block)
    ship(spark)
    rows, dicts = generated(seed, 1500)
    df = spark.createDataFrame(rows, SCHEMA)
    o = detector.Options(emit_all=True, sequence=True, duplicates=True, memory=3 if seed % 2 else 5000, strict=seed == 2)
    events = df.drop("is_control", "variable_list_name", "access_result", "control_parameters")
    model = baseline.model_tables(events, 300 * S, o.window_us)
    want = Plain(model, o).run(dicts)
    got = detector.detect(events, model, normalize.payload_values(df), o).collect()
    assert {(x["event_source"], x["line"]) for x in got} == set(want) and len(got) == len(want)
    fields = ("protocol_tag", "stat_reasons", "protocol_score", "anomaly_score", "final_tag", "suppressed", "report_origins", "report_ctls", "report_seq", "refs", "flags")
    for x in got:
        value = lambda c, x=x: round(x[c], 6) if c == "anomaly_score" else x[c]
        assert (sorted(x["protocol_reasons"]), *map(value, fields)) == want[x["event_source"], x["line"]], (x["event_source"], x["line"])
    assert len({t[5] for t in want.values()}) == 3 and {t[6] for t in want.values()} == {True, False}
