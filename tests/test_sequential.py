"""Rules against sequential models, on random events with equal, missing and falling times and missing values."""

import random
from collections import Counter, defaultdict, deque

import pytest

from tracewright.operators import protocol, scenarios, statistical

S = 1_000_000
SCHEMA = "line long, us long, src string, dst string, direction string, service string, stream string, action string, object string, origin string, ctl long, invoke long, write boolean, report boolean"


def make(seed, n=400):
    r = random.Random(seed)
    t, rows = 0, []
    for line in range(1, n + 1):
        t += r.choice([0, 0, 1, 2, 5, 30, -12]) * S
        write = r.random() < 0.6
        rows.append((
            line, None if r.random() < 0.08 else t, r.choice("ab"), r.choice("xy"), "REQUEST", r.choice(["WRITE", "READ"]), r.choice("st"), r.choice(["SBOw", "Oper", ""]), r.choice(["o1", "o2", ""]),
            r.choice(["g1", "g2", "g3", ""]), r.choice([None, 1, 2, 3, 4]), r.choice([None, 1, 2, 3, 4, 5]), write, not write,
        ))
    return rows


def as_dicts(rows):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return [dict(zip(names, r, strict=True)) for r in rows]


@pytest.fixture(params=[1, 2])
def events(request, spark):
    rows = make(request.param)
    return as_dicts(rows), spark.createDataFrame(rows, SCHEMA)


def by_line(df, *columns):
    return {r["line"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_live_rate_counts_arrivals(events):
    rows, df = events
    held, want = defaultdict(deque), {}
    for e in rows:
        q = held[e["src"], e["dst"], e["direction"], e["service"]]
        if e["us"] is None:
            want[e["line"]] = None
            continue
        while q and q[0] < e["us"] - 30 * S:
            q.popleft()
        q.append(e["us"])
        want[e["line"]] = len(q)
    assert by_line(statistical.live_rate(df, 30 * S), "live") == want


def test_pairing_and_pending(events):
    rows, df = events
    armed, lonely, late = {}, set(), set()
    for e in (x for x in rows if x["write"]):
        key = (e["src"], e["dst"], e["object"], e["ctl"])
        if e["action"] == "SBOw":
            armed[key] = e
        elif e["action"] == "Oper":
            if key not in armed:
                lonely.add(e["line"])
            else:
                since = armed.pop(key)["us"]
                if since is not None and e["us"] is not None and e["us"] - since > 15 * S:
                    late.add(e["line"])
    got = protocol.pairing(df.where("write")).collect()
    assert {r["line"] for r in got if r["oper_without_matching_sbow"]} == lonely
    assert {r["line"] for r in got if r["late_oper"]} == late
    assert {r["line"] for r in protocol.pending_selects(df.where("write")).collect()} == {e["line"] for e in armed.values()}


def test_counters_and_identifiers(events):
    rows, df = events
    high, seen, ctl_high, uses, objects = {}, set(), {}, Counter(), defaultdict(set)
    want = {}
    for e in (x for x in rows if x["write"]):
        ch, okey = (e["src"], e["dst"]), e["origin"] or "UNKNOWN"
        inv, ctl, flags = e["invoke"], e["ctl"], set()
        if inv is None:
            flags.add("missing_invoke_id_on_write")
        else:
            if inv < high.get(ch, inv):
                flags.add("write_invoke_id_regression")
            if (ch, inv) in seen:
                flags.add("duplicate_write_invoke_id")
            seen.add((ch, inv))
            high[ch] = max(high.get(ch, inv), inv)
        if ctl is not None:
            if ctl < ctl_high.get((ch, okey), ctl):
                flags.add("write_ctlnum_regression")
            ctl_high[ch, okey] = max(ctl_high.get((ch, okey), ctl), ctl)
            uses[ch, okey, ctl] += 1
            if e["object"]:
                objects[ch, okey, ctl].add(e["object"])
            if len(objects[ch, okey, ctl]) > 1:
                flags.add("write_ctlnum_reused_across_objects")
            if uses[ch, okey, ctl] > 2:
                flags.add("write_ctlnum_reused_excessively")
        want[e["line"]] = flags
    w, got = df.where("write"), defaultdict(set)
    for part in (protocol.invoke_rules(w), protocol.ctl_rules(w)):
        for r in part.collect():
            got[r["line"]] |= {c for c in part.columns if c != "line" and r[c]}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_allowed_origin_is_the_running_leader(events):
    rows, df = events
    counts, leader, want = Counter(), None, {}
    for e in (x for x in rows if x["write"] and x["origin"]):
        want[e["line"]] = leader
        counts[e["origin"]] += 1
        if leader is None or counts[e["origin"]] > counts[leader]:
            leader = e["origin"]
    assert by_line(protocol.allowed_origin(df.where("write")), "allowed") == want


def answers(recent, us):
    """Whether the last write that isn't later is within 20 seconds."""
    if us is None:
        return False
    while recent and recent[0] < us - 60 * S:
        recent.popleft()
    for w in reversed(recent):
        if us - w >= 0:
            return us - w <= 20 * S
    return False


def test_a_report_may_answer_a_write_before_the_last(spark):
    """Unless that is forgotten: a write drops those over 60 s before it (lines 7 to 9)."""
    columns = "line long, us long, src string, dst string, origin string, ctl long"
    writes = spark.createDataFrame([(1, 10 * S, "a", "x", "g", 1), (2, 60 * S, "a", "x", "g", 1), (7, 10 * S, "c", "x", "g", 1), (8, 100 * S, "c", "x", "g", 1), (4, 95 * S, "b", "x", "g", 1), (5, 70 * S, "b", "x", "g", 1)], columns)
    entries = spark.createDataFrame([(3, 15 * S, "x", "a", "g", 1), (6, 100 * S, "x", "b", "g", 1), (9, 15 * S, "x", "c", "g", 1)], columns).selectExpr("*", "0 AS pos")
    assert by_line(protocol.report_rules(entries, writes, strict=True), "report_without_matching_write") == {3: False, 6: True, 9: True}


@pytest.mark.parametrize("block", [1 << 14, 16])
def test_a_hot_answered_key_with_falling_times(spark, monkeypatch, block):
    from tracewright.operators import ordering

    monkeypatch.setattr(ordering, "BLOCK", block)
    r = random.Random(block)
    t, rows, recent, want = 0, [], deque(), {}
    for line in range(500):
        t += r.choice([0, 1, 5, 9, -15, -2, 20]) * S
        rows.append((line, t, "a", "x", "g", 1, r.random() < 0.5))
        if rows[-1][-1]:
            recent.append(t)
            while recent[0] < t - 60 * S:
                recent.popleft()
        else:
            want[line] = not answers(recent, t)
    df = spark.createDataFrame(rows, "line long, us long, src string, dst string, origin string, ctl long, write boolean")
    got = protocol.report_rules(df.where("NOT write").selectExpr("line", "0 AS pos", "us", "dst AS src", "src AS dst", "origin", "ctl"), df.where("write"), strict=True)
    assert by_line(got, "report_without_matching_write") == want and {True, False} == set(want.values())


def test_arrivals_are_measured_from_the_last_known_time(events, spark):
    """Also after rows without a time, as in training."""
    rows, df = events
    last, want = {}, {}
    for e in rows:
        key = e["src"], e["dst"], e["direction"], e["service"]
        gap = None if e["us"] is None or key not in last else (e["us"] - last[key]) / S
        want[e["line"]] = gap is not None and gap >= 0 and abs(gap - 1) / 0.5 >= 3
        if e["us"] is not None:
            last[key] = e["us"]
    channels = {"|".join((e["src"], e["dst"], e["direction"], e["service"])) for e in rows}
    stats = spark.createDataFrame([(c, "interarrival", 50, 1.0, 0.5) for c in channels], "channel string, metric string, n long, mean double, std double")
    scored = statistical.score(df.selectExpr("*", "CAST(1 AS double) AS size"), spark.createDataFrame([], "combo string, p double"), stats, 30 * S)
    assert {r["line"]: "interarrival_outlier" in r["stat_reasons"] for r in scored.collect()} == want


@pytest.mark.parametrize(("memory", "block"), [(3, 8), (5000, 64)])
def test_a_channel_forgets_its_oldest_ids(spark, monkeypatch, memory, block):
    from tracewright.operators import ordering

    monkeypatch.setattr(ordering, "BLOCK", block)
    r = random.Random(memory)
    rows, held, want, high = [], defaultdict(dict), {}, 0
    for line in range(600):
        high += r.random() < 0.7
        src, invoke = ("hot" if r.random() < 0.9 else r.choice("ab")), r.choice([None, high, high, high, high + 1, max(0, high - r.choice([2, 4, 40]))])
        rows.append((line, src, "x", invoke))
        seen = held[src]
        want[line] = invoke is not None and invoke in seen
        if invoke is not None:
            seen.setdefault(invoke)
            if len(seen) > memory:
                del seen[next(iter(seen))]
    got = protocol.invoke_rules(spark.createDataFrame(rows, "line long, src string, dst string, invoke long"), memory)
    assert by_line(got, "duplicate_write_invoke_id") == want


def test_report_rules_follow_writes_of_the_same_line(events):
    rows, df = events
    known, ctls, recent, high, want = set(), defaultdict(set), defaultdict(deque), {}, {}
    for e in rows:
        if e["write"] and e["origin"]:
            known.add(e["origin"])
            if e["ctl"] is not None:
                ctls[e["origin"]].add(e["ctl"])
                if e["us"] is not None:
                    dq = recent[e["src"], e["dst"], e["origin"], e["ctl"]]
                    dq.append(e["us"])
                    while dq[0] < e["us"] - 60 * S:
                        dq.popleft()
        if not e["report"] or not e["origin"]:
            continue
        o, c, flags = e["origin"], e["ctl"], set()
        if known and o not in known:
            flags.add("report_origin_not_seen_in_writes")
        severity = 0
        if c is not None:
            key = (e["src"], e["dst"], o)
            if c < high.get(key, c):
                flags.add("report_ctlnum_regression")
            high[key] = max(high.get(key, c), c)
            if ctls[o]:
                if c < min(ctls[o]):
                    flags.add("report_ctlnum_below_write_baseline")
                elif c <= max(ctls[o]) and c not in ctls[o]:
                    flags.add("report_ctlnum_not_seen_in_writes")
            if not answers(recent[e["dst"], e["src"], o, c], e["us"]):
                if known and o not in known:
                    severity = 2
                elif c not in ctls[o]:
                    severity = 1
                if severity:
                    flags.add("report_without_matching_write")
        want[e["line"]] = (flags, severity)
    entries = df.where("report").selectExpr("line", "0 AS pos", "us", "src", "dst", "origin", "ctl")
    got = protocol.report_rules(entries, df.where("write"))
    names = [c for c in got.columns if c not in ("line", "pos", "unmatched_severity")]
    assert {r["line"]: ({n for n in names if r[n]}, r["unmatched_severity"]) for r in got.collect()} == want


@pytest.mark.parametrize("block", [1 << 14, 16])
def test_report_sequence_resets_after_silence(spark, monkeypatch, block):
    """One key has nine of ten rows."""
    from tracewright.operators import ordering

    monkeypatch.setattr(ordering, "BLOCK", block)
    r = random.Random(5)
    t, rows = 0, []
    for line in range(400):
        t += r.choice([0, 10, 50, 200, -30]) * S
        rows.append((line, None if r.random() < 0.1 else t, r.choice("aaaaaaaaab"), r.randint(0, 12)))
    state, want = {}, {}
    for line, us, key, seq in rows:
        prev, at = state.get(key, (None, None))
        fresh = prev is None or None not in (us, at) and us - at > 120 * S
        want[line] = (not fresh and prev - seq > 2, not fresh and prev == seq)
        state[key] = (seq if fresh else max(prev, seq), us)
    got = protocol.report_sequence(spark.createDataFrame(rows, "line long, us long, key string, seq long"))
    assert by_line(got, "report_seq_regression", "report_seq_duplicate") == want


@pytest.mark.parametrize(("block", "steps"), [(1 << 14, [0, 1, 5, 12, 40]), (8, [0, 1, 3, 7]), (16, [0, 3, 9, -5, -40, 25])])
def test_suppression_is_anchored_at_the_last_sent(spark, monkeypatch, block, steps):
    """Also within bursts that many blocks long know no pause, and where times fall."""
    from tracewright.operators import ordering

    monkeypatch.setattr(ordering, "BLOCK", block)
    r = random.Random(6)
    t, rows = 0, []
    for line in range(400):
        t += r.choice(steps) * S
        rows.append((line, None if r.random() < 0.05 else t, r.choice("pppq")))
    sent, want = {}, {}
    for line, us, key in rows:
        quiet = us is not None and key in sent and us - sent[key] < 30 * S
        if us is not None and not quiet:
            sent[key] = us
        want[line] = quiet
    got = protocol.suppress(spark.createDataFrame(rows, "line long, us long, fingerprint string"))
    assert by_line(got, "suppressed") == want


@pytest.mark.parametrize(("block", "share"), [(1 << 14, 0.12), (16, 0.12), (16, 0.7)])
def test_scenarios_against_a_loop(spark, monkeypatch, block, share):
    """Also with one cluster nearly as long as its group, and groups that are many blocks."""
    from tracewright.operators import ordering

    monkeypatch.setattr(ordering, "BLOCK", block)
    r = random.Random(7)
    t, rows = 0, []
    for line in range(250):
        t += r.choice([0, 2, 8, 25, 60 if share < 0.5 else 20]) * S
        rows.append((line, t, r.choice("gh"), r.random() < share))
    labels, summary = scenarios.label(spark.createDataFrame(rows, "line long, us long, grp string, seed boolean"))
    want, no, counts = {x[0]: (None, "normal") for x in rows}, 0, {}
    for g in "gh":
        own = sorted((x for x in rows if x[2] == g), key=lambda x: (x[1], x[0]))
        runs, last = [], None
        for p, x in enumerate(own):
            if x[3]:
                if last is None or x[1] - last > 30 * S:
                    runs.append([])
                runs[-1].append(p)
                last = x[1]
        for run in runs:
            no += 1
            name, a, b = f"scenario_{no:04d}", own[run[0]][1], own[run[-1]][1]
            inside = [p for p, x in enumerate(own) if run[0] - 4 <= p <= run[-1] + 4 or a - 15 * S <= x[1] <= b + 15 * S]
            counts[name] = (len(run), len(inside))
            for p in inside:
                want[own[p][0]] = (name, "core" if p in run else "context")
    assert by_line(labels, "scenario", "role") == want
    assert {x["scenario"]: (x["seeds"], x["rows"]) for x in summary.collect()} == counts


def test_detector_gates_training_rows(events, spark):
    """Training rows feed pairing, but aren't shown, and their origins aren't learned."""
    from tracewright.operators import baseline, detector

    rows, df = events
    df = df.selectExpr("*", "1.0 AS size")
    span = 300 * S
    end = next(e["us"] for e in rows if e["us"] is not None) + span
    model = baseline.model_tables(df, span, 30 * S)
    got = {(r["event_source"], r["line"]): r for r in detector.detect(df, model, options=detector.Options(emit_all=True)).collect()}
    packets = {line for kind, line in got if kind == "packet"}
    assert packets == {e["line"] for e in rows if e["us"] is None or e["us"] > end}
    armed, lonely = {}, set()
    for e in (x for x in rows if x["write"]):
        key = (e["src"], e["dst"], e["object"], e["ctl"])
        if e["action"] == "SBOw":
            armed[key] = e["line"]
        elif e["action"] == "Oper" and armed.pop(key, None) is None:
            lonely.add(e["line"])
    assert {n for n in packets if "oper_without_matching_sbow" in got["packet", n]["protocol_reasons"]} == lonely & packets
    assert {line for kind, line in got if kind == "synthetic"} == set(armed.values())
    leader, counts, odd = None, Counter(), set()
    for e in (x for x in rows if x["write"] and x["origin"] and (x["us"] is None or x["us"] > end)):
        if leader is not None and e["origin"] != leader:
            odd.add(e["line"])
        counts[e["origin"]] += 1
        if leader is None or counts[e["origin"]] > counts[leader]:
            leader = e["origin"]
    assert {n for n in packets if "unexpected_origin_identifier" in got["packet", n]["protocol_reasons"]} == odd
    for r in (got["packet", n] for n in packets):
        assert r["anomaly_score"] == min(100.0, r["protocol_score"] + r["stat_score"])
        assert (r["final_tag"] == "normal") == (r["protocol_tag"] == "normal" and r["anomaly_score"] < 40)
