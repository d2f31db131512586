"""Running values of hot keys, dealt over blocks of lines."""

import random

import pytest

from tracewright.operators import history, ordering, protocol, reports


@pytest.fixture()
def hot(spark):
    """One origin has nine of ten rows."""
    r = random.Random(8)
    rows = []
    for line in range(1, 601):
        origin = "hot" if r.random() < 0.9 else r.choice(["a", "b", "", None])
        rows.append((line, line * 700_000 + r.randint(0, 900_000), r.choice("xy"), r.choice("uv"), origin, r.choice([None, *range(6)]), r.choice(["SBOw", "Oper"]), r.choice(["o", "p"])))
    return spark.createDataFrame(rows, "line long, us long, src string, dst string, origin string, ctl long, action string, object string").repartition(3)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_blocks_change_nothing(hot, monkeypatch):
    writes, entries = hot.where("line % 3 > 0"), hot.where("line % 3 = 0").selectExpr("line", "0 AS pos", "us", "dst AS src", "src AS dst", "origin", "ctl")
    whole = rows_of(protocol.allowed_origin(writes)), rows_of(protocol.report_rules(entries, writes))
    monkeypatch.setattr(ordering, "BLOCK", 16)
    assert (rows_of(protocol.allowed_origin(writes)), rows_of(protocol.report_rules(entries, writes))) == whole


def test_running_values_of_a_hot_key_are_a_loops(hot, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK", 16)
    f = __import__("pyspark.sql.functions", fromlist=["col"])
    wanted = {"n": ("sum", f.lit(1).cast("long")), "low": ("min", f.col("ctl")), "high": ("max", f.col("ctl")), "was": ("last", f.col("ctl"))}
    for inclusive in (True, False):
        got = {r["line"]: (r["n"], r["low"], r["high"], r["was"]) for r in ordering.running_by_key(hot, ["origin"], wanted, ["line"], inclusive).collect()}
        seen, want = {}, {}
        for r in sorted(hot.collect(), key=lambda r: r["line"]):
            held = seen.setdefault(r["origin"], [])
            now = [*held, r["ctl"]] if inclusive else held
            known = [x for x in now if x is not None]
            want[r["line"]] = (len(now), min(known, default=None), max(known, default=None), known[-1] if known else None)
            held.append(r["ctl"])
        assert got == want


def test_sessions_over_blocks_of_time(hot, monkeypatch):
    want, session, last = {}, 0, None
    for us, line in sorted((r["us"], r["line"]) for r in hot.collect()):
        session += last is None or us - last > 900_000
        want[line], last = session, us
    for block in (ordering.BLOCK, 16):
        monkeypatch.setattr(ordering, "BLOCK", block)
        assert {r["line"]: r["session"] for r in reports.sessions(hot.select("us", "line"), 900_000).collect()} == want


def test_prior_counts_of_hot_keys_are_a_loops(hot, monkeypatch):
    f = __import__("pyspark.sql.functions", fromlist=["col"])
    rows = hot.withColumn("us", f.when(f.col("line") % 50 != 0, f.col("us"))).selectExpr("*", "cast(null AS long) AS invoke", "cast(null AS long) AS seq").fillna("", ["origin"])
    monkeypatch.setattr(ordering, "BLOCK", 16)
    keyed = history.with_keys(rows)
    distinct = history.prior_distinct(history.prior_counts(keyed), {"srcs": ("origin", "src", f.col("has_origin") == 1)})
    counts, met = {}, {}
    for r in sorted(distinct.collect(), key=lambda r: (r["us"] is None, r["us"], r["line"]) if r["us"] is not None else (True, 0, r["line"])):
        for key, out in (("src", "src_prior"), ("action", "action_prior"), ("origin", "origin_prior"), ("actor_object_action", "actor_object_action_prior")):
            assert r[out] == (counts.get((key, r[key]), 0) if r[key] else 0), (key, r)
            counts[key, r[key]] = counts.get((key, r[key]), 0) + 1
        assert r["srcs"] == (len(met.setdefault(r["origin"], set())) if r["origin"] else 0)
        met.setdefault(r["origin"], set()).add(r["src"])


def test_prior_counts_of_no_rows(hot):
    empty = hot.selectExpr("*", "cast(null AS long) AS invoke", "cast(null AS long) AS seq").limit(0)
    assert history.prior_counts(history.with_keys(empty)).count() == 0


def test_rules_and_history_of_hot_keys_do_not_hang_on_blocks(hot, monkeypatch):
    rows = hot.selectExpr("*", "line % 9 AS invoke", "if(line % 4 = 0, null, line % 5) AS seq", "src AS stream", "action AS service", "ctl * 1.5 AS size").fillna("", ["origin"])

    def found():
        keyed = history.prior_counts(history.with_keys(rows))
        return rows_of(protocol.write_rules(rows)), rows_of(protocol.pairing(rows)), rows_of(history.counters(history.transitions(keyed)))

    whole = found()
    monkeypatch.setattr(ordering, "BLOCK", 16)
    assert found() == whole


def test_one_long_burst_is_read_as_a_stream(hot, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK", 16)
    alerts = hot.selectExpr("line", "us", "'same' AS fingerprint")
    sent, want = None, {}
    for line, us in sorted((r["line"], r["us"]) for r in alerts.collect()):
        want[line] = sent is not None and us - sent < 30_000_000
        sent = sent if want[line] else us
    assert {r["line"]: r["suppressed"] for r in protocol.suppress(alerts).collect()} == want
