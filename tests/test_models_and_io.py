"""Models on separable data, splits, thresholds against loops, and files."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions import scalar
from tracewright.operators import evaluation, history, models, normalize, ordering, rules, sequences, statistical
from tracewright.plans import catalog
from tracewright.sources import io


@pytest.fixture(scope="module")
def scored(spark):
    r = random.Random(3)
    rows = [(i, y := int(r.random() < 0.3), round(min(1.0, max(0.0, r.gauss(0.6 if y else 0.4, 0.2))), 2), f"g{r.randrange(25)}", i * 60_000_000) for i in range(600)]
    return rows, spark.createDataFrame(rows, "id long, label int, score double, grp string, us long")


def f1_at(pairs, t):
    tp = sum(y for y, s in pairs if s >= t)
    found = sum(s >= t for _, s in pairs)
    return 2 * tp / (found + sum(y for y, _ in pairs))


def test_row_threshold_is_the_first_best(scored):
    rows, df = scored
    pairs = [(y, s) for _, y, s, _, _ in rows]
    best = max(f1_at(pairs, t) for t in {s for _, s in pairs})
    got = evaluation.row_threshold(df).first()
    assert abs(got["f1"] - best) < 1e-9
    assert got["threshold"] == min(t for t in {s for _, s in pairs} if abs(f1_at(pairs, t) - best) < 1e-12)
    assert evaluation.row_threshold(df.where("label = 0")).first()["threshold"] == 0.5


def test_scenario_threshold_with_few_candidates(scored):
    rows, df = scored
    groups = {}
    for _, y, s, g, _ in rows:
        a, b = groups.get(g, (0, 0.0))
        groups[g] = (max(a, y), max(b, s))
    pairs = list(groups.values())
    if len({y for y, _ in pairs}) == 2:
        best = max(f1_at(pairs, t) for t in {s for _, s in pairs} | {0.5})
        assert abs(evaluation.scenario_threshold(df).first()["f1"] - best) < 1e-9
    assert evaluation.scenario_threshold(df, 5).count() == 1


def test_ranking_metrics(scored):
    rows, df = scored
    pos, neg = [s for _, y, s, _, _ in rows if y], [s for _, y, s, _, _ in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, seen = 0.0, 0.0
    for t in sorted({s for _, _, s, _, _ in rows}, reverse=True):
        tp = sum(s >= t for s in pos)
        recall = tp / len(pos)
        ap += (recall - seen) * tp / (tp + sum(s >= t for s in neg))
        seen = recall
    got = evaluation.ranking(df).first()
    assert abs(got["roc_auc"] - auc) < 1e-9 and abs(got["average_precision"] - ap) < 1e-9


def test_group_split_keeps_groups_and_quotas(scored):
    _, df = scored
    rows = evaluation.group_split(df.withColumn("gid", F.concat("grp", F.lit("|"), F.col("id") % 3)), 0.25).collect()
    sides = {}
    for r in rows:
        sides.setdefault(r["gid"], set()).add(r["split"])
    assert len(rows) == 600 and all(len(s) == 1 for s in sides.values())
    test = [g for g, s in sides.items() if s == {"test"}]
    assert abs(len(test) - round(len(sides) * 0.25)) <= 1
    for side in ("train", "test"):
        assert {r["label"] for r in rows if r["split"] == side} == {0, 1}


def test_folds_are_even(scored):
    _, df = scored
    sizes = {r["fold"]: r["count"] for r in evaluation.time_folds(df, 4).groupBy("fold").count().collect()}
    assert sizes == dict.fromkeys(range(5), 120)
    folds = evaluation.group_folds(df, 4, "grp").groupBy("grp").agg(F.countDistinct("fold").alias("n")).collect()
    assert all(r["n"] == 1 for r in folds)


def test_global_orders_without_one_partition(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(200)], "line long, n long")
    sums = {x["line"]: x["total"] for x in ordering.running_sums(df, {"n": "total"}, F.col("line"), F.floor(F.col("line") / 11)).collect()}
    assert sums == {i: sum(j % 7 for j in range(i + 1)) for i in range(200)}


def test_branches_learn(spark):
    r = random.Random(8)
    rows = [(i, y := int(r.random() < 0.3), y + r.gauss(0, 0.3), r.random(), "train" if i < 300 else "val" if i < 400 else "test") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double, split string")
    branch = models.train_branch(df, ["a", "b"], trees=10, depth=4)
    metrics = evaluation.row_metrics(branch.scored, branch.threshold).first()
    assert metrics["f1"] > 0.85 and metrics["roc_auc"] > 0.95
    assert models.importances(branch.model, ["a", "b"])[0][0] == "a"
    oof = models.out_of_fold(df.withColumn("fold", (F.col("id") % 3).cast("int")), ["a", "b"], "oof", 3, trees=5, depth=3)
    assert oof.count() == 500
    meta = models.meta_features(oof, F.col("oof"), F.col("oof"), F.col("b"), F.col("b"))
    assert evaluation.ranking(models.scores(models.fit_combiner(meta, models.META), meta).select("label", "score")).first()["roc_auc"] > 0.9
    weights = {x["label"]: x["w"] for x in models.with_weights(df).groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    assert abs(weights[0] - weights[1]) < 1e-6


def test_windows_need_full_groups(spark):
    rows = [(i, i * 10, "a" if i < 9 else "b", float(i), None if i == 4 else i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "line long, us long, grp string, x double, label int")
    found = sequences.windows(df, ["x"], 4, 2, label="label")
    assert {(r["grp"], r["end_index"]) for r in found.collect()} == {("a", 3), ("a", 5), ("a", 7)}
    assert sequences.windows(df, ["x"], 4, mode="any").count() == 6 - 4 and sequences.windows(df, ["x"], 3, least=5).where("grp = 'b'").count() == 0
    scale = sequences.tensor_scale(found, ["x"])
    z = sequences.scaled(found, ["x"], scale).selectExpr("explode(steps.x) AS z").agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s")).first()
    assert abs(z["m"]) < 1e-9 and abs(z["s"] - 1) < 1e-9


def test_null_times_and_blank_keys(spark):
    schema = "line long, us long, stream string, src string, dst string, direction string, service string, action string, object string, origin string, ctl long, invoke long, seq long, size double, final_tag string"
    rows = [(i, None if i == 2 else i * 1_000_000, "s", "a", "b", "REQUEST", "W", "", "", "", None, None, None, 1.0, "normal") for i in range(5)]
    got = {r["line"]: r for r in history.features(spark.createDataFrame(rows, schema)).collect()}
    assert got[2]["hour_of_day"] == -1 and got[2]["is_off_hours"] == 1 and all(r["object_prior"] == 0 and r["origin_prior"] == 0 for r in got.values())
    assert got[4]["src_prior"] == 3 and got[2]["src_prior"] == 4  # a row without a time comes last
    assert statistical.live_rate(spark.createDataFrame(rows, schema), 10_000_000).where("line = 2").first()["live"] is None


def test_files_and_line_numbers(spark, tmp_path):
    df = spark.createDataFrame([(i, f'x "{i}"\n,y', ["a", "b"]) for i in range(50)], "n long, t string, l array<string>").repartition(3)
    numbered = io.with_line_numbers(df.sortWithinPartitions("n"))
    assert sorted(r["line"] for r in numbered.collect()) == list(range(1, 51))
    io.write_csv(df, f"file://{tmp_path}/c", compressed=True)
    back = io.read_csv(spark, f"file://{tmp_path}/c", "n long, t string, l string")
    assert {(r["n"], r["t"], r["l"]) for r in back.collect()} == {(i, f'x "{i}"\n,y', "a;b") for i in range(50)}
    assert io.column_names(spark, f"file://{tmp_path}/c") == ["n", "t", "l"]
    assert io.first_lines(numbered, 7).count() == 7 and io.first_lines(numbered, 0).count() == 50


def test_nested_payloads(spark):
    access = '[{"type": "visible-string", "value": "x"}, {"type": "visible-string", "value": "A.brcb01"}, {"type": "unsigned", "value": 9}, {"type": "structure", "value": [{"type": "octet-string", "value": "g2"}, {"type": "octet-string", "value": "g1"}, {"type": "structure", "value": [{"type": "unsigned", "value": 5}]}, {"type": "boolean", "value": false}]}]'
    rows = [(1, "[{'n': 'Q0CSWI1', 'm': ['a$CO$Pos']}]", access, True), (2, "nothing", "", False), (3, None, "{broken", True)]
    got = {r["line"]: r for r in normalize.payload_values(spark.createDataFrame(rows, "line long, variables string, access_result string, report boolean")).collect()}
    assert set(got) == {1, 3} and got[1]["refs"] == ["Q0CSWI1", "a$CO$Pos"] and got[1]["identities"] == ["g1", "g2"] and got[1]["flags"] == ["false"]
    assert [(e["origin"], e["ctl"]) for e in got[1]["entries"]] == [("g1", 5), ("g2", 5)] and (got[1]["report_name"], got[1]["report_seq"]) == ("A.brcb01", 9)
    assert got[3]["refs"] == [] and got[3]["report_name"] == "" and got[3]["report_seq"] is None


def test_scalar_edges(spark):
    row = spark.range(1).select(
        scalar.payload_bytes(F.lit("abc")).alias("odd"), scalar.payload_bytes(F.lit("  ")).alias("none"), scalar.payload_bytes_or_zero(F.lit("abc")).alias("floored"),
        scalar.parse_int(F.lit(" 12 ")).alias("i"), scalar.parse_int(F.lit("1.5")).alias("bad"), scalar.parse_timestamp(F.lit("x")).alias("ts"),
        scalar.finite(F.lit(float("inf"))).alias("inf"), scalar.finite(F.lit(2e9), 1e9).alias("large"), scalar.split_list(F.lit("b; a;b;")).alias("l"), scalar.entity_prefix(F.lit("E1_Q2")).alias("p"),
        scalar.joint_key(F.lit("a"), F.lit("")).alias("k"), scalar.actor(F.lit("a"), F.lit("")).alias("who"),
    ).first()
    assert (row["odd"], row["none"], row["floored"], row["i"], row["bad"], row["ts"]) == (None, None, 1, 12, None, None)
    assert (row["inf"], row["large"], row["l"], row["p"], row["k"], row["who"]) == (0.0, 0.0, ["b", "a"], "E1", "", "a|<NO_ORIGIN>")


def test_rules_without_scenarios(spark):
    df = spark.createDataFrame([(1, "report_ctlnum_regression", None, 1, "normal"), (2, "", None, 0, "normal"), (3, "last_appl_error", "s", 1, "core"), (4, None, "s", 0, "normal")], "line long, protocol_reasons string, scenario string, label int, role string")
    rows = rules.predict(rules.escalate(rules.reason_flags(df)))
    got = {r["line"]: (r["predicted"], r["confidence"], r["escalated"]) for r in rows.collect()}
    assert got == {1: (1, 3, 0), 2: (0, 0, 0), 3: (1, 1, 0), 4: (0, 0, 0)}
    assert rules.level_metrics(rows).count() == 3


def test_model_queries_fit_the_whole_forest(spark, sf_dir, monkeypatch):
    """Trees, depth, leaf and window size of the studied branches; the fits stand aside."""
    seen, fit = [], models.fit_forest

    def small(train, features, label="label", trees=models.TREES, depth=models.DEPTH, leaf=models.LEAF, seed=models.SEED):
        seen.append((trees, depth, leaf, len(features)))
        return fit(train, features, label, 2, 2, leaf, seed)

    monkeypatch.setattr(models, "fit_forest", small)
    wide = {"m6_m7_forest_branch": {4}, "d6_rules_only_branch": {2}, "m8_sequence_branch": {24}, "m10_m13_fusion": {3, 24}}
    for name, features in wide.items():
        seen.clear()
        catalog.queries()[name](spark, sf_dir)
        assert {x[:3] for x in seen} == {(300, 12, 2)} and {x[3] for x in seen} == features


# -- streams and growing baselines ---------------------------------------------------------


def test_armed_selects_end_when_the_watermark_passes(spark, tmp_path):
    """Several batches: what stays armed is told by its timer, and no state is left behind."""
    import datetime

    from tracewright.streaming import detector as stream

    r = random.Random(12)
    start, t, rows = datetime.datetime(2024, 1, 1), 0, []
    for line in range(300):
        t += r.choice([0, 1, 4, 20])
        rows.append((line, t, r.choice(["SBOw", "Oper", ""]), r.choice("ab"), "x", r.choice("op"), r.choice([None, 1, 2])))
    rows.append((300, t + 10**6, "Oper", "end", None, None, None))
    schema = "line long, ts timestamp, action string, src string, dst string, object string, ctl long"
    for i in range(0, len(rows), 60):
        part = [(n, start + datetime.timedelta(seconds=s), *rest) for n, s, *rest in rows[i : i + 60]]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i:04d}")
    keep = 60
    armed, want = {}, []
    for line, s, action, *key in rows:
        key = tuple(key)
        if not action:
            continue
        if key in armed and s - armed[key][1] > keep:
            want.append((armed.pop(key)[0], stream.PENDING, None))
        if action == "SBOw":
            armed[key] = (line, s)
        elif key not in armed:
            want.append((line, stream.LONELY, None))
        else:
            delay = s - armed.pop(key)[1]
            want += [(line, stream.LATE, delay * 1_000_000)] if delay > 15 else []
    want += [(line, stream.PENDING, None) for line, _ in armed.values()]
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    found = stream.paired_steps(source, keep_us=keep * 1_000_000, late="1 second")
    query = found.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = [tuple(x) for x in spark.read.parquet(f"file://{tmp_path}/out").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {x[1] for x in got} == {stream.PENDING, stream.LONELY, stream.LATE}
    assert len(query.recentProgress) > 4 and query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_a_baseline_grows_by_merging(spark):
    from tracewright.operators import baseline

    r = random.Random(13)
    t, rows = 0, []
    for line in range(1, 500):
        t += r.choice([0, 1, 3, 50, -2, 4000]) * 1_000_000
        rows.append((line, None if r.random() < 0.1 else t, r.choice("ab"), "x", "REQUEST", r.choice(["R", "W", "rare" if r.random() < 0.02 else "R"]), None if r.random() < 0.2 else r.gauss(50, 9), r.choice(["g", "h", ""]), r.choice([None, 1, 2, 3]), r.random() < 0.5))
    df = spark.createDataFrame(rows, "line long, us long, src string, dst string, direction string, service string, size double, origin string, ctl long, write boolean")
    window = 30_000_000
    cuts = [0, 120, 125, 400, 500]
    states = [baseline.baseline_state(df.where((F.col("line") >= a) & (F.col("line") < b)), window) for a, b in zip(cuts, cuts[1:], strict=False)]
    merged = states[0]
    for s in states[1:]:
        merged = baseline.merge_states(merged, s)
    got = baseline.state_tables(merged)
    near = lambda df, *key: {tuple(x[k] for k in key): [round(v, 6) if isinstance(v, float) else v for v in x] for x in df.collect()}
    assert near(got["channel_stats"].select("channel", "metric", "n", "mean", "std"), "channel", "metric") == near(baseline.channel_stats(df, window).where("n > 0"), "channel", "metric")
    assert near(got["service_prob"], "combo") == near(baseline.service_probability(df), "combo")
    assert near(got["origin_ctl"], "origin") == near(baseline.origin_ctls(df), "origin")


@pytest.mark.parametrize("block", [1 << 14, 8])
def test_windows_of_a_hot_group_are_a_loops(spark, monkeypatch, block):
    monkeypatch.setattr(ordering, "BLOCK", block)
    r = random.Random(14)
    rows = [(i, None if r.random() < 0.05 else r.randrange(2000), r.choice("aaaaaaaaab") if r.random() < 0.97 else None, float(i), r.choice([0, 0, 1, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "line long, us long, grp string, x double, label int").repartition(3)
    for size, step, least, mode in ((8, 1, 0, "end"), (5, 3, 30, "any"), (1, 1, 0, "end")):
        want = set()
        for g in ("a", "b", None):
            own = sorted((x for x in rows if x[2] == g), key=lambda x: (x[1] is None, x[1] or 0, x[0]))
            for e in range(size - 1, len(own), step):
                part = own[e - size + 1 : e + 1]
                labels = [x[4] for x in part]
                label = (None if None in labels else max(labels)) if mode == "any" else labels[-1]
                if label is not None and len(own) >= max(size, least):
                    want.add((g, e - size + 1, e, part[0][0], part[-1][0], sum(x or 0 for x in labels), label, tuple(x[3] for x in part)))
        got = {(x["grp"], x["start_index"], x["end_index"], x["start_line"], x["end_line"], x["positives"], x["label"], tuple(s["x"] for s in x["steps"])) for x in sequences.windows(df, ["x"], size, step, least, mode=mode).collect()}
        assert got == want


def test_a_quoted_csv_is_split_anywhere(spark, tmp_path):
    """Line breaks and quotes in fields, blank lines, two files, and columns by name, over many splits."""
    import csv

    r = random.Random(15)
    texts = ["plain", "", 'say "x"', "two\nlines", "a\r\nb", '"', '""\n"', "é, ü", "\n\n", " padded ", "x" * 300, None]
    rows = [(i, r.choice(texts), r.choice(texts), round(r.random(), 3)) for i in range(600)]
    for part, line in ((0, "\n"), (1, "\r\n")):
        with (tmp_path / f"f{part}.csv").open("w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator=line)
            w.writerow(["n", "unused", "t", "u", "v"])
            w.writerows([i, "z", *rest] for i, *rest in rows[part * 300 : part * 300 + 300])
            f.write(line)  # a blank line at the end
    schema, path = "n long, v double, t string, u string, missing string", f"file://{tmp_path}"
    # as Python's reader has it; Spark's own makes one line break of those in a quoted field
    want = sorted(str((i, v, t or None, u or None, None)) for i, t, u, v in rows)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = io.read_csv(spark, path, schema)
        assert io.csv_records(spark, path).select("file", "place.split").distinct().count() > 40
        assert sorted(str(tuple(x)) for x in got.collect()) == want and len(want) == 600
        assert [x["u"] for x in io.read_csv(spark, path, schema, ["u", "n"]).where("n = 7").collect()] == [rows[7][2] or None]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held[0])
        spark.conf.set("spark.sql.files.openCostInBytes", held[1])
