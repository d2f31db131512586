"""History features, sequence windows and scenario labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history, scenarios, sequences
from .bind import EVENTS, HOUR, events
from .registry import query

E = f"WITH e AS ({EVENTS})"
K = f"""{E}, k AS (SELECT *, src || '|' || CASE WHEN origin <> '' THEN origin ELSE '<NO_ORIGIN>' END AS actor FROM e),
y AS (SELECT *, CASE WHEN object <> '' THEN actor || '|' || object ELSE '' END AS ao, CASE WHEN action <> '' THEN actor || '|' || action ELSE '' END AS aa,
  CASE WHEN object <> '' AND action <> '' THEN object || '|' || action ELSE '' END AS oa, CASE WHEN origin <> '' AND object <> '' THEN origin || '|' || object ELSE '' END AS oo,
  CASE WHEN object <> '' AND action <> '' THEN actor || '|' || object || '|' || action ELSE '' END AS aoa FROM k)"""


def _n(key: str, mask: str | None = None) -> str:
    n = f"row_number() OVER (PARTITION BY {key} ORDER BY us, line) - 1"
    return f"({n})::INTEGER" if mask is None else f"(CASE WHEN {mask} THEN {n} ELSE 0 END)::INTEGER"


COUNTS = f"""{_n("actor")} AS actor_prior, {_n("actor", "origin <> ''")} AS source_origin_prior, {_n("src")} AS src_prior, {_n("origin", "origin <> ''")} AS origin_prior, {_n("object", "object <> ''")} AS object_prior,
  {_n("action", "action <> ''")} AS action_prior, {_n("ao", "ao <> ''")} AS actor_object_prior, {_n("aa", "aa <> ''")} AS actor_action_prior, {_n("oa", "oa <> ''")} AS object_action_prior,
  {_n("oo", "oo <> ''")} AS origin_object_prior, {_n("aoa", "aoa <> ''")} AS actor_object_action_prior"""
COUNT_NAMES = ["actor_prior", "source_origin_prior", "src_prior", "origin_prior", "object_prior", "action_prior", "actor_object_prior", "actor_action_prior", "object_action_prior", "origin_object_prior", "actor_object_action_prior"]


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.with_keys(events(spark, sf_dir))


def _ints(df: DataFrame, *names: str) -> DataFrame:
    return df.select("line", *[F.col(n).cast("int").alias(n) for n in names])


def _alerts(e: DataFrame) -> DataFrame:
    """Two alerts for some lines, so that there is something to deduplicate."""
    packet = e.where("final_tag <> 'normal'").select(F.lit("packet").alias("event_source"), "line", F.lit(1).alias("pos"), F.col("final_tag").alias("tag"))
    return packet.unionByName(e.where("seed OR action = 'SBOw'").select(F.lit("synthetic").alias("event_source"), "line", F.lit(0).alias("pos"), F.lit("pending").alias("tag")))


ALERTS = """al AS (SELECT 'packet' AS s, line, final_tag AS tag FROM e WHERE final_tag <> 'normal' UNION ALL SELECT 'synthetic', line, 'pending' FROM e WHERE seed OR action = 'SBOw'),
dd AS (SELECT line, arg_min(tag, s) AS tag, min(s) AS event_source FROM al GROUP BY line)"""


@query(f"{E}, {ALERTS} SELECT line, event_source, tag FROM dd")
def h1_dedup_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.dedup_alerts(_alerts(events(spark, sf_dir))).select("line", "event_source", "tag")


@query(f"{E}, {ALERTS} SELECT line, e.service, dd.tag FROM e JOIN dd USING (line)")
def h2_join_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return history.join_alerts(e, _alerts(e)).select("line", "service", "tag")


@query(f"""{E}, l AS (SELECT line, 0 AS pos, 0 AS label FROM e WHERE service = 'error' UNION ALL SELECT line, 1, 1 FROM e WHERE seed), d AS (SELECT line, arg_max(label, pos) AS label FROM l GROUP BY line)
SELECT e.line, d.label::INTEGER AS label FROM e LEFT JOIN d USING (line)""")
def h3_join_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    first = e.where("service = 'error'").select("line", F.lit(0).alias("pos"), F.lit(0).alias("label"))
    labels = first.unionByName(e.where("seed").select("line", F.lit(1).alias("pos"), F.lit(1).alias("label")))
    return history.join_labels(e, labels).select("line", "label")


@query(f"{E} SELECT line, (dense_rank() OVER (ORDER BY object) - 1)::INTEGER AS object_cat, (dense_rank() OVER (ORDER BY service) - 1)::INTEGER AS service_cat FROM e")
def h5_category_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.category_codes(events(spark, sf_dir), "object", "object_cat")
    return _ints(history.category_codes(rows, "service", "service_cat"), "object_cat", "service_cat")


@query(f"{K} SELECT line, {COUNTS} FROM y")
def h9_prior_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ints(history.prior_counts(_keys(spark, sf_dir)), *COUNT_NAMES)


FIRST = """f AS (SELECT *, (row_number() OVER (PARTITION BY object, actor ORDER BY us, line) = 1)::INT AS fa, (row_number() OVER (PARTITION BY origin, src ORDER BY us, line) = 1)::INT AS fs FROM y)"""


@query(f"""{K}, {FIRST} SELECT line, (CASE WHEN object <> '' THEN sum(fa) OVER (PARTITION BY object ORDER BY us, line) - fa ELSE 0 END)::INTEGER AS object_actors_prior,
  (CASE WHEN origin <> '' THEN sum(fs) OVER (PARTITION BY origin ORDER BY us, line) - fs ELSE 0 END)::INTEGER AS origin_srcs_prior FROM f""")
def h10_prior_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"object_actors_prior": ("object", "actor", F.col("has_object") == 1), "origin_srcs_prior": ("origin", "src", F.col("has_origin") == 1)}
    return _ints(history.prior_distinct(_keys(spark, sf_dir), wanted), *wanted)


@query(f"""{K}, c AS (SELECT *, {COUNTS} FROM y), n AS (SELECT *, (origin_prior > 0 AND source_origin_prior = 0)::INT AS origin_new_src FROM c)
SELECT line, origin_new_src, (src_prior > 0 AND source_origin_prior = 0 AND origin <> '')::INT AS src_new_origin, (object_prior > 0 AND actor_object_prior = 0 AND object <> '')::INT AS object_new_actor,
  (action_prior > 0 AND actor_action_prior = 0 AND action <> '')::INT AS action_new_actor, (origin <> '' AND origin_new_src = 0)::INT AS source_origin_consistent FROM n""")
def h11_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.novelty(history.prior_counts(_keys(spark, sf_dir)))
    return rows.select("line", "origin_new_src", "src_new_origin", "object_new_actor", "action_new_actor", "source_origin_consistent")


SINCE = "round(coalesce((us - lag(us) OVER (PARTITION BY {0} ORDER BY us, line)) / 1e6, 0), 6)"


@query(f"""{K}, x AS (SELECT *, lag(action) OVER o AS la, lag(actor) OVER o AS lr, lag(service) OVER s AS ls, row_number() OVER s - 1 AS ix, row_number() OVER o - 1 AS op, {SINCE.format("stream")} AS ss, {SINCE.format("ao")} AS sa, {SINCE.format("object")} AS so,
  {SINCE.format("actor")} AS sr FROM y WINDOW o AS (PARTITION BY object ORDER BY us, line), s AS (PARTITION BY stream ORDER BY us, line))
SELECT line, ix::INTEGER AS stream_index, coalesce(ls, '<START>') || '->' || service AS service_transition, CASE WHEN object <> '' THEN coalesce(la, '<START>') || '->' || action ELSE '<NO_OBJECT>' END AS action_transition,
  (object <> '' AND op > 0 AND coalesce(lr <> actor, false))::INT AS actor_changed, ss AS since_stream, CASE WHEN ao <> '' THEN sa ELSE 0 END AS since_actor_object, CASE WHEN object <> '' THEN so ELSE 0 END AS since_object,
  CASE WHEN origin <> '' THEN sr ELSE 0 END AS since_origin_source FROM x""")
def h6_h7_h8_h12_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.transitions(history.prior_counts(_keys(spark, sf_dir)))
    times = ["since_stream", "since_actor_object", "since_object", "since_origin_source"]
    return rows.select("line", F.col("stream_index").cast("int").alias("stream_index"), "service_transition", "action_transition", "actor_changed", *[F.round(t, 6).alias(t) for t in times])


@query(f"""{K}, v AS (SELECT *, coalesce(invoke, -1) AS iv, coalesce(ctl, -1) AS cv, coalesce(seq, -1) AS sv FROM y),
x AS (SELECT *, row_number() OVER (PARTITION BY stream, invoke ORDER BY us, line) AS ri, row_number() OVER (PARTITION BY stream, sv ORDER BY us, line) AS rq, row_number() OVER (PARTITION BY ao, cv ORDER BY us, line) AS rc,
  lag(iv) OVER s AS li, lag(cv) OVER s AS lc, lag(sv) OVER s AS lq, lag(size) OVER s AS lz, lag(cv) OVER (PARTITION BY ao ORDER BY us, line) AS la FROM v WINDOW s AS (PARTITION BY stream ORDER BY us, line))
SELECT line, (invoke IS NOT NULL AND ri > 1)::INT AS invoke_reused, coalesce(iv - li, 0) AS invoke_delta, coalesce(cv - lc, 0) AS ctl_delta, coalesce(sv - lq, 0) AS seq_delta, (seq IS NOT NULL AND rq > 1)::INT AS seq_reused,
  (seq IS NOT NULL AND coalesce(sv < lq, false))::INT AS seq_regression, CASE WHEN ao <> '' THEN coalesce(cv - la, 0) ELSE 0 END AS ctl_delta_actor_object, (ao <> '' AND rc > 1)::INT AS ctl_reused,
  (ao <> '' AND coalesce(cv < la, false))::INT AS ctl_regression, round(coalesce(size - lz, 0), 6) AS size_delta FROM x""")
def h13_h15_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.counters(_keys(spark, sf_dir))
    names = ["invoke_reused", "invoke_delta", "ctl_delta", "seq_delta", "seq_reused", "seq_regression", "ctl_delta_actor_object", "ctl_reused", "ctl_regression"]
    return rows.select("line", *names, F.round("size_delta", 6).alias("size_delta"))


@query(f"""{E}, x AS (SELECT line, stream, coalesce((us - lag(us) OVER (PARTITION BY stream ORDER BY us, line)) / 1e6, 0) AS d FROM e)
SELECT line, round((d - avg(d) OVER w) / (coalesce(stddev_samp(d) OVER w, 0) + 1e-6), 5) AS time_z FROM x WINDOW w AS (PARTITION BY stream)""")
def h16_time_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.time_z(history.transitions(history.prior_counts(_keys(spark, sf_dir))))
    return rows.select("line", F.round("time_z", 5).alias("time_z"))


@query(f"{E} SELECT line, (final_tag <> 'normal')::INT AS heuristic_is_anomaly, CASE WHEN service = 'error' THEN seed::INT ELSE (final_tag <> 'normal')::INT END AS is_anomaly FROM e")
def h17_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("label", F.when(F.col("service") == "error", F.col("seed").cast("int")))
    return history.target(rows, "label").select("line", "heuristic_is_anomaly", "is_anomaly")


@query(f"""{K}, c AS (SELECT *, {COUNTS} FROM y)
SELECT line, round(actor_object_prior / (object_prior + 1), 6) AS actor_object_ratio, round(actor_action_prior / (actor_prior + 1), 6) AS actor_action_ratio,
  round(origin_object_prior / (object_prior + 1), 6) AS origin_object_ratio, round(actor_object_action_prior / (actor_object_prior + 1), 6) AS actor_object_action_ratio FROM c""")
def f20_h18_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["actor_object_ratio", "actor_action_ratio", "origin_object_ratio", "actor_object_action_ratio"]
    rows = history.select_features(history.features(events(spark, sf_dir)), ["line"], names)
    return rows.select("line", *[F.round(n, 6).alias(n) for n in names])


# -- sequence windows ---------------------------------------------------------------------


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("line", "us", F.col("stream").alias("grp"), "ctl", "size", F.col("seed").cast("int").alias("label"))


SIZE, STEP = 4, 2
Q = f"""{E}, x AS (SELECT line, us, stream, ctl, size, seed::INT AS label, row_number() OVER w - 1 AS ix, first_value(line) OVER f AS sl, sum(seed::INT) OVER f AS pos, max(seed::INT) OVER f AS anyl,
  lag(ctl, 3) OVER w AS c3, lag(ctl, 2) OVER w AS c2, lag(ctl) OVER w AS c1, lag(size, 3) OVER w AS z3, lag(size, 2) OVER w AS z2, lag(size) OVER w AS z1
  FROM e WINDOW w AS (PARTITION BY stream ORDER BY us, line), f AS (PARTITION BY stream ORDER BY us, line ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
v AS (SELECT * FROM x WHERE ix >= 3 AND (ix - 3) % 2 = 0)"""


@query(f"{Q} SELECT stream AS grp, (ix - 3)::INTEGER AS start_index, ix::INTEGER AS end_index, sl AS start_line, line AS end_line, us AS end_us, pos::BIGINT AS positives, label FROM v")
def q1_q3_windows_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.windows(_steps(spark, sf_dir), ["ctl", "size"], SIZE, STEP).drop("steps")


@query(f"{Q} SELECT line AS end_line, anyl AS label FROM v")
def q2_windows_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.windows(_steps(spark, sf_dir), ["ctl", "size"], SIZE, STEP, mode="any").select("end_line", "label")


@query(f"{Q} SELECT line AS end_line, c3 AS ctl_t_minus_3, z3 AS size_t_minus_3, c2 AS ctl_t_minus_2, z2 AS size_t_minus_2, c1 AS ctl_t_minus_1, z1 AS size_t_minus_1, ctl AS ctl_t0, size AS size_t0 FROM v")
def q4_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequences.windows(_steps(spark, sf_dir), ["ctl", "size"], SIZE, STEP).select("end_line", "steps")
    return sequences.flatten(found, ["ctl", "size"], SIZE)


@query(f"""{Q}, s AS (SELECT unnest([c3, c2, c1, ctl]) AS ctl, unnest([z3, z2, z1, size]) AS size FROM v)
SELECT 'ctl' AS feature, round(avg(ctl), 6) AS mean, round(stddev_pop(ctl), 6) AS std FROM s UNION ALL SELECT 'size', round(avg(size), 6), round(stddev_pop(size), 6) FROM s""")
def m9_tensor_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequences.windows(_steps(spark, sf_dir), ["ctl", "size"], SIZE, STEP)
    return sequences.tensor_scale(found, ["ctl", "size"]).select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


# -- scenarios -----------------------------------------------------------------------------


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("line", "us", F.col("dst").alias("grp"), "seed")


GAP, PLACES, AROUND = 6 * HOUR, 4, 3 * HOUR
L = f"""{E}, g AS (SELECT line, us, dst AS grp, seed, row_number() OVER (PARTITION BY dst ORDER BY us, line) - 1 AS pos FROM e),
n AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY grp ORDER BY pos) <= {GAP} THEN 0 ELSE 1 END AS new FROM g WHERE seed),
c AS (SELECT *, sum(new) OVER (PARTITION BY grp ORDER BY pos) AS cluster FROM n),
s AS (SELECT grp, cluster, min(pos) AS p0, max(pos) AS p1, min(us) AS u0, max(us) AS u1, count(*) AS seeds, min(line) AS core_start, max(line) AS core_end, row_number() OVER (ORDER BY grp, cluster) AS no FROM c GROUP BY grp, cluster),
m AS (SELECT s.no, g.line, g.us FROM g JOIN s ON g.grp = s.grp AND (g.pos BETWEEN p0 - {PLACES} AND p1 + {PLACES} OR g.us BETWEEN u0 - {AROUND} AND u1 + {AROUND})),
o AS (SELECT c.line, s.no AS seed_no FROM c JOIN s ON c.grp = s.grp AND c.cluster = s.cluster),
last AS (SELECT line, max(no) AS no FROM m GROUP BY line)"""


@query(f"{L} SELECT c.line, c.grp, c.pos::INTEGER AS pos, c.us, c.cluster::BIGINT AS cluster FROM c")
def l1_l2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.clusters(_grouped(spark, sf_dir), GAP)


@query(f"""{L} SELECT g.line, g.grp, g.us, g.seed, (last.no IS NOT NULL)::INT AS is_anomaly, printf('scenario_%04d', last.no) AS scenario,
  CASE WHEN last.no IS NULL THEN 'normal' WHEN seed_no = last.no THEN 'core' ELSE 'context' END AS role FROM g LEFT JOIN last USING (line) LEFT JOIN o USING (line)""")
def l3_l5_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.label(_grouped(spark, sf_dir), GAP, PLACES, AROUND)[0]


@query(f"""{L} SELECT printf('scenario_%04d', s.no) AS scenario, grp, seeds, count(*) AS rows, core_start, core_end, min(m.line) AS window_start, max(m.line) AS window_end, min(m.us) AS start_us, max(m.us) AS end_us,
  (max(m.us) - min(m.us)) / 1e6 AS duration_sec FROM s JOIN m ON s.no = m.no GROUP BY s.no, grp, seeds, core_start, core_end""")
def l6_scenario_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.label(_grouped(spark, sf_dir), GAP, PLACES, AROUND)[1]
