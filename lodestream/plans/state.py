"""Joins, sets, windows, run trees and batch state (JN5-13, SET2-6, GRF1-6, WIN4-11, STM10-30, ARR2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestream.operators import runs as trees, state, windows
from lodestream.plans.registry import Registry
from lodestream.plans.scalar import _KEYS_SPARK, NOW_MS
from lodestream.session import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
_MS = "(epoch_us(ts) // 1000)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


# --- joins and sets ------------------------------------------------------------------------------


@R.add("JN5", "SELECT o_orderkey, coalesce(c_name, 'order-' || o_orderkey) AS key FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def store_resolution(spark, sf_dir):
    """The store's key wins over the discovered one."""
    store = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("store_key"))
    return table(spark, sf_dir, "orders").join(store, "o_custkey", "left").select("o_orderkey", F.coalesce("store_key", F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))).alias("key"))


@R.add("JN6", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def orphan_results(spark, sf_dir):
    kept = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(kept, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@R.add("JN7", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unreferenced(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


def resolve_unique(df: DataFrame, condition, key: str) -> str:
    """The one key that fits; an error names two if there are several, at most two rows reach the driver."""
    found = [r[0] for r in df.filter(condition).select(key).distinct().orderBy(key).limit(2).collect()]
    if len(found) != 1:
        raise LookupError("no session found" if not found else f"several sessions match: {', '.join(map(str, found))}, ...")
    return found[0]


@R.add("JN8", "SELECT c_custkey, c_name FROM customer WHERE c_name = (SELECT min(c_name) FROM customer)")
def unique_match(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = c.agg(F.min("c_name").alias("n")).first()["n"]
    key = resolve_unique(c, F.col("c_name") == name, "c_custkey")
    return c.filter(F.col("c_custkey") == key).select("c_custkey", "c_name")


@R.add("JN10", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 1")
def cache_misses(spark, sf_dir):
    """Wanted composite keys that the cache lacks."""
    li = table(spark, sf_dir, "lineitem")
    cached = li.filter("l_linenumber = 1").select("l_partkey", "l_suppkey")
    return li.select("l_partkey", "l_suppkey").distinct().join(cached, ["l_partkey", "l_suppkey"], "left_anti")


def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs: event n was asked for by event n div 3; errors never end, clicks aren't cleaned up."""
    return events(spark, sf_dir).select(
        F.col("event_id").alias("run_id"), F.floor(F.col("event_id") / 3).cast("long").alias("requester"), F.col("event_id").alias("child"), F.col("ms").alias("created_at"), (F.col("ms") + 1000).alias("started_at"),
        F.when(F.col("event_type") != "error", F.col("ms") + 86_400_000).alias("ended_at"), F.when(~F.col("event_type").isin("error", "click"), F.col("ms") + 86_500_000).alias("cleanup_at"))


_RUNS = f"""r AS (SELECT event_id AS run_id, event_id // 3 AS requester, event_id AS child, {_MS} AS created_at, {_MS} + 1000 AS started_at, CASE WHEN event_type <> 'error' THEN {_MS} + 86400000 END AS ended_at,
    CASE WHEN event_type NOT IN ('error', 'click') THEN {_MS} + 86500000 END AS cleanup_at FROM events)"""
_REACH = f"WITH RECURSIVE {_RUNS}, t(root, session) AS (SELECT x::BIGINT, x::BIGINT FROM unnest([1, 5, 200, 3000]) u(x) UNION SELECT root, child FROM t JOIN r ON requester = session) "


def _roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in (1, 5, 200, 3000)], "root long")


@R.add("GRF1", _REACH + "SELECT root, run_id FROM t JOIN r ON requester = session")
def descendants(spark, sf_dir):
    return trees.descendants(run_table(spark, sf_dir), _roots(spark)).select("root", "run_id")


@R.add("GRF2", _REACH + "SELECT root, count(*) FILTER (WHERE ended_at IS NULL) AS active FROM t JOIN r ON requester = session GROUP BY root")
def active_descendants(spark, sf_dir):
    return trees.counts(run_table(spark, sf_dir), _roots(spark)).filter("descendants > 0").select("root", "active")


_PENDING = "(ended_at IS NULL OR cleanup_at IS NULL OR cleanup_at < ended_at)"


@R.add("GRF3", _REACH + f"SELECT root, count(*) FILTER (WHERE {_PENDING} AND run_id <> 16) AS pending FROM t JOIN r ON requester = session GROUP BY root")
def pending_descendants(spark, sf_dir):
    return trees.counts(run_table(spark, sf_dir), _roots(spark), excluded_run=16).filter("descendants > 0").select("root", "pending")


@R.add("GRF4", f"WITH RECURSIVE {_RUNS}, d AS (SELECT DISTINCT requester AS root, child, ended_at FROM r WHERE requester IN (1, 5, 200, 3000)), t(root, session) AS (SELECT child, child FROM d UNION SELECT root, child FROM t JOIN r ON requester = session), p AS (SELECT root, count(*) FILTER (WHERE {_PENDING}) AS n FROM t JOIN r ON requester = session GROUP BY root)"
    " SELECT d.root, count(*) FILTER (WHERE ended_at IS NULL OR coalesce(n, 0) > 0) AS active_direct FROM d LEFT JOIN p ON p.root = child GROUP BY d.root")
def active_direct(spark, sf_dir):
    found = trees.active_direct(run_table(spark, sf_dir), _roots(spark))
    return found.join(run_table(spark, sf_dir).select(F.col("requester").alias("root")).distinct(), "root", "left_semi")


def _repeated_runs(spark, sf_dir):
    return run_table(spark, sf_dir).withColumn("child", F.col("run_id") % 500)


@R.add("GRF5", f"WITH {_RUNS}, q AS (SELECT *, run_id % 500 AS c, row_number() OVER (PARTITION BY run_id % 500 ORDER BY created_at DESC, run_id) AS n FROM r) SELECT c AS child, run_id, requester, coalesce(cleanup_at >= ended_at, false) AS settled FROM q WHERE n = 1")
def latest_run(spark, sf_dir):
    return trees.latest_per_child(_repeated_runs(spark, sf_dir))


@R.add("GRF6", "SELECT event_id AS run_id FROM events WHERE event_id % 500 = 77")
def runs_by_child(spark, sf_dir):
    return trees.runs_of_child(_repeated_runs(spark, sf_dir), 77).select("run_id")


@R.add("JN11", f"WITH {_RUNS} SELECT p.run_id AS parent_run, c.run_id AS child_run FROM r p JOIN r c ON c.requester = p.child WHERE c.created_at >= coalesce(p.started_at, p.created_at) AND (p.ended_at IS NULL OR c.created_at <= p.ended_at)")
def children_in_time(spark, sf_dir):
    r = run_table(spark, sf_dir)
    return trees.children_in_time(r, r)


@R.add("JN12", f"""WITH i AS (SELECT event_id, user_id, value, {_MS} AS at, (event_id % 40)::VARCHAR AS mid, (event_id % 13)::VARCHAR AS body FROM events WHERE event_type = 'click'), o AS (SELECT user_id, {_MS} AS at, (event_id % 40)::VARCHAR AS mid, (event_id % 13)::VARCHAR AS body FROM events WHERE event_type = 'view')
    SELECT event_id AS in_id FROM i WHERE EXISTS (SELECT 1 FROM o WHERE o.user_id = i.user_id AND o.mid = i.mid AND i.at - o.at BETWEEN 0 AND 86400000) OR EXISTS (SELECT 1 FROM o WHERE o.user_id = i.user_id AND o.body = i.body AND i.at - o.at BETWEEN 0 AND 7200000)""")
def echo_join(spark, sf_dir):
    e = events(spark, sf_dir)
    rows = lambda kind: e.filter(F.col("event_type") == kind).select(F.col("event_id").alias("in_id"), F.col("user_id").alias("scope"), (F.col("event_id") % 13).cast("string").alias("text"), (F.col("event_id") % 40).cast("string").alias("message_id"), F.col("ms").alias("at"))
    return state.echoes(rows("click"), rows("view"), 86_400_000, 7_200_000).select("in_id")


@R.add("JN13", "SELECT n_nationkey, coalesce(s, 'missing') AS status FROM nation LEFT JOIN (SELECT s_nationkey, 'ok' AS s FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON n_nationkey = s_nationkey")
def required_keys(spark, sf_dir):
    found = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("status", F.lit("ok"))
    return state.with_required(table(spark, sf_dir, "nation").select("n_nationkey"), found, "n_nationkey", "status")


@R.add("SET2", "SELECT c_custkey AS id, 'customer' AS store FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def union_all(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("store")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("store")))


@R.add("SET3", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_wins(spark, sf_dir):
    """The first row of each key: a minimum of (time, id), combined before the shuffle."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("user_id", F.col("f.event_id").alias("event_id"))


@R.add("SET4", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'admin ' || c_mktsegment ELSE 'admin' END AS roles FROM customer")
def role_union(spark, sf_dir):
    merged = F.concat(F.array(F.lit(" admin "), F.lit("")), F.when(F.col("c_custkey") % 2 == 0, F.array(F.col("c_mktsegment"), F.lit("admin"))).otherwise(F.array(F.lit("admin"))))
    clean = F.filter(F.transform(merged, lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_distinct(clean), " ").alias("roles"))


@R.add("SET6", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'extra' ELSE 'extra,' || event_type END AS unknown FROM events")
def unknown_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_except(F.array(F.lit("extra"), F.col("event_type")), F.array(F.lit("view"), F.lit("limit"))), ",").alias("unknown"))


# --- windows -------------------------------------------------------------------------------------


@R.add("WIN4", f"SELECT event_id FROM (SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS s FROM events) WHERE s <= 500")
def suffix_budget(spark, sf_dir):
    return windows.newest_within(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], F.col("value"), 500).select("event_id")


@R.add("WIN5", "WITH u AS (SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS u FROM conversations), m AS (SELECT *, max(u) OVER (PARTITION BY conv_id) AS n FROM u) SELECT conv_id, turn FROM m WHERE n < 2 OR u > n - 2")
def last_turns(spark, sf_dir):
    return windows.last_user_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn")


@R.add("WIN7", """SELECT conv_id, turn, s > 400 AS too_large FROM (SELECT conv_id, turn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE s <= 400 OR n = 1""")
def byte_cap(spark, sf_dir):
    return windows.byte_capped(table(spark, sf_dir, "conversations"), "conv_id", [F.desc("turn")], F.octet_length("text"), 400).select("conv_id", "turn", "too_large")


@R.add("WIN8", "SELECT conv_id, turn, CAST(least(2, floor(3 * b / greatest(t, 1))) AS INTEGER) AS part FROM (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS b, sum(length(text)) OVER (PARTITION BY conv_id)::DOUBLE AS t FROM conversations)")
def equal_split(spark, sf_dir):
    return windows.equal_shares(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], F.length("text"), 3).select("conv_id", "turn", "part")


_STREAK = "WITH i AS (SELECT event_id, user_id, ts, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events), s AS (SELECT *, sum(bad::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM i) "


@R.add("WIN9", _STREAK + "SELECT event_id, streak FROM s")
def streaks(spark, sf_dir):
    return windows.failure_streak(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "streak")


@R.add("WIN10", _STREAK.replace("WITH i", "WITH RECURSIVE i", 1) + """, r AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, streak, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM s WHERE streak >= 2),
    a AS (SELECT user_id, n, ms, streak, ms AS last, true AS fired FROM r WHERE n = 1 UNION ALL
      SELECT r.user_id, r.n, r.ms, r.streak, CASE WHEN r.ms - last >= 3600000 THEN r.ms ELSE last END, r.ms - last >= 3600000 FROM a JOIN r ON r.user_id = a.user_id AND r.n = a.n + 1)
    SELECT user_id, ms, streak FROM a WHERE fired""")
def alerts(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("failed", F.col("event_type") == "error").withColumn("place", F.concat_ws("-", F.lpad(F.col("ms").cast("string"), 16, "0"), F.lpad(F.col("event_id").cast("string"), 12, "0")))
    return windows.failure_alerts(e, "user_id", "place", "ms", "failed", 2, 3_600_000).select("user_id", "ms", "streak")


@R.add("WIN11", "WITH k AS (SELECT * FROM (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type) SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM k) WHERE n <= 20")
def no_repeats(spark, sf_dir):
    return windows.without_repeats(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", 20).select("event_id")


# --- batch state ---------------------------------------------------------------------------------


@R.add("STM10", f"WITH u AS (SELECT user_id, max({_MS}) AS m FROM events GROUP BY 1) SELECT user_id, NOT (m < 1706587200000 OR 1706601600000 > m + 480 * 60000) AS fresh FROM u")
def freshness(spark, sf_dir):
    u = events(spark, sf_dir).groupBy("user_id").agg(F.max("ms").alias("m"))
    return u.select("user_id", state.fresh(F.col("m"), F.lit(1_706_601_600_000), state.ResetPolicy("daily", 4, 480)).alias("fresh"))


@R.add("STM11", "SELECT * FROM (VALUES ('direct', 'idle', 4, 30), ('group', 'daily', 6, 90), ('thread', 'daily', 6, 15)) t(kind, mode, at_hour, idle_minutes)")
def policies(spark, sf_dir):
    by_type, base = {"dm": {"mode": "idle", "atHour": 4, "idleMinutes": 30.7}, "thread": {"idleMinutes": 15}}, {"atHour": 6, "idleMinutes": 90}
    made = [(k, state.reset_policy(k, by_type, base)) for k in ("direct", "group", "thread")]
    return spark.createDataFrame([(k, p.mode, p.at_hour, p.idle_minutes) for k, p in made], "kind string, mode string, at_hour int, idle_minutes int")


@R.add("STM12", f"""WITH l AS (SELECT event_id, user_id, {_MS} AS ms, lag({_MS}) OVER (PARTITION BY user_id ORDER BY {_MS}, event_id) AS p FROM events), s AS (SELECT *, CASE WHEN p IS NULL OR ms > p + 43200000 OR p < CAST(floor((ms - 14400000) / 86400000.0::DOUBLE) AS BIGINT) * 86400000 + 14400000 THEN 1 ELSE 0 END AS n FROM l)
    SELECT event_id, sum(n) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM s""")
def sessions(spark, sf_dir):
    return state.sessionize(events(spark, sf_dir), "user_id", "ms", "event_id", state.ResetPolicy("daily", 4, 720)).select("event_id", "session")


@R.add("STM17", f"SELECT event_id FROM events WHERE event_type <> 'purchase' OR {_MS} >= {NOW_MS} - 10 * 86400000")
def swept(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("key", F.expr(_KEYS_SPARK))
    return state.sweep(e, F.col("key"), "ms", NOW_MS, 10 * 86_400_000).select("event_id")


@R.add("STM18", f"SELECT event_id FROM events WHERE {_MS} >= {NOW_MS} - 15 * 86400000")
def pruned(spark, sf_dir):
    return state.retained(events(spark, sf_dir), "ms", NOW_MS, 15 * 86_400_000).select("event_id")


@R.add("STM19", f"""WITH t AS (SELECT user_id, sum(value) AS total FROM events GROUP BY 1), f AS (SELECT e.*, total, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY {_MS}, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM events e JOIN t USING (user_id) WHERE total > 1000 AND event_type <> 'purchase')
    SELECT event_id FROM f WHERE total - b > 800""")
def evictions(spark, sf_dir):
    e = events(spark, sf_dir)
    return state.evicted(e, "user_id", "ms", "value", 1000, 800, e.filter("event_type = 'purchase' OR event_type IS NULL"), "event_id").select("event_id")


@R.add("STM20", f"""SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'unmanaged' WHEN event_id % 13 = 0 THEN 'not-running' WHEN event_type = 'purchase' AND event_id % 2 = 0 AND 1705276800000 - {_MS} < 1500000 THEN 'busy' WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'stuck'
      WHEN 1705276800000 - ({_MS} - 3600000 * (event_id % 2)) < 120000 THEN 'startup-connect-grace' WHEN event_type = 'error' THEN 'disconnected' WHEN event_type <> 'signup' AND 1705276800000 - {_MS} > 1800000 AND 1705276800000 - ({_MS} - 3600000 * (event_id % 2)) > 1800000 THEN 'stale-socket' ELSE 'healthy' END AS reason FROM events""")
def health(spark, sf_dir):
    e = events(spark, sf_dir)
    even = F.col("event_id") % 2 == 0
    start = F.col("ms") - 3_600_000 * (F.col("event_id") % 2)
    s = {"managed": F.col("event_id") % 17 != 0, "running": F.col("event_id") % 13 != 0, "connected": F.col("event_type") != "error", "busy": (F.col("event_type") == "purchase") & even, "active_runs": F.lit(None).cast("int"),
         "last_run_ms": F.when(F.col("event_type") == "purchase", F.col("ms")), "last_event_ms": F.col("ms"), "last_start_ms": start, "polling": F.col("event_type") == "signup"}
    return e.select("event_id", state.channel_health(F.lit(1_705_276_800_000), s).alias("reason"))


@R.add("STM24", f"SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_MS} DESC, event_id DESC) AS n FROM events WHERE event_type <> 'error') WHERE n = 1")
def usage_snapshot(spark, sf_dir):
    """The last call's usage of each session, as an upsert would leave it."""
    last = F.max(F.struct("ms", "event_id", "value"))
    return events(spark, sf_dir).filter("event_type <> 'error'").groupBy("user_id").agg(last.alias("l")).select("user_id", F.col("l.event_id").alias("event_id"), F.col("l.value").alias("value"))


@R.add("STM25", f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY {_MS} RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW) AS hits, count(*) OVER (PARTITION BY user_id ORDER BY {_MS} RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW) >= 5 AS limited FROM events")
def sliding_hits(spark, sf_dir):
    return state.hits_in_window(events(spark, sf_dir), "user_id", "ms", 86_400_000, 5).select("event_id", "hits", "limited")


@R.add("STM26", f"SELECT user_id, max({_MS}) FILTER (WHERE event_type = 'click') AS last_in, max({_MS}) FILTER (WHERE event_type = 'view') AS last_out FROM events GROUP BY 1")
def last_activity(spark, sf_dir):
    of = lambda t: F.max(F.when(F.col("event_type") == t, F.col("ms")))
    return events(spark, sf_dir).groupBy("user_id").agg(of("click").alias("last_in"), of("view").alias("last_out"))


@R.add("STM29", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS short_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE true QUALIFY n <= 30")
def short_ids(spark, sf_dir):
    """A counter for each message of an account; only the newest thirty are still cached."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    e = events(spark, sf_dir).withColumns({"short_id": F.row_number().over(w.orderBy("ts", "event_id")), "n": F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id")))})
    return e.filter("n <= 30").select("event_id", "short_id")


@R.add("STM30", f"""WITH a AS (SELECT user_id AS run_id, max_by((({_MS}), CASE WHEN value > 100 THEN 'running' ELSE 'done' END), ({_MS}, event_id)) AS a FROM events WHERE event_type = 'view' GROUP BY 1), c AS (SELECT user_id AS run_id, max_by((({_MS}), 'done'), ({_MS}, event_id)) AS c FROM events WHERE event_type = 'click' GROUP BY 1),
    b AS (SELECT run_id, a[1] AS a_at, a[2] AS a_s, c[1] AS c_at, c[2] AS c_s, a IS NULL OR coalesce(c[1] > a[1], false) AS chat FROM a FULL JOIN c USING (run_id))
    SELECT run_id, CASE WHEN chat THEN 'chat' ELSE 'agent' END AS source, CASE WHEN chat THEN c_at ELSE a_at END AS at, CASE WHEN chat THEN c_s WHEN a_s = 'running' THEN 'pending' ELSE a_s END AS status FROM b""")
def reconciled(spark, sf_dir):
    e = events(spark, sf_dir)
    newest = lambda kind, status: e.filter(F.col("event_type") == kind).groupBy(F.col("user_id").alias("run_id")).agg(F.max_by(F.struct(F.col("ms").alias("at"), status.alias("status")), F.struct("ms", "event_id")).alias("s")).select("run_id", "s.at", "s.status")
    return state.reconciled(newest("view", F.when(F.col("value") > 100, "running").otherwise("done")), newest("click", F.lit("done")))


@R.add("ARR2", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def capped_map(spark, sf_dir):
    """The newest five entries of each key; older insertions are evicted."""
    from lodestream.operators.rollups import top_per_group

    return top_per_group(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")], 5).select("event_id")
