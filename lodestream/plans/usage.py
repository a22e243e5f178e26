"""Usage, cost and run-report queries (AGG*, WIN1-3, JN3-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestream.functions import text
from lodestream.operators import rollups
from lodestream.plans.registry import Registry
from lodestream.session import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def run_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished runs from the event stream: job, model, and token counts from the JSON payload."""
    tokens = F.get_json_object("props", "$.k").cast("double")
    counted = lambda c: F.when((F.col("event_id") % 7 != 0) & c.isNotNull(), F.greatest(F.lit(0.0), F.floor(c)))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"),
        F.coalesce(F.nullif(F.trim("event_type"), F.lit("")), F.lit("<unknown>")).alias("model"),
        "ts",
        counted(tokens).alias("input_tokens"),
        counted(F.col("value")).alias("output_tokens"),
    )


@R.add(
    "AGG1",
    """
    WITH f AS (SELECT user_id AS job_id, coalesce(nullif(trim(event_type), ''), '<unknown>') AS model,
        CASE WHEN event_id % 7 <> 0 THEN greatest(0.0, floor(CAST(json_extract_string(props, '$.k') AS DOUBLE))) END AS i,
        CASE WHEN event_id % 7 <> 0 THEN greatest(0.0, floor(value)) END AS o FROM events)
    SELECT job_id, model, count(*) AS runs, CAST(sum(coalesce(i, 0)) AS BIGINT) AS input_tokens,
        CAST(sum(coalesce(o, 0)) AS BIGINT) AS output_tokens,
        CAST(sum(coalesce(i, 0) + coalesce(o, 0)) AS BIGINT) AS total_tokens,
        count(*) FILTER (WHERE coalesce(i, o) IS NULL) AS missing_usage_runs
    FROM f GROUP BY GROUPING SETS ((job_id, model), (job_id))
    """,
)
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both levels of the run report in one scan and one shuffle; a null model is the job's own row."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return (
        run_facts(spark, sf_dir)
        .groupingSets([["job_id", "model"], ["job_id"]], "job_id", "model")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.sum(zero("input_tokens")).cast("long").alias("input_tokens"),
            F.sum(zero("output_tokens")).cast("long").alias("output_tokens"),
            F.sum(zero("input_tokens") + zero("output_tokens")).cast("long").alias("total_tokens"),
            F.count_if(F.coalesce("input_tokens", "output_tokens").isNull()).alias("missing_usage_runs"),
        )
    )


@R.add("AGG2", "SELECT user_id AS job_id, count(*) FILTER (WHERE event_id % 7 = 0) AS missing, count(*) AS runs FROM events GROUP BY 1")
def missing_usage(spark, sf_dir):
    return run_facts(spark, sf_dir).groupBy("job_id").agg(F.count_if(F.coalesce("input_tokens", "output_tokens").isNull()).alias("missing"), F.count(F.lit(1)).alias("runs"))


def message_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event as a message: day, model, provider, agent, channel, measures and costs; every 11th has no cost."""
    k = F.get_json_object("props", "$.k").cast("double")
    priced = F.when(F.col("event_id") % 11 != 0, 1.0)
    e = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("session"), (F.col("user_id") % 7).alias("agent"), (F.col("user_id") % 3).alias("channel"), F.col("event_type").alias("model"),
        F.when(F.col("event_type").isin("view", "click"), "p1").otherwise("p2").alias("provider"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        k.alias("input"), F.floor("value").cast("double").alias("output"), (F.col("event_id") % 5).cast("double").alias("cache_read"), F.lit(1.0).alias("cache_write"), F.col("value").alias("duration"), priced.alias("priced"),
    )
    priced_at = lambda c, p: F.col("priced") * F.col(c) * p
    e = e.withColumn("total_tokens", F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write"))
    e = e.withColumns({"input_cost": priced_at("input", 0.5), "output_cost": priced_at("output", 2.0), "cache_read_cost": priced_at("cache_read", 0.25), "cache_write_cost": priced_at("cache_write", 1.0)})
    return e.withColumn("total_cost", F.col("input_cost") + F.col("output_cost") + F.col("cache_read_cost") + F.col("cache_write_cost"))


_FACTS = """WITH m AS (SELECT event_id, user_id AS session, user_id % 7 AS agent, user_id % 3 AS channel, event_type AS model, CASE WHEN event_type IN ('view', 'click') THEN 'p1' ELSE 'p2' END AS provider,
    strftime(ts, '%Y-%m-%d') AS date, (epoch_us(ts) // 1000) AS ts_ms, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS input, floor(value) AS output, CAST(event_id % 5 AS DOUBLE) AS cache_read, 1.0::DOUBLE AS cache_write, value AS duration,
    CASE WHEN event_id % 11 <> 0 THEN 1.0::DOUBLE END AS priced FROM events),
  n AS (SELECT *, input + output + cache_read + cache_write AS total_tokens, priced * input * 0.5::DOUBLE AS input_cost, priced * output * 2 AS output_cost, priced * cache_read * 0.25::DOUBLE AS cache_read_cost, priced * cache_write AS cache_write_cost FROM m),
  f AS (SELECT *, input_cost + output_cost + cache_read_cost + cache_write_cost AS total_cost FROM n) """
_TOTALS = ", ".join(f"round(sum(coalesce({m}, 0)), 4) AS {m}" for m in rollups.MEASURES) + ", count(*) FILTER (WHERE total_cost IS NULL) AS missing_cost"


@R.add("AGG3", f"{_FACTS} SELECT {_TOTALS} FROM f")
def cost_totals(spark, sf_dir):
    return rollups.rollup(message_facts(spark, sf_dir))


@R.add("AGG4", f"{_FACTS} SELECT date, {_TOTALS} FROM f GROUP BY date")
def daily_cost(spark, sf_dir):
    return rollups.rollup(message_facts(spark, sf_dir), "date")


@R.add("AGG5", """SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS total, count(*) FILTER (WHERE event_type = 'view') AS user_messages, count(*) FILTER (WHERE event_type = 'click') AS assistant_messages,
    count(*) FILTER (WHERE event_type = 'purchase') AS tool_calls, count(*) FILTER (WHERE event_type = 'signup') AS tool_results, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1""")
def daily_messages(spark, sf_dir):
    of = lambda t, n: F.count_if(F.col("event_type") == t).alias(n)
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(
        F.count(F.lit(1)).alias("total"), of("view", "user_messages"), of("click", "assistant_messages"), of("purchase", "tool_calls"), of("signup", "tool_results"), of("error", "errors"))


@R.add("AGG6", f"{_FACTS} SELECT provider, model, count(*) AS n, {_TOTALS} FROM f GROUP BY provider, model")
def model_usage(spark, sf_dir):
    return message_facts(spark, sf_dir).groupBy("provider", "model").agg(F.count(F.lit(1)).alias("n"), *rollups.totals())


@R.add("AGG7", f"{_FACTS} SELECT date, provider, model, count(*) AS n, round(sum(total_tokens), 4) AS tokens, round(sum(coalesce(total_cost, 0)), 4) AS cost FROM f GROUP BY date, provider, model")
def daily_model_usage(spark, sf_dir):
    return message_facts(spark, sf_dir).groupBy("date", "provider", "model").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("total_tokens"), 4).alias("tokens"), F.round(F.sum(F.coalesce("total_cost", F.lit(0.0))), 4).alias("cost"))


@R.add("AGG8", """WITH t AS (SELECT user_id, unnest(['tool_' || event_type, 'tool_' || (event_id % 4)]) AS tool FROM events)
    SELECT user_id, tool, count(*) AS calls, sum(count(*)) OVER (PARTITION BY user_id)::BIGINT AS total_calls, count(*) OVER (PARTITION BY user_id) AS unique_tools FROM t GROUP BY user_id, tool""")
def tool_usage(spark, sf_dir):
    """Per-tool counts first, totals over those few rows after."""
    from pyspark.sql import Window

    tools = F.explode(F.array(F.concat(F.lit("tool_"), "event_type"), F.concat(F.lit("tool_"), (F.col("event_id") % 4).cast("string"))))
    each = table(spark, sf_dir, "events").select("user_id", tools.alias("tool")).groupBy("user_id", "tool").agg(F.count(F.lit(1)).alias("calls"))
    w = Window.partitionBy("user_id")
    return each.select("user_id", "tool", "calls", F.sum("calls").over(w).alias("total_calls"), F.count(F.lit(1)).over(w).alias("unique_tools"))


_P95 = "list_sort(list(duration))[least(count(*), CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1)]"


@R.add("AGG9", f"{_FACTS} SELECT model, count(*) AS n, round(avg(duration), 4) AS avg_ms, min(duration) AS min_ms, max(duration) AS max_ms, {_P95} AS p95_ms FROM f GROUP BY model")
def latency_stats(spark, sf_dir):
    return rollups.latency(message_facts(spark, sf_dir), ["model"], "duration")


_PARTIALS = f"{_FACTS}, p AS (SELECT session, model, date, count(*) AS n, round(avg(duration), 4) AS a, min(duration) AS lo, max(duration) AS hi, {_P95} AS p95 FROM f GROUP BY session, model, date)"


@R.add("AGG10", f"{_PARTIALS} SELECT model, sum(n)::BIGINT AS n, round(CAST(sum(CAST(a * n AS DECIMAL(28, 6))) AS DOUBLE) / sum(n), 4) AS avg_ms, min(lo) AS min_ms, max(hi) AS max_ms, max(p95) AS p95_max_ms FROM p GROUP BY model")
def merged_latency(spark, sf_dir):
    return rollups.merge_latency(rollups.latency(message_facts(spark, sf_dir), ["session", "model", "date"], "duration"), ["model"])


@R.add("AGG11", f"{_PARTIALS} SELECT date, sum(n)::BIGINT AS n, round(CAST(sum(CAST(a * n AS DECIMAL(28, 6))) AS DOUBLE) / sum(n), 4) AS avg_ms, min(lo) AS min_ms, max(hi) AS max_ms, max(p95) AS p95_max_ms FROM p GROUP BY date")
def merged_daily_latency(spark, sf_dir):
    return rollups.merge_latency(rollups.latency(message_facts(spark, sf_dir), ["session", "model", "date"], "duration"), ["date"])


@R.add("AGG12", f"{_FACTS} SELECT channel, round(sum(coalesce(total_cost, 0)), 4) AS total_cost, CASE WHEN count(duration) > 0 THEN round(avg(duration), 4) END AS avg_ms, coalesce(min(duration), 0) AS min_ms, row_number() OVER (ORDER BY round(sum(coalesce(total_cost, 0)), 4) DESC, channel) AS place FROM f GROUP BY channel")
def aggregate_tail(spark, sf_dir):
    """Channels by falling cost; an empty latency is null and its minimum 0. The places are numbered after the rows are few."""
    from pyspark.sql import Window

    by = message_facts(spark, sf_dir).groupBy("channel").agg(
        F.round(F.sum(F.coalesce("total_cost", F.lit(0.0))), 4).alias("total_cost"), F.when(F.count("duration") > 0, F.round(F.avg("duration"), 4)).alias("avg_ms"), F.coalesce(F.min("duration"), F.lit(0.0)).alias("min_ms"))
    return by.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total_cost"), "channel")).cast("long"))


@R.add("AGG13", _FACTS + " ".join(["SELECT * FROM ("] + [" UNION ALL ".join(f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, count(*) AS n, round(sum(total_tokens), 2) AS total_tokens, round(sum(total_cost), 2) AS total_cost FROM f GROUP BY {d}" for d in ("model", "provider", "agent", "channel", "date"))] + [")"]))
def rollup_bundle(spark, sf_dir):
    return rollups.bundle(message_facts(spark, sf_dir), ["model", "provider", "agent", "channel", "date"])


@R.add("AGG14", f"{_FACTS} SELECT session, round(sum(total_tokens), 4) AS total_tokens, round(sum(total_cost), 4) AS total_cost, count(*) FILTER (WHERE input > 0) AS user_messages, count(*) FILTER (WHERE output > 0) AS assistant_messages, max(ts_ms) - min(ts_ms) AS duration_ms FROM f WHERE ts_ms BETWEEN 1704844800000 AND 1705276800000 GROUP BY session")
def range_totals(spark, sf_dir):
    return rollups.range_totals(message_facts(spark, sf_dir), 1705276800000, 1704844800000, "session")


_BLOCKS = """[{'type': 'tool_use', 'is_error': false, 'name': 'read'}, {'type': 'tool_result', 'is_error': turn % 2 = 0, 'name': ''}, {'type': CASE WHEN turn % 3 = 0 THEN 'tool_result_error' ELSE 'text' END, 'is_error': false, 'name': ''}, {'type': 'toolcall', 'is_error': false, 'name': CASE WHEN turn % 2 = 0 THEN ' read ' ELSE 'exec' END}]"""


def message_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a block array as a transcript has them."""
    block = lambda t, err, name: F.struct(t.alias("type"), err.alias("is_error"), name.alias("name"))
    no, blank = F.lit(False), F.lit("")
    blocks = F.array(
        block(F.lit("tool_use"), no, F.lit("read")), block(F.lit("tool_result"), F.col("turn") % 2 == 0, blank),
        block(F.when(F.col("turn") % 3 == 0, "tool_result_error").otherwise("text"), no, blank), block(F.lit("toolcall"), no, F.when(F.col("turn") % 2 == 0, " read ").otherwise("exec")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", blocks.alias("blocks"))


@R.add("AGG15", "SELECT conv_id, turn, CAST(CASE WHEN turn % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS results, CAST(CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS errors FROM conversations")
def tool_results(spark, sf_dir):
    results = F.filter("blocks", lambda b: b["type"].isin("tool_result", "tool_result_error"))
    return message_blocks(spark, sf_dir).select("conv_id", "turn", F.size(results).alias("results"), F.size(F.filter(results, lambda b: b["is_error"] | (b["type"] == "tool_result_error"))).alias("errors"))


@R.add("AGG16", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'read' ELSE 'read,exec' END AS tools FROM conversations")
def tool_names(spark, sf_dir):
    named = F.transform(F.filter("blocks", lambda b: b["type"].isin("tool_use", "toolcall", "tool_call")), lambda b: F.trim(b["name"]))
    return message_blocks(spark, sf_dir).select("conv_id", "turn", F.array_join(F.array_distinct(F.filter(named, lambda n: n != "")), ",").alias("tools"))


@R.add("AGG17", """SELECT conv_id, tool, CAST(sum(n) AS BIGINT) AS calls FROM (SELECT conv_id, unnest(['read', 'exec']) AS tool, unnest([2, 1]) AS n FROM conversations) GROUP BY conv_id, tool""")
def tool_summary(spark, sf_dir):
    log = F.concat(F.lit("[Tool: read] a\n"), "text", F.lit("\n  [Tool: read]\n[Tool Result] ok\n[Tool: exec]"))
    return table(spark, sf_dir, "conversations").select("conv_id", F.explode(text.tool_counts(log)).alias("tool")).groupBy("conv_id", "tool").agg(F.count(F.lit(1)).alias("calls"))


@R.add("AGG18", "SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS users, count(*) FILTER (WHERE role = 'assistant') AS assistants, min(turn) AS first_turn, max(turn) AS last_turn, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def session_recipes(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars"))


@R.add("AGG19", "SELECT o_custkey, o_orderkey, n FROM (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r <= 10")
def recent_per_agent(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    top = rollups.top_per_group(orders, "o_custkey", [F.desc("o_orderdate"), F.asc("o_orderkey")], 10)
    return top.join(orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), "o_custkey").select("o_custkey", "o_orderkey", "n")


@R.add("AGG20", "SELECT l_orderkey, l_linenumber AS top_line, l_quantity AS top_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1")
def highest_window(spark, sf_dir):
    """The row of the largest value, the first one on a tie: a maximum of (value, negated ordinal), no window."""
    best = F.max(F.struct(F.col("l_quantity"), (-F.col("l_linenumber")).alias("o")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(best.alias("b")).select("l_orderkey", (-F.col("b.o")).alias("top_line"), F.col("b.l_quantity").alias("top_quantity"))


@R.add("AGG21", f"{_FACTS} SELECT session, median(duration) AS median, list_sort(list(duration))[least(count(*), CAST(floor(count(*) * 0.5::DOUBLE) AS BIGINT) + 1)] AS p50, {_P95} AS p95 FROM f GROUP BY session")
def medians(spark, sf_dir):
    facts = message_facts(spark, sf_dir)
    rank = lambda share, name: rollups.nearest_rank(facts, ["session"], "duration", share).withColumnRenamed("percentile", name)
    return facts.groupBy("session").agg(F.median("duration").alias("median")).join(rank(0.5, "p50"), "session").join(rank(0.95, "p95"), "session")


@R.add("AGG22", f"{_FACTS} SELECT model, CAST(channel AS VARCHAR) AS code, count(*) AS n, round(avg(duration), 4) AS avg, list_sort(list(duration))[least(count(*), CAST(floor(count(*) * 0.5::DOUBLE) AS BIGINT) + 1)] AS p50, {_P95} AS p95, min(duration) AS low, max(duration) AS high FROM f GROUP BY model, channel")
def samples(spark, sf_dir):
    facts, by = message_facts(spark, sf_dir).withColumn("code", F.col("channel").cast("string")), ["model", "code"]
    rank = lambda share, name: rollups.nearest_rank(facts, by, "duration", share).withColumnRenamed("percentile", name)
    basic = facts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("duration"), 4).alias("avg"), F.min("duration").alias("low"), F.max("duration").alias("high"))
    return basic.join(rank(0.5, "p50"), by).join(rank(0.95, "p95"), by)


@R.add("AGG23", "SELECT event_id, value, round((SELECT sum(value) FROM events), 2) AS total FROM events ORDER BY value DESC, event_id LIMIT 20")
def hotspots(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return e.orderBy(F.desc("value"), "event_id").limit(20).join(F.broadcast(e.agg(F.round(F.sum("value"), 2).alias("total"))))


@R.add("AGG24", """WITH v AS (SELECT c_custkey, list_distinct(list_filter([c_custkey % 4, c_nationkey % 6, c_custkey % 4], lambda x: x < 4)[1:2]) AS s FROM customer)
    SELECT choice, count(*) AS votes FROM (SELECT unnest(s) AS choice FROM v) GROUP BY choice""")
def poll_tally(spark, sf_dir):
    """Selections of four options, out-of-range ones dropped, at most two, each counted once."""
    picked = F.array(F.col("c_custkey") % 4, (F.col("c_nationkey") % 6).cast("long"), F.col("c_custkey") % 4)
    own = F.array_distinct(F.slice(F.filter(picked, lambda x: x < 4), 1, 2))
    return table(spark, sf_dir, "customer").select(F.explode(own).alias("choice")).groupBy("choice").agg(F.count(F.lit(1)).alias("votes"))


@R.add("AGG25", "SELECT source, count(*) AS files, sum(len(string_split(text, chr(10))))::BIGINT AS chunks FROM documents GROUP BY source")
def index_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(F.size(F.split("text", "\n"))).alias("chunks"))


@R.add("AGG26", f"{_FACTS}, d AS (SELECT session, date, model, round(sum(coalesce(total_cost, 0)), 4) AS cost FROM f GROUP BY session, date, model) SELECT session, date, model FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY date DESC, cost DESC, model) AS r FROM d) WHERE r = 1")
def latest_top_model(spark, sf_dir):
    """Of each session's newest day the model of the highest cost."""
    daily = message_facts(spark, sf_dir).groupBy("session", "date", "model").agg(F.round(F.sum(F.coalesce("total_cost", F.lit(0.0))), 4).alias("cost"))
    return rollups.top_per_group(daily, "session", [F.desc("date"), F.desc("cost"), F.asc("model")], 1).select("session", "date", "model")


@R.add("AGG27", "SELECT c_mktsegment AS channel, c_nationkey AS agent, count(DISTINCT c_custkey) AS accounts FROM customer GROUP BY 1, 2")
def channel_accounts(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("channel"), F.col("c_nationkey").alias("agent")).agg(F.size(F.collect_set("c_custkey")).cast("long").alias("accounts"))


@R.add("AGG28", """SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') = count(*) THEN 'static' WHEN bool_or(event_type = 'error' AND value > 150) THEN 'expired' WHEN bool_or(event_type = 'error') THEN 'expiring' ELSE 'ok' END AS status, min((epoch_us(ts) // 1000)) AS first_expiry FROM events GROUP BY user_id""")
def worst_status(spark, sf_dir):
    """The worst status of a provider's credentials; static if all are keys that don't expire."""
    error = F.col("event_type") == "error"
    status = F.when(F.count_if(F.col("event_type") == "purchase") == F.count(F.lit(1)), "static").when(F.bool_or(error & (F.col("value") > 150)), "expired").when(F.bool_or(error), "expiring").otherwise("ok")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(status.alias("status"), F.min(F.unix_millis(F.col("ts").cast("timestamp"))).alias("first_expiry"))


@R.add("AGG29", "SELECT count(*) AS n, min(o_orderdate) AS oldest, max(o_orderdate) AS newest FROM orders")
def cache_statistics(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("oldest"), F.max("o_orderdate").alias("newest"))


@R.add("AGG30", """WITH g AS (SELECT *, sum(CASE WHEN gap > 28800000 OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS w FROM (SELECT user_id, event_id, event_type, (epoch_us(ts) // 1000) AS ms, (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)),
    k AS (SELECT user_id, w, lower(event_type) AS t, min(ms) AS first_ms, min(event_id) FILTER (WHERE true) AS e FROM g GROUP BY user_id, w, lower(event_type)), d AS (SELECT user_id, w, t, (SELECT min((x.ms, x.event_id)) FROM g x WHERE x.user_id = k.user_id AND x.w = k.w AND lower(x.event_type) = k.t) AS o FROM k)
    SELECT user_id, min_ms AS first_ms, max_ms AS last_ms, n, texts FROM (SELECT user_id, w, min(ms) AS min_ms, max(ms) AS max_ms, count(*) AS n FROM g GROUP BY user_id, w) JOIN (SELECT user_id, w, string_agg(t, ' ' ORDER BY o) AS texts FROM d GROUP BY user_id, w) USING (user_id, w)""")
def session_combine(spark, sf_dir):
    """Messages of a key within eight hours of the one before become one: distinct texts in order of appearance, first and last time, their number."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.lower("event_type").alias("t"), F.col("ts").cast("timestamp").alias("ts"))
    grouped = e.groupBy("user_id", F.session_window("ts", "28800001 milliseconds").alias("w")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "t"))).alias("items"))
    texts = F.array_join(F.array_distinct(F.transform("items", lambda i: i["t"])), " ")
    return grouped.select("user_id", F.unix_millis(F.get("items", F.lit(0))["ts"]).alias("first_ms"), F.unix_millis(F.element_at("items", -1)["ts"]).alias("last_ms"), F.size("items").cast("long").alias("n"), texts.alias("texts"))


@R.add("AGG31", """SELECT source AS dir, CASE WHEN count(*) = 1 THEN source || '/' || min(doc_id) ELSE source || '/{' || string_agg(doc_id::VARCHAR, ', ' ORDER BY doc_id) || '}' END AS label FROM documents GROUP BY source""")
def brace_collapse(spark, sf_dir):
    """Paths grouped by folder: dir/{a, b}, or the path itself where it is alone."""
    names = F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string"))
    by = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("dir")).agg(names.alias("names"))
    inner = F.array_join("names", ", ")
    return by.select("dir", F.when(F.size("names") == 1, F.concat("dir", F.lit("/"), inner)).otherwise(F.concat("dir", F.lit("/{"), inner, F.lit("}"))).alias("label"))


@R.add("WIN1", f"{_FACTS} SELECT event_id, round(sum(total_tokens) OVER w, 4) AS cumulative_tokens, round(sum(coalesce(total_cost, 0)) OVER w, 4) AS cumulative_cost FROM f WINDOW w AS (PARTITION BY session ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING)")
def time_series(spark, sf_dir):
    points = message_facts(spark, sf_dir).withColumn("cost", F.coalesce("total_cost", F.lit(0.0)))
    return rollups.cumulative(points, "session", ["ts_ms", "event_id"], {"cumulative_tokens": "total_tokens", "cumulative_cost": "cost"}).select("event_id", "cumulative_tokens", "cumulative_cost")


@R.add("WIN2", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq FROM events")
def sequence_numbers(spark, sf_dir):
    from pyspark.sql import Window

    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"))


@R.add("WIN3", "SELECT user_id, event_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 10")
def newest_per_key(spark, sf_dir):
    return rollups.top_per_group(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", [F.desc("ts"), F.asc("event_id")], 10).select("user_id", "event_id", "rank")


@R.add("JN3", "SELECT event_id, c_name AS job_name FROM events LEFT JOIN customer ON user_id = c_custkey")
def job_names(spark, sf_dir):
    """Left lookup; Spark broadcasts the names while they are under its size limit and shuffles both sides beyond."""
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("job_name"))
    return table(spark, sf_dir, "events").select("event_id", "user_id").join(jobs, "user_id", "left").select("event_id", "job_name")


@R.add("JN4", "SELECT l_orderkey, l_linenumber, round(l_quantity * p_retailprice / 1000000, 8) AS cost FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON l_partkey = p_partkey")
def price_lookup(spark, sf_dir):
    prices = table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").join(prices, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * F.col("p_retailprice") / 1_000_000, 8).alias("cost"))
