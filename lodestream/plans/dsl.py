"""Session query language, paging and export (FLT3-17, RNK4-8, RNK10-12, SNK1-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestream.operators import dsl, listing
from lodestream.plans.registry import Registry
from lodestream.plans.scalar import NOW_MS
from lodestream.session import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sessions, their orders as messages."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("messages"), F.round(F.sum("o_totalprice"), 2).alias("total_cost"), F.count_if(F.col("o_orderstatus") == "F").alias("errors"),
        F.count_if(F.col("o_orderpriority").startswith("1")).alias("tool_calls"), F.max(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("updated_at"))
    number = F.col("c_custkey").cast("string")
    return c.join(per, "c_custkey", "left").select(
        "c_custkey", F.concat(F.lit("agent:a"), (F.col("c_nationkey") % 5).cast("string"), F.lit(":"), F.lower("c_mktsegment"), F.lit(":direct:"), number).alias("key"),
        F.concat(F.lit("sess-"), number).alias("session_id"), F.col("c_name").alias("label"), F.concat(F.lit("a"), (F.col("c_nationkey") % 5).cast("string")).alias("agent_id"), F.col("c_mktsegment").alias("channel"),
        F.when(F.col("c_custkey") % 4 == 0, "group").otherwise("direct").alias("chat_type"),
        F.array(F.concat(F.lit("prov"), (F.col("c_nationkey") % 3).cast("string")), F.when(F.col("c_custkey") % 2 == 0, "Extra").otherwise("main")).alias("providers"),
        F.when(F.col("messages") > 0, F.array(F.concat(F.lit("model-"), (F.col("c_nationkey") % 4).cast("string")))).otherwise(F.array().cast("array<string>")).alias("models"),
        F.when(F.col("tool_calls") > 0, F.array(F.lit("read"), F.lit("exec"))).otherwise(F.array().cast("array<string>")).alias("tools"),
        (F.col("messages") * 1000).alias("total_tokens"), "total_cost", "messages", "errors", "tool_calls", "updated_at", (F.col("c_acctbal") > 0).alias("has_context"), F.col("messages").isNotNull().alias("has_usage"))


_S = """WITH p AS (SELECT o_custkey, count(*) AS messages, round(sum(o_totalprice), 2) AS total_cost, count(*) FILTER (WHERE o_orderstatus = 'F') AS errors, count(*) FILTER (WHERE starts_with(o_orderpriority, '1')) AS tool_calls, max(epoch_ms(o_orderdate)) AS updated_at FROM orders GROUP BY 1),
    s AS (SELECT c_custkey, 'agent:a' || (c_nationkey % 5) || ':' || lower(c_mktsegment) || ':direct:' || c_custkey AS key, 'sess-' || c_custkey AS session_id, c_name AS label, 'a' || (c_nationkey % 5) AS agent_id, c_mktsegment AS channel,
      CASE WHEN c_custkey % 4 = 0 THEN 'group' ELSE 'direct' END AS chat_type, c_nationkey, c_acctbal, messages, total_cost, errors, tool_calls, updated_at FROM customer LEFT JOIN p ON c_custkey = o_custkey) """


def _filter(name: str, query: str, where: str):
    def run(spark, sf_dir):
        return dsl.filter_sessions(sessions(spark, sf_dir), query)[0].select("c_custkey", "key")

    R.add(name, f"{_S} SELECT c_custkey, key FROM s WHERE {where}")(run)


_filter("FLT6", "sess-1", "contains(lower(label), 'sess-1') OR contains(key, 'sess-1') OR contains(session_id, 'sess-1')")
_filter("FLT7", "agent:A3 channel:build", "agent_id = 'a3' AND contains(lower(channel), 'build')")
_filter("FLT7_chat", "chat:group label:1", "chat_type = 'group' AND contains(label, '1')")
_filter("FLT8", "provider:prov1 model:model-2", "c_nationkey % 3 = 1 AND messages > 0 AND c_nationkey % 4 = 2")
_filter("FLT8_tool", "tool:exe provider:extra", "tool_calls > 0 AND c_custkey % 2 = 0")
_filter("FLT9", "key:agent:a?:*:direct:1*", "regexp_matches(key, '^agent:a.:.*:direct:1.*$')")
_filter("FLT9_plain", "id:sess-77", "contains(session_id, 'sess-77') OR contains(key, 'sess-77')")
_filter("FLT10", "has:errors has:tools has:unknown", "errors > 0 AND tool_calls > 0")
_filter("FLT10_more", "has:context has:usage has:model has:provider", "c_acctbal > 0 AND messages > 0")
_filter("FLT11", "mintokens:9k maxcost:$2m minmessages:bad", "coalesce(messages, 0) * 1000 >= 9000 AND coalesce(total_cost, 0) <= 2000000")
_filter("FLT11_max", "maxtokens:12K mincost:100000 maxmessages:11", "coalesce(messages, 0) * 1000 <= 12000 AND coalesce(total_cost, 0) >= 100000 AND coalesce(messages, 0) <= 11")
_filter("FLT12", 'agent:a1 minmessages:5 "label:customer" nonsense:x', "agent_id = 'a1' AND messages >= 5 AND contains(lower(label), 'customer')")
_filter("FLT13", '"channel:auto" "has:usage"', "contains(lower(channel), 'auto') AND messages IS NOT NULL")


@R.add("FLT14", "SELECT 'channel:' || c_mktsegment AS suggestion FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE contains(lower(c_mktsegment), 'i')) ORDER BY 1 LIMIT 6")
def query_suggestions(spark, sf_dir):
    return dsl.suggestions(sessions(spark, sf_dir), "channel", "I")


@R.add("FLT3", "SELECT event_id FROM events WHERE (epoch_us(ts) // 1000) BETWEEN 1704844800000 AND 1705276800000")
def time_range(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return listing.between(e, "ms", 1704844800000, 1705276800000).select("event_id")


@R.add("FLT4", f"{_S} SELECT c_custkey FROM s WHERE updated_at IS NOT NULL AND {NOW_MS} - updated_at <= 800000::BIGINT * 60000")
def active_minutes(spark, sf_dir):
    return listing.active(sessions(spark, sf_dir), "updated_at", NOW_MS, 800_000).select("c_custkey")


@R.add("FLT5", f"{_S} SELECT c_custkey FROM s WHERE {NOW_MS} - updated_at <= 5000000::BIGINT * 60000 AND agent_id = 'a2' AND (contains(lower(label), '1') OR contains(lower(key), '1')) AND chat_type <> 'unknown' ORDER BY updated_at DESC, c_custkey LIMIT 50")
def session_list(spark, sf_dir):
    return listing.sessions(sessions(spark, sf_dir), NOW_MS, limit=50, active_minutes=5_000_000, agent_id="a2", search="1", key="c_custkey").select("c_custkey")


@R.add("FLT15", "SELECT p_partkey FROM part WHERE p_size > 10 AND contains(lower(p_name), 'a')")
def job_filter(spark, sf_dir):
    jobs = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), (F.col("p_size") > 10).alias("enabled"))
    return listing.jobs(jobs, enabled="enabled", query="A").select("p_partkey")


@R.add("FLT16", "SELECT event_id FROM events WHERE user_id % 5 = 2 AND event_type IN ('error', 'view') AND contains(props, '1') AND event_id % 3 <> 0")
def run_filter(spark, sf_dir):
    delivery = F.element_at(F.array(F.lit("not-requested"), F.lit("delivered"), F.lit("not-delivered")), (F.col("event_id") % 3 + 1).cast("int"))
    e = table(spark, sf_dir, "events").withColumns({"job": F.col("user_id") % 5, "delivery_status": delivery})
    return listing.runs(e, job="job", scope=2, status="event_type", statuses=["error", "view"], text="props", query="1", deliveries=["delivered", "not-delivered"]).select("event_id")


@R.add("FLT17", "SELECT p_partkey FROM part WHERE p_size % 3 = 1 AND p_partkey % 2 = 0")
def schedule_filter(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("at"), F.lit("every"), F.lit("cron")), (F.col("p_size") % 3 + 1).cast("int"))
    jobs = table(spark, sf_dir, "part").select("p_partkey", F.struct(kind.alias("kind")).alias("schedule"), F.struct(F.when(F.col("p_partkey") % 2 == 0, "ok").otherwise("error").alias("last_status")).alias("state"))
    return jobs.filter((F.col("schedule.kind") == "every") & (F.col("state.last_status") == "ok")).select("p_partkey")


@R.add("FLT19", "SELECT conv_id, turn FROM conversations WHERE role <> 'system'")
def without_tools(spark, sf_dir):
    return listing.without_tool_rows(table(spark, sf_dir, "conversations"), tool_roles=("tool", "toolResult", "system")).select("conv_id", "turn")


@R.add("FLT21", "SELECT event_id FROM events WHERE extract(hour FROM ts) * 60 + extract(minute FROM ts) >= 1350 OR extract(hour FROM ts) * 60 + extract(minute FROM ts) < 390")
def active_hours(spark, sf_dir):
    from lodestream.functions import timefns

    return table(spark, sf_dir, "events").filter(timefns.within_active_hours(F.unix_millis(F.col("ts").cast("timestamp")), "22:30", "06:30")).select("event_id")


@R.add("FLT22", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 'id' WHEN c_mktsegment = 'BUILDING' THEN 'name' END AS matched FROM customer")
def allow_list(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", listing.allow_match({"id": (F.col("c_custkey") % 10).cast("string"), "name": F.lower("c_mktsegment")}, ["3", "building"]).alias("matched"))


@R.add("RNK4", "SELECT p_partkey, p_name FROM part ORDER BY p_size DESC, p_partkey OFFSET 20 LIMIT 30")
def job_page(spark, sf_dir):
    return listing.page(table(spark, sf_dir, "part"), "p_size", descending=True, tie="p_partkey", offset=20, limit=30).select("p_partkey", "p_name")


@R.add("RNK5", f"{_S} SELECT c_custkey, total_cost FROM s ORDER BY coalesce(total_cost, 0) DESC, c_custkey LIMIT 40")
def session_sort(spark, sf_dir):
    return listing.sort_sessions(sessions(spark, sf_dir), "cost", tie="c_custkey").limit(40).select("c_custkey", "total_cost")


@R.add("RNK6", f"{_S} SELECT c_custkey FROM s ORDER BY coalesce(updated_at, 0) DESC, c_custkey LIMIT 25")
def recency(spark, sf_dir):
    return listing.sort_sessions(sessions(spark, sf_dir), "recent", tie="c_custkey").limit(25).select("c_custkey")


@R.add("RNK7", """SELECT o_orderkey, more FROM (SELECT o_custkey, o_orderkey, row_number() OVER w AS r, count(*) OVER (PARTITION BY o_custkey) > 4 AS more FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 3 WHEN '2' THEN 3 WHEN '3' THEN 2 ELSE 1 END DESC, o_orderdate, o_orderkey)) WHERE r <= 4""")
def priority_drain(spark, sf_dir):
    first = F.substring("o_orderpriority", 1, 1)
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created"), F.when(first.isin("1", "2"), "high").when(first == "3", "normal").otherwise("default").alias("priority"))
    return listing.drain(items, most=4).select(F.col("id").alias("o_orderkey"), F.col("has_more").alias("more"))


@R.add("RNK8", """SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal < 0, CASE WHEN c_acctbal >= 0 THEN length(c_mktsegment) END, c_acctbal, c_custkey) AS place FROM customer""")
def credential_order(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumns({"cooling": F.col("c_acctbal") < 0, "type_rank": F.length("c_mktsegment")})
    return listing.credential_order(c, "c_nationkey", "cooling", "type_rank", "c_acctbal", "c_custkey").select("c_custkey", F.col("place").cast("long").alias("place"))


@R.add("RNK10", f"{_S} SELECT c_custkey, key FROM s WHERE key = (SELECT key FROM s WHERE c_custkey = 5) OR {NOW_MS} - updated_at <= 24 * 3600000 * 500::BIGINT ORDER BY key = (SELECT key FROM s WHERE c_custkey = 5) DESC, updated_at DESC, c_custkey LIMIT 30")
def session_choices(spark, sf_dir):
    s = sessions(spark, sf_dir)
    return listing.choices(s, "c_custkey", "updated_at", NOW_MS, window_ms=24 * 3_600_000 * 500, pinned=F.col("c_custkey") == 5, limit=30).select("c_custkey", "key")


@R.add("RNK11", f"{_S} SELECT c_custkey FROM s ORDER BY updated_at DESC NULLS LAST, c_custkey LIMIT 100")
def newest_entries(spark, sf_dir):
    return sessions(spark, sf_dir).orderBy(F.desc_nulls_last("updated_at"), "c_custkey").limit(100).select("c_custkey")


@R.add("RNK12", """SELECT page_id, score FROM (SELECT page_id, CASE WHEN contains(d, 'example en') THEN 10 ELSE 0 END + CASE WHEN len(list_filter(w, lambda x: contains(x, 'example'))) > 0 THEN 5 ELSE 0 END + CASE WHEN len(list_filter(w, lambda x: contains(x, 'en'))) > 0 THEN 5 ELSE 0 END
      + CASE WHEN contains(host, 'example en') THEN 3 ELSE 0 END AS score FROM (SELECT page_id, d, string_split(d, ' ') AS w, regexp_extract(url, '://([^/]+)', 1) AS host FROM (SELECT page_id, url, regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g') AS d FROM pages))) WHERE score > 0 ORDER BY score DESC, page_id LIMIT 10""")
def sticker_search(spark, sf_dir):
    d = F.regexp_replace(F.lower("url"), "[^a-z0-9]+", " ")
    items = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), d.alias("description"), F.lit("").alias("emoji"), F.regexp_extract("url", "://([^/]+)", 1).alias("set_name"))
    return listing.keyword_items(items, "example en", 10).select(F.col("id").alias("page_id"), "score")


@R.add("SNK1", f"{_S} SELECT key || ',' || label || ',' || agent_id || ',' || channel || ',' || coalesce(messages::VARCHAR, '') || ',' || coalesce(errors::VARCHAR, '') AS line FROM s")
def sessions_csv(spark, sf_dir):
    return listing.csv_lines(sessions(spark, sf_dir), ["key", "label", "agent_id", "channel", "messages", "errors"])


@R.add("SNK2", "SELECT date || ',' || n || ',' || errors AS line FROM (SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1)")
def daily_csv(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return listing.csv_lines(daily, ["date", "n", "errors"])


@R.add("SNK3", """WITH m AS (SELECT user_id, event_type, count(*) AS runs FROM events GROUP BY 1, 2) SELECT '{"job":' || user_id || ',"runs":' || sum(runs)::BIGINT || ',"models":[' || string_agg('{"model":"' || event_type || '","runs":' || runs || '}', ',' ORDER BY runs DESC, event_type) || ']}' AS report FROM m GROUP BY user_id""")
def report_json(spark, sf_dir):
    """Jobs with their models, the most runs first, as one JSON object each."""
    m = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("runs"))
    models = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("runs")).alias("o"), F.col("event_type").alias("model"), "runs"))), lambda x: F.struct(x["model"].alias("model"), x["runs"].alias("runs")))
    return m.groupBy("user_id").agg(F.sum("runs").alias("runs"), models.alias("models")).select(F.to_json(F.struct(F.col("user_id").alias("job"), "runs", "models")).alias("report"))
