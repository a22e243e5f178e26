"""The callable surface as queries (EXT2-8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream import api
from lodestream.plans import retrieval as search_plans, usage as usage_plans
from lodestream.plans.registry import Registry
from lodestream.plans.scalar import NOW_MS
from lodestream.session import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _index(spark, sf_dir):
    chunks = search_plans.chunks(spark, sf_dir).drop("source").withColumnRenamed("kind", "source")
    return api.ChunkIndex(chunks, lambda q: search_plans.query_vector(spark, sf_dir), NOW_MS)


@R.add("EXT2", "SELECT CASE WHEN doc_id % 3 = 2 THEN 'sessions' ELSE 'memory' END AS source, count(*) AS chunks FROM documents JOIN embeddings ON doc_id = vec_id GROUP BY 1")
def index_status(spark, sf_dir):
    return _index(spark, sf_dir).status().select("source", "chunks")


class _Broken:
    """One backend fails when it is asked, the other only when its rows are read."""

    def __init__(self, chunks=None):
        self.chunks = chunks

    def search(self, *_):
        if self.chunks is None:
            raise RuntimeError("backend is down")
        return self.chunks.select("id", F.raise_error(F.lit("backend is down")).cast("double").alias("score"))

    read = status = search


@R.add("EXT3", ORACLES.get("EXT1_decayed") or search_plans.ORACLES["EXT1_decayed"])
def fallback_search(spark, sf_dir):
    hits = api.Fallback([_Broken(), _Broken(_index(spark, sf_dir).chunks), _index(spark, sf_dir)]).search(search_plans.QUERY, 10)
    return hits.select("id", F.round("score", 6).alias("score"))


@R.add("EXT4", "SELECT event_id FROM (SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS s FROM events) WHERE s <= 300")
def context_engine(spark, sf_dir):
    messages = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("value").alias("tokens"))
    return api.ENGINES.get("newest").assemble(messages, 300).select(F.col("seq").alias("event_id"))


@R.add("EXT5", "SELECT event_id, 'auth ' || 'Bearer abcdef…4567' AS line FROM events")
def registered_tools(spark, sf_dir):
    api.register_tools(spark)
    table(spark, sf_dir, "events").createOrReplaceTempView("lodestream_events")
    return spark.sql("SELECT event_id, redact_secrets('auth Bearer abcdefghijklmnop1234567') AS line FROM lodestream_events")


@R.add("EXT6", f"{usage_plans._FACTS} SELECT session, {usage_plans._TOTALS} FROM f WHERE ts_ms BETWEEN 1704844800000 AND 1705103999999 GROUP BY session ORDER BY total_cost DESC, session LIMIT 50")
def sessions_usage(spark, sf_dir):
    return api.sessions_usage(usage_plans.message_facts(spark, sf_dir), NOW_MS, "2024-01-10", "2024-01-12")


@R.add("EXT6_cost", f"{usage_plans._FACTS} SELECT date, {usage_plans._TOTALS} FROM f WHERE ts_ms BETWEEN {NOW_MS} - 6 * 86400000 AND {NOW_MS} + 86399999 GROUP BY date")
def usage_cost(spark, sf_dir):
    return api.usage_cost(usage_plans.message_facts(spark, sf_dir), NOW_MS, 7)


@R.add("EXT6_series", f"{usage_plans._FACTS} SELECT event_id, round(sum(total_tokens) OVER (ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING), 4) AS cumulative_tokens FROM f WHERE session = 7")
def usage_series(spark, sf_dir):
    return api.usage_timeseries(usage_plans.message_facts(spark, sf_dir), 7).select("event_id", "cumulative_tokens")


@R.add("EXT7", "SELECT conv_id, turn FROM conversations WHERE conv_id = 3 AND role <> 'tool' ORDER BY turn DESC LIMIT 200")
def chat_history(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role")
    return api.chat_history(messages, 3).select(F.col("session").alias("conv_id"), F.col("seq").alias("turn"))


@R.add("EXT7_cron", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_size > 10 AND contains(lower(p_name), 'a') ORDER BY p_name DESC, p_partkey LIMIT 20 OFFSET 5")
def cron_list(spark, sf_dir):
    jobs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") > 10).alias("enabled"))
    return api.cron_list(jobs, "A", "enabled", "name", True, 5, 20).select("id", "name")


@R.add("EXT7_runs", "SELECT event_id AS id FROM events WHERE user_id = 7 AND event_type = 'error' ORDER BY ts DESC NULLS LAST, event_id LIMIT 10")
def cron_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), "ts", F.col("props").alias("summary"))
    return api.cron_runs(runs, 7, ["error"], sort="ts", limit=10).select("id")


@R.add("EXT7_logs", "SELECT event_id AS line_no, props AS line FROM events ORDER BY event_id DESC LIMIT 500")
def logs_tail(spark, sf_dir):
    return api.logs_tail(table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.col("props").alias("line"))).select("line_no", "line")


@R.add("EXT7_sessions", "SELECT conv_id AS key, count(*) AS messages FROM conversations GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 25")
def sessions_list(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("key")).agg(F.count(F.lit(1)).alias("messages"))
    return api.sessions_list(c, "minMessages:3", "messages", 25).select("key", "messages")


@R.add("EXT4_ingest", "SELECT event_id FROM (SELECT event_id, value, event_id % 2 AS h, sum(value) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS s FROM events) WHERE s <= 300 UNION ALL SELECT max(event_id) + 1 FROM events")
def context_ingest(spark, sf_dir):
    """Messages taken in by two calls, the second repeating some of the first, then assembled with a row of a session of its own."""
    messages = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("value").alias("tokens"))
    engine = api.ENGINES.get("newest")
    own = messages.agg(F.lit(-1).cast(messages.schema["session"].dataType).alias("session"), (F.max("seq") + 1).alias("seq"), F.lit(1.0).alias("tokens"))
    held = engine.ingest(messages.filter("seq % 2 = 0"), messages.filter("seq % 3 <> 0 OR seq % 2 = 1").unionByName(own))
    return engine.assemble(held, 300).select(F.col("seq").alias("event_id"))


@R.add("EXT4_compact", "SELECT user_id AS session, count(*) FILTER (WHERE s > 300) AS folded, round(sum(value) FILTER (WHERE s > 300), 4) AS folded_tokens, count(*) FILTER (WHERE s <= 300) AS kept FROM (SELECT user_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS s FROM events) GROUP BY 1")
def context_compact(spark, sf_dir):
    """What goes beyond the budget becomes one row a session."""
    messages = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("value").alias("tokens"))
    return api.ENGINES.get("newest").compact(messages, 300).select("session", "folded", F.round("folded_tokens", 4).alias("folded_tokens"), "kept")


@R.add("EXT8", "SELECT event_id, 'u' || user_id || ':' || event_type AS key FROM events")
def callbacks(spark, sf_dir):
    """Operators take functions that make columns, as their callers give callbacks."""
    build_key = lambda row: F.concat(F.lit("u"), row["user_id"].cast("string"), F.lit(":"), row["event_type"])
    e = table(spark, sf_dir, "events")
    return e.select("event_id", build_key(e).alias("key"))
