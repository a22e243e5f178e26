"""Keyed stream operators (STM1-9, 13-16, 21-23, 27, 28, 31, SNK8), run over the event files as a stream; SQL where the batch says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestream.plans.registry import Registry
from lodestream.session import scratch
from lodestream.streaming import engine, machines as m

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
_MS = "(epoch_us(ts) // 1000)"


def stream(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
    """user_id, id, at and further columns of the event stream, with a watermark (timestamps without zone can't have one)."""
    e = engine.files(spark, sf_dir, "events").withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", "0 seconds")
    return e.select("user_id", F.col("event_id").alias("id"), F.unix_millis("time").alias("at"), "time", *more)


def run(spark: SparkSession, sf_dir: str, machine: m.Machine, schema: str, *more, flush: m.Flush | None = None, idle_ms: int = 0) -> DataFrame:
    return engine.drained(spark, engine.keyed(stream(spark, sf_dir, *more), "user_id", machine, schema, flush, idle_ms))



#: A user's events in order, numbered.
_ORDERED = f"e AS (SELECT user_id, event_id AS id, event_type AS item, {_MS} AS t, row_number() OVER (PARTITION BY user_id ORDER BY {_MS}, event_id) AS n FROM events)"
#: What is held at the end comes out once the latest event of all is later than the idle time.
_LATEST = f"(SELECT max({_MS}) FROM events)"


def _window_sql(most: int, window_ms: int) -> str:
    """A step for each row: the window's first request and what it has allowed."""
    return f"""WITH RECURSIVE {_ORDERED},
    s AS (SELECT user_id, n, id, t, t AS start, 1 AS used, true AS allowed FROM e WHERE n = 1 UNION ALL
      SELECT e.user_id, e.n, e.id, e.t, CASE WHEN e.t - start >= {window_ms} THEN e.t ELSE start END, CASE WHEN e.t - start >= {window_ms} THEN 1 WHEN used < {most} THEN used + 1 ELSE used END,
        e.t - start >= {window_ms} OR used < {most} FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
    SELECT user_id, id, allowed, CAST({most} - used AS INTEGER) AS remaining, CASE WHEN allowed THEN 0 ELSE greatest(0, start + {window_ms} - t) END AS retry_after_ms FROM s"""


def _kept_sql(ttl_ms: int, most: int, item: str) -> str:
    """The items seen within the ttl, at most so many: what the cap has pushed out is older than all that stays, and would be over its time before them."""
    seen = f"SELECT user_id, event_id AS id, {item} AS item, {_MS} AS t FROM events"
    within = f" AND a.t - b.t <= {ttl_ms}" if ttl_ms else ""
    return f"WITH e AS ({seen}) SELECT a.user_id, a.id, CAST(least({most}, count(DISTINCT b.item)) AS INTEGER) AS size FROM e a JOIN e b ON a.user_id = b.user_id AND (b.t < a.t OR (b.t = a.t AND b.id <= a.id)){within} GROUP BY a.user_id, a.id"


def _item():
    return F.col("event_type").alias("item")


def _waits():
    return (F.col("event_type") != "purchase").alias("waits")



@R.add("STM1", f"SELECT event_id AS id, coalesce({_MS} - lag({_MS}) OVER (PARTITION BY user_id, event_type ORDER BY {_MS}, event_id) < 36000000, false) AS duplicate FROM events")
def ttl_dedupe(spark, sf_dir):
    """Each sight refreshes, so an item is a duplicate if its last sight is recent."""
    return run(spark, sf_dir, m.seen_within(36_000_000), "id long, duplicate boolean", _item(), idle_ms=36_000_000).select("id", "duplicate")


@R.add("STM2", f"SELECT user_id, count(*) AS kept FROM (SELECT user_id, coalesce({_MS} - lag({_MS}) OVER (PARTITION BY user_id, event_type ORDER BY {_MS}, event_id) < 36000000, false) AS d FROM events) WHERE NOT d GROUP BY 1")
def persistent_dedupe(spark, sf_dir):
    """The namespace is the key; the state is in the checkpoint."""
    out = run(spark, sf_dir, m.seen_within(36_000_000), "id long, duplicate boolean", _item(), idle_ms=36_000_000)
    return out.filter("NOT duplicate").groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))


@R.add("STM3", "SELECT event_id, 'web|u' || user_id || '|' || event_type || '|' || event_id AS key FROM events")
def inbound_key(spark, sf_dir):
    """provider, account, peer and message id, parts that are missing left out."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    blank = F.nullif(F.lit(""), F.lit(""))
    return e.select("event_id", F.concat_ws("|", F.lit("web"), F.concat(F.lit("u"), F.col("user_id").cast("string")), blank, "event_type", F.col("event_id").cast("string")).alias("key"))


@R.add("STM4", f"""WITH e AS (SELECT user_id, event_id, {_MS} AS t, event_type <> 'purchase' AS waits, lag({_MS}) OVER w AS p, lag(event_type <> 'purchase') OVER w AS pw, row_number() OVER w = count(*) OVER (PARTITION BY user_id) AS final FROM events WINDOW w AS (PARTITION BY user_id ORDER BY {_MS}, event_id)),
    g AS (SELECT *, sum(CASE WHEN p IS NULL OR NOT waits OR NOT pw OR t - p >= 28800000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e)
    SELECT user_id, arg_min(event_id, (t, event_id)) AS first, CAST(count(*) AS INTEGER) AS items, max(t) AS last FROM g GROUP BY user_id, g HAVING NOT (bool_or(final) AND bool_and(waits)) OR max(t) + 28800000 < {_LATEST}""")
def debounced(spark, sf_dir):
    step, flush = m.debounce(28_800_000)
    return run(spark, sf_dir, step, "first long, items int, last long", _waits(), flush=flush, idle_ms=28_800_000)


@R.add("STM4_batch", f"""WITH e AS (SELECT user_id, event_id, {_MS} AS t, event_type <> 'purchase' AS waits, lag({_MS}) OVER w AS p, lag(event_type <> 'purchase') OVER w AS pw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY {_MS}, event_id)),
    g AS (SELECT *, sum(CASE WHEN p IS NULL OR NOT waits OR NOT pw OR t - p >= 28800000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e)
    SELECT user_id, arg_min(event_id, (t, event_id)) AS first, CAST(count(*) AS INTEGER) AS items, max(t) AS last FROM g GROUP BY user_id, g""")
def debounced_batch(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), _waits())
    step, flush = m.debounce(28_800_000)
    return engine.batch(e, "user_id", step, "first long, items int, last long", flush)


@R.add("STM5", _window_sql(3, 86_400_000))
def first_request_windows(spark, sf_dir):
    return run(spark, sf_dir, m.fixed_window(3, 86_400_000), "id long, allowed boolean, remaining int, retry_after_ms long")


@R.add("STM6", _window_sql(3, 3_600_000))
def keyed_budget(spark, sf_dir):
    """Three an hour for each device."""
    return run(spark, sf_dir, m.fixed_window(3, 3_600_000), "id long, allowed boolean, remaining int, retry_after_ms long")


@R.add("STM7", f"""WITH RECURSIVE {_ORDERED},
    s AS (SELECT user_id, n, id, [t] AS failures, NULL::BIGINT AS until, false AS locked, 4 AS remaining FROM e WHERE n = 1 UNION ALL
      SELECT user_id, n, id, failures, until, locked, CASE WHEN still THEN 0 ELSE greatest(0, 5 - len(failures)) END FROM (
        SELECT user_id, n, id, still, recent AS failures, CASE WHEN still THEN until WHEN len(recent) >= 5 THEN t + 172800000 END AS until, still OR len(recent) >= 5 AS locked FROM (
          SELECT e.user_id, e.n, e.id, e.t, s.until, coalesce(e.t < s.until, false) AS still,
            CASE WHEN coalesce(e.t < s.until, false) THEN failures WHEN s.until IS NOT NULL THEN [e.t] ELSE list_append(list_filter(failures, lambda x: x > e.t - 86400000), e.t) END AS recent
          FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)))
    SELECT user_id, id, locked, CAST(remaining AS INTEGER) AS remaining FROM s""")
def failure_lockout(spark, sf_dir):
    return run(spark, sf_dir, m.lockout(5, 86_400_000, 172_800_000), "id long, locked boolean, remaining int")


@R.add("STM8", f"""WITH e AS (SELECT user_id, event_id, event_id % 13 = 0 AS drain, row_number() OVER w AS n, coalesce(sum(CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM events WINDOW w AS (PARTITION BY user_id ORDER BY {_MS}, event_id)),
    q AS (SELECT *, row_number() OVER (PARTITION BY user_id, part ORDER BY n) AS k FROM e)
    SELECT 'summarize' AS policy, event_id AS id, true AS accepted, CAST(CASE WHEN drain THEN 0 ELSE least(k, 10) END AS INTEGER) AS size, CAST(greatest(k - drain::INT - 10, 0) AS INTEGER) AS dropped FROM q UNION ALL
    SELECT 'new', event_id, drain OR k <= 10, CAST(CASE WHEN drain THEN 0 ELSE least(k, 10) END AS INTEGER), 0 FROM q""")
def drop_policy(spark, sf_dir):
    """A queue of ten, drained now and then, that drops its oldest items or refuses new ones."""
    drain = (F.col("event_id") % 13 == 0).alias("drain")
    out = [run(spark, sf_dir, m.bounded_queue(10, p), "id long, accepted boolean, size int, dropped int", _item(), drain).select(F.lit(p).alias("policy"), "id", "accepted", "size", "dropped") for p in ("summarize", "new")]
    return out[0].unionByName(out[1])


@R.add("STM9", f"SELECT event_id AS id, coalesce({_MS} - lag({_MS}) OVER (PARTITION BY user_id, event_type, event_id % 3 ORDER BY {_MS}, event_id) < 300000, false) AS duplicate FROM events")
def enqueue_dedupe(spark, sf_dir):
    """By prompt and route, within five minutes."""
    route = F.concat_ws("|", "event_type", (F.col("event_id") % 3).cast("string")).alias("item")
    return run(spark, sf_dir, m.seen_within(300_000), "id long, duplicate boolean", route, idle_ms=300_000).select("id", "duplicate")


@R.add("STM13", "SELECT event_id AS id, CAST(least(n, 20) AS INTEGER) AS size, first_value(event_type) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY " + _MS + ", event_id) AS n FROM events)")
def ring_buffer(spark, sf_dir):
    return run(spark, sf_dir, m.ring(20), "id long, size int, oldest string", _item()).select("id", "size", "oldest")


@R.add("STM14", f"""WITH RECURSIVE {_ORDERED},
    none AS (SELECT CAST([] AS STRUCT(first BIGINT, text VARCHAR)[]) AS z),
    s AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS first, '' AS text, '' AS reply, 0::BIGINT AS last, z AS out FROM e, none WHERE n = 1 UNION ALL
      SELECT user_id, n, CASE WHEN media OR full_now THEN NULL WHEN joined_first IS NULL THEN id ELSE joined_first END, CASE WHEN media OR full_now THEN '' ELSE joined END, CASE WHEN joined_first IS NULL THEN own ELSE reply END, t,
        out || CASE WHEN media THEN [{{'first': id, 'text': item}}] WHEN full_now THEN [{{'first': coalesce(joined_first, id), 'text': joined}}] ELSE z END
      FROM (SELECT *, CASE WHEN over THEN item ELSE together END AS joined, CASE WHEN over THEN NULL ELSE first END AS joined_first, NOT media AND length(CASE WHEN over THEN item ELSE together END) >= 40 AND NOT over AS full_now FROM (
        SELECT * EXCLUDE (out, text, first), out || CASE WHEN text <> '' AND (media OR over) THEN [{{'first': first, 'text': text}}] ELSE z END AS out, CASE WHEN media OR over THEN '' ELSE text END AS text, CASE WHEN media OR over THEN NULL ELSE first END AS first FROM (
          SELECT *, CASE WHEN text = '' THEN item ELSE text || ' ' || item END AS together, NOT media AND length(CASE WHEN text = '' THEN item ELSE text || ' ' || item END) > 40 AS over FROM (
            SELECT * EXCLUDE (out, text, first), out || CASE WHEN turned THEN [{{'first': first, 'text': text}}] ELSE z END AS out, CASE WHEN turned THEN '' ELSE text END AS text, CASE WHEN turned THEN NULL ELSE first END AS first FROM (
              SELECT *, text <> '' AND NOT media AND reply <> own AS turned FROM (
                SELECT e.user_id, e.n, e.id, e.t, e.item, e.item = 'error' AS media, CASE WHEN e.item = 'purchase' THEN 'r2' ELSE 'r1' END AS own, s.reply, z,
                  CASE WHEN idle THEN [{{'first': s.first, 'text': s.text}}] ELSE z END AS out, CASE WHEN idle THEN '' ELSE s.text END AS text, CASE WHEN idle THEN NULL ELSE s.first END AS first
                FROM (SELECT s.*, e.t - s.last >= 3600000 AND length(s.text) >= 10 AS idle FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1) s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1, none))))))),
    f AS (SELECT user_id, arg_max(first, n) AS first, arg_max(text, n) AS text, max(last) AS last FROM s GROUP BY user_id)
    SELECT user_id, o.first AS first, o.text AS text FROM (SELECT user_id, unnest(out) AS o FROM s) UNION ALL SELECT user_id, first, text FROM f WHERE text <> '' AND last + 3600000 < {_LATEST}""")
def coalesced(spark, sf_dir):
    step, flush = m.coalesce(10, 40, 3_600_000, " ")
    reply = F.when(F.col("event_type") == "purchase", "r2").otherwise("r1").alias("reply")
    return run(spark, sf_dir, step, "first long, text string", _item(), reply, (F.col("event_type") == "error").alias("media"), flush=flush, idle_ms=3_600_000)


@R.add("STM15", _kept_sql(259_200_000, 20, "event_id % 50"))
def idle_pruned(spark, sf_dir):
    item = (F.col("event_id") % 50).cast("string").alias("item")
    return run(spark, sf_dir, m.ttl_cap(259_200_000, 20), "id long, size int", item)


@R.add("STM16", f"SELECT event_id AS id, concat_ws(',', CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 'mode' END, CASE WHEN n > 1 AND seen = 1 OR n = 1 THEN 'roles' END) AS changed FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_MS}, event_id) AS n, row_number() OVER (PARTITION BY user_id, event_type ORDER BY {_MS}, event_id) AS seen FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY {_MS}, event_id)")
def presence_changes(spark, sf_dir):
    return run(spark, sf_dir, m.presence(("mode", "roles"), lambda row: {"mode": row["item"], "roles": [row["item"]]}), "id long, changed string", _item()).select("id", "changed")


@R.add("STM21", f"""WITH RECURSIVE {_ORDERED},
    s AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS id, CAST([] AS STRUCT(k VARCHAR, t BIGINT)[]) AS held, 0 AS revision, false AS accepted FROM e WHERE n = 1 UNION ALL
      SELECT user_id, n, id, CASE WHEN ack THEN list_filter(live, lambda x: x.k <> item) WHEN has THEN live ELSE list_append(live, {{'k': item, 't': t + 86400000}}) END, revision + gone + CASE WHEN ack = has THEN 1 ELSE 0 END, NOT ack AND NOT has
      FROM (SELECT *, len(list_filter(live, lambda x: x.k = item)) > 0 AS has, CASE WHEN len(live) < len(held) THEN 1 ELSE 0 END AS gone FROM (
        SELECT e.user_id, e.n, e.id, e.t, e.item, e.id % 4 = 0 AS ack, held, list_filter(held, lambda x: x.t > e.t) AS live, revision FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)))
    SELECT user_id, id, accepted, CAST(revision AS INTEGER) AS revision, CAST(len(held) AS INTEGER) AS size FROM s WHERE n > 0""")
def work_queue(spark, sf_dir):
    return run(spark, sf_dir, m.pending_work(86_400_000), "id long, accepted boolean, revision int, size int", _item(), (F.col("event_id") % 4 == 0).alias("ack"))


@R.add("STM22", _kept_sql(86_400_000, 3, "event_type"))
def maintenance(spark, sf_dir):
    """Expiry and cap of what is kept, as each row comes."""
    return run(spark, sf_dir, m.ttl_cap(86_400_000, 3), "id long, size int", _item())


@R.add("STM23", "SELECT user_id, count(*) // 10 AS syncs FROM events GROUP BY 1 HAVING count(*) >= 10")
def sync_triggers(spark, sf_dir):
    out = run(spark, sf_dir, m.sync_trigger(1 << 40, 10), "id long, bytes long, messages int", F.octet_length("props").alias("size"))
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("syncs"))


@R.add("STM27", "SELECT user_id, max(event_id) AS last_offset FROM events GROUP BY 1")
def offsets(spark, sf_dir):
    out = run(spark, sf_dir, m.latest_offset(), "id long, source_offset long", F.col("event_id").alias("offset"), F.lit("bot").alias("identity"))
    return out.groupBy("user_id").agg(F.max("source_offset").alias("last_offset"))


@R.add("STM28", _kept_sql(0, 10, "event_id % 50"))
def capped_cache(spark, sf_dir):
    item = (F.col("event_id") % 50).cast("string").alias("item")
    return run(spark, sf_dir, m.ttl_cap(0, 10), "id long, size int", item)


@R.add("STM31", f"SELECT event_id AS id, coalesce({_MS} - lag({_MS}) OVER (PARTITION BY user_id, event_id % 20 ORDER BY {_MS}, event_id) < 86400000, false) AS duplicate FROM events")
def replay_guard(spark, sf_dir):
    """room:message under the account's namespace."""
    item = F.concat(F.lit("room:"), (F.col("event_id") % 20).cast("string")).alias("item")
    return run(spark, sf_dir, m.seen_within(86_400_000), "id long, duplicate boolean", item, idle_ms=86_400_000).select("id", "duplicate")


@R.add("SNK8", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1")
def fan_out(spark, sf_dir):
    """Each micro-batch to two listeners."""
    from lodestream.sources import sinks

    root = scratch(spark)
    write = lambda name: lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{root}/out/listener={name}/epoch={epoch}")
    query = engine.files(spark, sf_dir, "events").select("event_type").writeStream.foreachBatch(sinks.fan_out(write("a"), write("b"))).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
