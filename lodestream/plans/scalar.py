"""Scalar functions over the driver's tables (STR*, DT*, MTH*, ARR1, JSN*, PRJ*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestream.functions import keys, text, timefns, usage, vector
from lodestream.plans.registry import Registry
from lodestream.session import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

#: "Now" of all queries, in epoch milliseconds.
NOW_MS = 1_706_745_600_000
TURN = "conv_id, turn"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@R.add("STR1", f"""SELECT {TURN}, CASE WHEN len(t) > 0 THEN list_aggregate(list_transform(t, lambda x: '"' || x || '"'), 'string_agg', ' AND ') END AS fts_query
    FROM (SELECT *, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS t FROM conversations)""")
def fts_query(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", text.fts_query(F.col("text")).alias("fts_query"))


@R.add("STR2", f"""SELECT {TURN}, len(t) AS n_tokens, coalesce(list_aggregate(list_sort(t), 'string_agg', ' '), '') AS tokens
    FROM (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM conversations)""")
def mmr_tokens(spark, sf_dir):
    t = text.token_set(F.col("text"))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.size(t).cast("long").alias("n_tokens"), F.array_join(F.array_sort(t), " ").alias("tokens"))


@R.add("STR4", f"""SELECT {TURN}, CASE WHEN len(k) > 0 THEN text || ' OR ' || list_aggregate(k, 'string_agg', ' OR ') ELSE text END AS expanded
    FROM (SELECT *, regexp_extract_all(lower(text), '[a-z]{{6,}}') AS k FROM conversations)""")
def query_expansion(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))
    return _turns(spark, sf_dir).select("conv_id", "turn", text.expand_query(F.col("text"), words).alias("expanded"))


@R.add("STR5", r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '\s*\n+\s*', ' ', 'g'), '\s+', ' ', 'g'))) AS normal_md5 FROM documents""")
def session_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_session_text(F.col("text"))).alias("normal_md5"))


@R.add("STR6", rf"""SELECT {TURN}, CASE WHEN role = 'system' THEN NULL ELSE nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') END AS body FROM conversations""")
def block_text(spark, sf_dir):
    blocks = F.array(
        F.struct(F.lit("tool_use").alias("type"), F.lit("ignored").alias("text")),
        F.struct(F.when(F.col("role") == "system", "image").otherwise("text").alias("type"), F.col("text").alias("text")),
    )
    parsed = F.from_json(F.to_json(blocks), "array<struct<type:string,text:string>>")
    return _turns(spark, sf_dir).select("conv_id", "turn", text.blocks_text(parsed).alias("body"))


@R.add("STR8", "SELECT doc_id, CASE WHEN n_lines >= 2 THEN 20 ELSE 2 END AS source_line FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents)")
def line_remap(spark, sf_dir):
    lines = F.sequence(F.lit(1), F.size(F.split("text", "\n")))
    return table(spark, sf_dir, "documents").select("doc_id", text.remap_line(F.transform(lines, lambda i: i * 10), F.lit(2)).alias("source_line"))


@R.add("STR17", r"""SELECT page_id, CASE WHEN p > 0 THEN CAST(p - 1 AS INTEGER) END AS place FROM
    (SELECT page_id, strpos(' ' || translate(lower(url), '-_./:#@', '       '), ' example') AS p FROM pages)""")
def word_boundary(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.word_boundary_index(F.col("url"), "Example").alias("place"))


@R.add("STR18", "SELECT c_custkey, lower(concat_ws(' ', nullif(c_name, ''), nullif(c_mktsegment, ''))) AS search_text FROM customer")
def search_text(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.search_text(F.col("c_name"), F.col("c_mktsegment"), F.lit("")).alias("search_text"))


_SLUG = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '{1}', '-', 'g'), '{2}', '-', 'g'), '-{{2,}}', '-', 'g'), '{3}', '', 'g')"


@R.add("STR19", "SELECT p_partkey, " + _SLUG.format("lower(trim(p_name))", r"\s+", "[^a-z0-9#@._+-]+", "^[-.]+|[-.]+$") + " AS hyphen_slug, "
    + _SLUG.format("regexp_replace(lower(trim('#' || p_type)), '^[@#]+', '')", r"[\s_]+", "[^a-z0-9-]+", "^-+|-+$") + " AS at_slug FROM part")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.hyphen_slug(F.col("p_name")).alias("hyphen_slug"), text.at_hash_slug(F.concat(F.lit("#"), "p_type")).alias("at_slug"))


_MD = "regexp_replace({0}, '{1}', '{2}', 'g')"


def _duck_markdown(c: str) -> str:
    for pattern, by in ((r"!\[[^\]]*\]\([^)]+\)", ""), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"```(?:[^\n]*?```|[^\n]*\n([\s\S]*?)```)", r"\1"), ("`([^`]+)`", r"\1"),
                        (r"(?m)^#{1,6}\s+", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""), (r"\r", ""), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")):
        c = _MD.format(c, pattern, by)
    return f"trim({c}, ' ')"


_PAGE_MD = "'# ' || url || chr(10) || '- [link](' || url || ') and `code`' || chr(10) || '1. item  two' || chr(10) || chr(10) || chr(10) || '![x](y.png) end'"


@R.add("STR21", f"SELECT page_id, {_duck_markdown(_PAGE_MD)} AS plain FROM pages")
def markdown_text(spark, sf_dir):
    source = F.concat(F.lit("# "), "url", F.lit("\n- [link]("), "url", F.lit(") and `code`\n1. item  two\n\n\n![x](y.png) end"))
    return table(spark, sf_dir, "pages").select("page_id", text.markdown_to_text(source).alias("plain"))


@R.add("STR22", r"""SELECT conv_id, turn, regexp_replace(text || chr(8203) || 'x' || chr(8238) || chr(917569), '[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{206A}-\x{206F}\x{FEFF}\x{E0000}-\x{E007F}]', '', 'g') AS visible FROM conversations""")
def visible(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", text.strip_invisible(F.concat("text", F.lit("​x‮\U000e0041"))).alias("visible"))


@R.add("STR25", rf"""SELECT {TURN}, CASE WHEN length(t) <= 40 THEN t ELSE regexp_replace(substr(t, 1, 39), '\s+$', '') || '…' END AS line
    FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)""")
def summary(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", text.summary_line(F.col("text"), 40).alias("line"))


@R.add("STR26", """SELECT event_id, CASE WHEN regexp_matches(props, '[",\\n]') THEN '"' || replace(props, '"', '""') || '"' ELSE coalesce(props, '') END AS cell FROM events""")
def csv_cell(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.csv_escape(F.col("props")).alias("cell"))


@R.add("STR27", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@R.add("STR28", r"""SELECT p_partkey, path, coalesce(path IN ('MEMORY.md', 'memory.md') OR starts_with(path, 'memory/'), false) AS is_memory FROM
    (SELECT p_partkey, replace(regexp_replace(trim('./' || CASE p_size % 3 WHEN 0 THEN 'memory/' || p_name WHEN 1 THEN 'MEMORY.md' ELSE 'notes\' || p_name END), '^[./]+', ''), '\', '/') AS path FROM part)""")
def rel_paths(spark, sf_dir):
    raw = F.concat(F.lit("./"), F.expr(r"CASE p_size % 3 WHEN 0 THEN 'memory/' || p_name WHEN 1 THEN 'MEMORY.md' ELSE concat('notes', chr(92), p_name) END"))
    return table(spark, sf_dir, "part").select("p_partkey", text.rel_path(raw).alias("path"), text.is_memory_path(raw).alias("is_memory"))


@R.add("STR29", """SELECT conv_id, sha256(string_agg(fp, '|' ORDER BY turn)) AS digest FROM
    (SELECT conv_id, turn, sha256('{"role":"' || role || '","turn":' || turn || '}') AS fp FROM conversations) GROUP BY conv_id""")
def canonical_digest(spark, sf_dir):
    """Fingerprint of each message's canonical JSON (keys sorted), and the digest of a session's fingerprints in order."""
    fp = F.sha2(F.to_json(F.struct("role", "turn")), 256)
    rows = _turns(spark, sf_dir).select("conv_id", "turn", fp.alias("fp"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "fp")))
    return rows.groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["fp"]), "|"), 256).alias("digest"))


@R.add("STR30", r"""SELECT page_id, list_aggregate(list_transform(f[1:3], lambda x: x), 'string_agg', ' ') AS links FROM
    (SELECT page_id, [u, 'http://b.example/2'] AS f FROM (SELECT page_id, regexp_extract(url, '\S+') AS u FROM pages))""")
def link_extraction(spark, sf_dir):
    message = F.concat(F.lit("see "), "url", F.lit(" and [md](https://hidden.example/1) then http://b.example/2 "), "url", F.lit(" http://localhost/x"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.links(message, 3), " ").alias("links"))


@R.add("STR31", r"""SELECT p_partkey, list_max(list_filter(list_transform(regexp_extract_all(lower(name), '(?:^|[^a-z0-9])[a-z]?(\d+(?:\.\d+)?)b(?:[^a-z0-9]|$)', 1), lambda x: CAST(x AS DOUBLE)), lambda x: x > 0)) AS b
    FROM (SELECT p_partkey, 'model-' || p_size || 'b-' || (p_partkey % 9) || '.5B' AS name FROM part)""")
def b_number(spark, sf_dir):
    name = F.concat(F.lit("model-"), F.col("p_size").cast("string"), F.lit("b-"), (F.col("p_partkey") % 9).cast("string"), F.lit(".5B"))
    return table(spark, sf_dir, "part").select("p_partkey", text.largest_b_number(name).alias("b"))


@R.add("STR32", r"""SELECT page_id, regexp_matches(url, '(?i)^http.*\.example\.[^/]*/en/.*$') AS deep, regexp_matches(url, '(?i)^https://[^/]*/[^/]*$') AS flat FROM pages""")
def path_globs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").rlike(text.path_glob("http**.example.*/en/**")).alias("deep"), F.col("url").rlike(text.path_glob("https://*/*")).alias("flat"))


@R.add("STR33", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::BIGINT * 1048576 WHEN 1 THEN p_size::BIGINT * 1024 WHEN 2 THEN p_size::BIGINT END AS bytes FROM part""")
def byte_sizes(spark, sf_dir):
    raw = F.concat(F.col("p_size").cast("string"), F.element_at(F.array(F.lit("mb"), F.lit(" KB"), F.lit(""), F.lit("xx")), (F.col("p_partkey") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", text.byte_size(raw).alias("bytes"))


@R.add("PRJ1", f"SELECT {TURN}, substr(text, 1, 30) AS snippet FROM conversations")
def snippet(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.substring("text", 1, 30).alias("snippet"))


@R.add("PRJ2", """SELECT doc_id, CASE WHEN s = e THEN p || '#L' || s ELSE p || '#L' || s || '-L' || e END AS citation
    FROM (SELECT doc_id, source || '/' || doc_id || '.md' AS p, doc_id % 7 + 1 AS s, doc_id % 7 + 1 + doc_id % 3 AS e FROM documents)""")
def citation(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("p"), (F.col("doc_id") % 7 + 1).alias("s"), (F.col("doc_id") % 7 + 1 + F.col("doc_id") % 3).alias("e"))
    one = F.concat("p", F.lit("#L"), F.col("s").cast("string"))
    return d.select("doc_id", F.when(F.col("s") == F.col("e"), one).otherwise(F.concat(one, F.lit("-L"), F.col("e").cast("string"))).alias("citation"))


_KEYS_SPARK = "CASE event_type WHEN 'view' THEN concat('agent:A', user_id, ':discord:group:g', event_id) WHEN 'click' THEN concat('Agent:b', user_id, ':slack:channel:c:thread:', event_id) WHEN 'purchase' THEN concat('agent:c:cron:job', user_id, ':run:', event_id) WHEN 'signup' THEN concat('discord:acc:guild-', user_id, ':channel-', event_id) ELSE concat('agent:d:x:subagent:', user_id, ':subagent:dm:', event_id) END"


@R.add("PRJ3", """SELECT event_id, CASE event_type WHEN 'view' THEN 'group' WHEN 'click' THEN 'channel' WHEN 'purchase' THEN 'unknown' WHEN 'signup' THEN 'channel' ELSE 'direct' END AS chat_type FROM events""")
def chat_types(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("key", F.expr(_KEYS_SPARK))
    return e.select("event_id", keys.chat_type(F.col("key")).alias("chat_type"))


@R.add("PRJ4", """SELECT event_id, CASE event_type WHEN 'view' THEN 'a' || user_id WHEN 'click' THEN 'b' || user_id WHEN 'purchase' THEN 'c' WHEN 'signup' THEN NULL ELSE 'd' END AS agent_id,
    CASE event_type WHEN 'view' THEN 'discord:group:g' || event_id WHEN 'click' THEN 'slack:channel:c:thread:' || event_id WHEN 'purchase' THEN 'cron:job' || user_id || ':run:' || event_id
      WHEN 'signup' THEN NULL ELSE 'x:subagent:' || user_id || ':subagent:dm:' || event_id END AS rest FROM events""")
def parsed_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("key", F.expr(_KEYS_SPARK))
    return e.select("event_id", keys.agent_id(F.col("key")).alias("agent_id"), keys.rest(F.col("key")).alias("rest"))


@R.add("PRJ5", """SELECT event_id, event_type = 'purchase' AS is_cron_run, CASE WHEN event_type = 'error' THEN 2 ELSE 0 END AS depth,
    CASE WHEN event_type = 'click' THEN 'Agent:b' || user_id || ':slack:channel:c' END AS parent FROM events""")
def key_predicates(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("key", F.expr(_KEYS_SPARK))
    return e.select("event_id", keys.is_cron_run(F.col("key")).alias("is_cron_run"), keys.subagent_depth(F.col("key")).alias("depth"), keys.thread_parent(F.col("key")).alias("parent"))


@R.add("PRJ6", """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN greatest(0.0, 8000.0 - c_acctbal) END AS remaining, CASE WHEN c_acctbal >= 0 THEN least(999.0, floor(100 * c_acctbal / 8000.0 + 0.5)) END AS percent FROM customer""")
def context_use(spark, sf_dir):
    total = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    left, percent = usage.context_use(total, F.lit(8000.0))
    return table(spark, sf_dir, "customer").select("c_custkey", left.alias("remaining"), percent.cast("double").alias("percent"))


# --- dates ---------------------------------------------------------------------------------------


@R.add("DT1", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN epoch_ms(date_trunc('day', o_orderdate)) END AS ms FROM orders""")
def strict_dates(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd"))).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", timefns.strict_date_ms(raw).alias("ms"))


@R.add("DT2", """SELECT p_partkey, CASE WHEN p_size <= 14 THEN CASE WHEN p_partkey % 2 = 0 THEN p_size * 60 ELSE -p_size * 60 END END AS minutes FROM part""")
def offsets(spark, sf_dir):
    raw = F.concat(F.when(F.col("p_partkey") % 2 == 0, "UTC+").otherwise("UTC-"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", timefns.utc_offset_minutes(raw).alias("minutes"))


@R.add("DT3", "SELECT event_id, user_id FROM events WHERE (epoch_us(ts) // 1000) BETWEEN epoch_ms(TIMESTAMP '2024-01-09 18:30:00') AND epoch_ms(TIMESTAMP '2024-01-12 18:30:00') - 1")
def date_ranges(spark, sf_dir):
    span = timefns.date_range(NOW_MS, "2024-01-10", "2024-01-12", mode="specific", utc_offset="UTC+5:30")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").filter(ms.between(span.start_ms, span.end_ms)).select("event_id", "user_id")


@R.add("DT4", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN epoch_ms(o_orderdate) WHEN 1 THEN epoch_ms(date_trunc('day', o_orderdate)) WHEN 2 THEN epoch_ms(o_orderdate) END AS ms FROM orders""")
def absolute_times(spark, sf_dir):
    ts = F.col("o_orderdate").cast("timestamp")
    kind = (F.col("o_orderkey") % 4).cast("int") + 1
    raw = F.element_at(F.array(F.unix_millis(ts).cast("string"), F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("soon")), kind)
    return table(spark, sf_dir, "orders").select("o_orderkey", timefns.absolute_time_ms(raw).alias("ms"))


@R.add("DT5", f"""SELECT p_partkey, CASE WHEN {NOW_MS} < a THEN a ELSE a + greatest(1, ({NOW_MS} - a + e - 1) // e) * e END AS next_every, CASE WHEN due > {NOW_MS} THEN due END AS next_at
    FROM (SELECT p_partkey, p_size::BIGINT * 60000 AS e, {NOW_MS} + (p_partkey % 100 - 80) * 1000003 AS a, {NOW_MS} + (p_partkey % 50 - 25) * 1000 AS due FROM part)""")
def next_runs(spark, sf_dir):
    """Periodic and one-off schedules; cron expressions are in DT5_cron."""
    now = F.lit(NOW_MS)
    every, anchor = F.col("p_size").cast("long") * 60000, F.lit(NOW_MS) + (F.col("p_partkey") % 100 - 80) * 1000003
    return table(spark, sf_dir, "part").select("p_partkey", timefns.next_every(now, every, anchor).alias("next_every"), timefns.next_at(now, now + (F.col("p_partkey") % 50 - 25) * 1000).alias("next_at"))


@R.add("DT7", """SELECT c_custkey, ('0x' || substr(sha256('job-' || c_custkey), 1, 8))::BIGINT % 300000 AS offset_ms, c_custkey % 2 = 0 AS top FROM customer""")
def stagger(spark, sf_dir):
    expr = F.when(F.col("c_custkey") % 2 == 0, "0 */2 * * *").otherwise("5 * * * *")
    job = F.concat(F.lit("job-"), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", timefns.stagger_offset_ms(job, F.lit(300_000)).alias("offset_ms"), timefns.is_top_of_hour(expr).alias("top"))


@R.add("DT8", f"""SELECT event_id, round(value * exp(-ln(2) / 30 * greatest(0.0, ({NOW_MS} - (epoch_us(ts) // 1000)) / 86400000.0::DOUBLE)), 6) AS decayed FROM events""")
def decayed(spark, sf_dir):
    age = (F.lit(NOW_MS) - F.unix_millis(F.col("ts").cast("timestamp"))) / timefns.DAY_MS
    return table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") * timefns.decay(age, 30), 6).alias("decayed"))


@R.add("DT9", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_ms(date_trunc('day', ts)) WHEN 1 THEN NULL WHEN 2 THEN 5 ELSE 7 END AS ms FROM events""")
def decay_times(spark, sf_dir):
    day = F.date_format("ts", "yyyy-MM-dd")
    path = F.expr("CASE event_id % 4 WHEN 0 THEN concat('./memory/', date_format(ts, 'yyyy-MM-dd'), '.md') WHEN 1 THEN 'memory/topic.md' WHEN 2 THEN 'sessions/x.md' ELSE 'memory/2024-02-31.md' END")
    source = F.when(F.col("event_id") % 4 == 2, "sessions").otherwise("memory")
    mtime = F.when(F.col("event_id") % 4 == 2, 5).otherwise(7).cast("long")
    return table(spark, sf_dir, "events").withColumn("day", day).select("event_id", timefns.decay_time_ms(path, source, mtime).alias("ms"))


@R.add("DT10", """SELECT event_id, CAST(floor(((epoch_us(ts) // 1000) - 4 * 3600000) / 86400000.0) AS BIGINT) * 86400000 + 4 * 3600000 AS reset_ms FROM events""")
def reset_boundary(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", timefns.daily_reset_ms(F.unix_millis(F.col("ts").cast("timestamp")), 4).alias("reset_ms"))


@R.add("DT11", """WITH t AS (SELECT o_orderkey, CAST(floor(o_totalprice * 977) AS BIGINT) AS ms FROM orders), u AS (SELECT *, CAST(floor(ms / 1000.0 + 0.5) AS BIGINT) AS s FROM t),
    v AS (SELECT *, s // 3600 AS h, s % 3600 // 60 AS m, s % 60 AS x, CAST(floor(s / 60.0 + 0.5) AS BIGINT) AS am FROM u), w AS (SELECT *, CAST(floor(am / 60.0 + 0.5) AS BIGINT) AS ah FROM v)
    SELECT o_orderkey, CASE WHEN ms <= 0 THEN NULL WHEN ms < 1000 THEN ms || 'ms' WHEN h >= 24 THEN (h // 24) || 'd' || CASE WHEN h % 24 > 0 THEN (h % 24) || 'h' ELSE '' END
      WHEN h > 0 THEN h || 'h' || CASE WHEN m > 0 THEN m || 'm' ELSE '' END WHEN m > 0 THEN m || 'm' || CASE WHEN x > 0 THEN x || 's' ELSE '' END ELSE x || 's' END AS compact,
      CASE WHEN am < 1 THEN 'just now' WHEN am < 60 THEN am || 'm ago' WHEN ah < 48 THEN ah || 'h ago' ELSE CAST(floor(ah / 24.0 + 0.5) AS BIGINT) || 'd ago' END AS ago FROM w""")
def durations(spark, sf_dir):
    ms = F.floor(F.col("o_totalprice") * 977).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", timefns.duration_compact(ms).alias("compact"), timefns.time_ago(ms).alias("ago"))


@R.add("DT12", """WITH t AS (SELECT o_orderkey, CAST(floor(o_totalprice * 4001) AS BIGINT) - 9000000 AS d FROM orders), u AS (SELECT *, d // 60000 AS m FROM t)
    SELECT o_orderkey, CASE WHEN d <= 0 THEN 'now' WHEN m < 60 THEN m || 'm' WHEN m // 60 < 24 THEN (m // 60) || 'h' || CASE WHEN m % 60 > 0 THEN ' ' || (m % 60) || 'm' ELSE '' END
      WHEN m // 1440 < 7 THEN (m // 1440) || 'd ' || (m // 60 % 24) || 'h' ELSE strftime(epoch_ms(1706745600000 + d), '%b %-d') END AS remaining FROM u""")
def resets(spark, sf_dir):
    target = F.lit(NOW_MS) + F.floor(F.col("o_totalprice") * 4001).cast("long") - 9_000_000
    return table(spark, sf_dir, "orders").select("o_orderkey", timefns.reset_remaining(target, F.lit(NOW_MS)).alias("remaining"))


@R.add("DT13", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::BIGINT * 3600000 + 1800000 WHEN 1 THEN p_size::BIGINT * 500 WHEN 2 THEN p_size::BIGINT END AS ms FROM part""")
def duration_parse(spark, sf_dir):
    size = F.col("p_size").cast("string")
    raw = F.element_at(F.array(F.concat(size, F.lit("h30m")), F.concat((F.col("p_size") * 500).cast("string"), F.lit("MS")), size, F.concat(size, F.lit("h x"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", timefns.duration_ms(raw).alias("ms"))


# --- numbers -------------------------------------------------------------------------------------

_FIRST_VECTOR = "(SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1)"


@R.add("MTH1", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, {_FIRST_VECTOR}")
def cosines(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    query = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))  # one row
    return e.join(F.broadcast(query)).select("vec_id", F.round(vector.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))


@R.add("MTH2", """SELECT vec_id, round(v[1] / n, 6) AS first, round(list_sum(list_transform(v, lambda x: (x / n) * (x / n))), 6) AS square
    FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)""")
def normalised_vectors(spark, sf_dir):
    u = table(spark, sf_dir, "embeddings").select("vec_id", vector.unit(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(vector.dot(F.col("u"), F.col("u")), 6).alias("square"))


@R.add("MTH3", "SELECT c_custkey, round(CASE WHEN c_acctbal < 0 THEN -c_acctbal / (1 - c_acctbal) ELSE 1 / (1 + c_acctbal) END, 6) AS score FROM customer")
def rank_scores(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(vector.rank_score(F.col("c_acctbal")), 6).alias("score"))


@R.add("MTH4", "SELECT l_orderkey, l_linenumber, round(0.7 * l_discount + 0.3 * l_tax, 6) AS score FROM lineitem")
def fusion_scores(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(vector.fused(F.col("l_discount"), F.col("l_tax"), 0.7, 0.3), 6).alias("score"))


@R.add("MTH5", "SELECT l_orderkey, l_linenumber, round((l_quantity * 3 + l_extendedprice * 15 + l_discount * 0.3) / 1000000, 8) AS cost FROM lineitem")
def cost_estimates(spark, sf_dir):
    used = {"input": F.col("l_quantity"), "output": F.col("l_extendedprice"), "cache_read": F.col("l_discount"), "cache_write": F.lit(None).cast("double")}
    price = {"input": F.lit(3.0), "output": F.lit(15.0), "cache_read": F.lit(0.3), "cache_write": F.lit(3.75)}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(usage.cost(used, price), 8).alias("cost"))


@R.add("MTH6", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN greatest(0.0, k - 50) WHEN 1 THEN NULL END AS input, CASE event_id % 3 WHEN 0 THEN k WHEN 1 THEN NULL END AS output, CASE event_id % 3 WHEN 1 THEN k END AS cache_read, event_id % 3 = 2 AS missing
    FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""")
def usage_normalised(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    raw = F.element_at(F.array(F.to_json(F.struct((k - 50).alias("prompt_tokens"), k.alias("completionTokens"))), F.to_json(F.struct(F.struct(k.alias("cached_tokens")).alias("prompt_tokens_details"))), F.lit("{}")), (F.col("event_id") % 3 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", usage.normalized(raw).alias("u"))
    return e.select("event_id", "u.input", "u.output", "u.cache_read", F.col("u").isNull().alias("missing"))


@R.add("MTH7", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN 2400027.0 WHEN l_quantity + l_discount > 0 THEN l_quantity + l_discount END AS prompt_tokens FROM lineitem""")
def prompt_sizes(spark, sf_dir):
    own = usage.prompt_tokens(F.col("l_quantity"), F.col("l_discount"), F.lit(None).cast("double"), F.when(F.col("l_linenumber") == 2, 2400027.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", own.alias("prompt_tokens"))


@R.add("MTH8", "SELECT c_custkey, greatest(0.0, least(100.0, c_acctbal / 10)) AS percent FROM customer")
def percents(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", usage.clamp_percent(F.col("c_acctbal") / 10).alias("percent"))


@R.add("MTH9", "SELECT p_partkey, least(30000.0, floor(100 * pow(2.0, greatest(p_size - 1, 0)) * (1 + 0.25 * (p_partkey % 4) / 4) + 0.5)) AS delay FROM part")
def backoffs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", usage.backoff_ms(F.col("p_size"), 100.0, 2.0, 30000.0, 0.25 * (F.col("p_partkey") % 4) / 4).cast("double").alias("delay"))


@R.add("MTH10", """SELECT o_orderkey, CASE WHEN v >= 999500 THEN printf('%.1fm', v / 1e6) WHEN v >= 10000 THEN printf('%.0fk', v / 1e3) WHEN v >= 1000 THEN printf('%.1fk', v / 1e3) ELSE CAST(floor(v + 0.5) AS BIGINT)::VARCHAR END AS tokens,
    '$' || CASE WHEN c >= 0.01 THEN printf('%.2f', c) ELSE printf('%.4f', c) END AS usd FROM (SELECT o_orderkey, floor(o_totalprice) * 7 + 0.25 AS v, (o_orderkey % 1000 * 4 + 1) / 3200.0 AS c FROM orders)""")
def number_formats(spark, sf_dir):
    v, c = F.floor("o_totalprice") * 7 + 0.25, (F.col("o_orderkey") % 1000 * 4 + 1) / 3200.0
    return table(spark, sf_dir, "orders").select("o_orderkey", usage.token_count(v).alias("tokens"), usage.usd(c).alias("usd"))


@R.add("MTH11", """SELECT p_partkey, CASE WHEN h >= 168 THEN 'Week' WHEN h < 24 THEN h || 'h' WHEN p_partkey % 2 = 0 THEN 'Week' ELSE 'Day' END AS label FROM (SELECT p_partkey, p_size * 4 AS h FROM part)""")
def window_labels(spark, sf_dir):
    reset = F.when(F.col("p_partkey") % 2 == 0, 3 * 86_400).otherwise(86_400)
    return table(spark, sf_dir, "part").select("p_partkey", usage.window_label(F.col("p_size") * 4, reset, F.lit(0)).alias("label"))


# --- arrays and JSON -----------------------------------------------------------------------------


def batched(items, n: int):
    """An array cut into slices of n; one slice if n isn't positive."""
    if n <= 0:
        return F.array(items)
    starts = F.sequence(F.lit(0), F.ceil(F.size(items) / n).cast("int") - 1)
    return F.when(F.size(items) == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(starts, lambda i: F.slice(items, i * n + 1, n)))


@R.add("ARR1", "SELECT doc_id, b - 1 AS batch, least(10, n - (b - 1) * 10) AS size FROM (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents), range(1, 100000) r(b) WHERE (b - 1) * 10 < n")
def batches(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(batched(F.split("text", " "), 10)).alias("batch", "items"))
    return d.select("doc_id", F.col("batch").cast("long").alias("batch"), F.size("items").cast("long").alias("size"))


@R.add("JSN1", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def tolerant_json(spark, sf_dir):
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{broken"), "props")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").withColumn("raw", raw).select("event_id", F.expr("try_variant_get(try_parse_json(raw), '$.k', 'long')").alias("k"))


@R.add("JSN3", """SELECT conv_id, turn, strlen('{"role":"' || role || '","turn":' || turn || '}') AS bytes FROM conversations""")
def json_bytes(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.octet_length(F.to_json(F.struct("role", "turn"))).cast("long").alias("bytes"))
