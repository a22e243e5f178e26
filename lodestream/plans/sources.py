"""Sources, sinks and record parsers (SRC*, SNK4-8, JSN2, JSN4, PRJ7) over records rendered from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestream.operators import documents as docs
from lodestream.plans.registry import Registry
from lodestream.session import scratch, table
from lodestream.sources import readers, sinks

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def transcript_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as transcript lines: text or blocks as content, every fifth line of another type, some broken."""
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("line_no"), "role", "text")
    blocks = F.to_json(F.struct(F.lit("message").alias("type"), F.struct("role", F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content")).alias("message")))
    plain = F.to_json(F.struct(F.lit("message").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    other = F.lit('{"type":"custom","message":{"role":"user","content":"x"}}')
    kind = F.col("line_no") % 5
    return c.withColumn("line", F.when(kind == 0, other).when(kind == 4, F.concat(F.lit("{"), plain)).when(kind == 1, blocks).otherwise(plain))


_TURNS = r"SELECT conv_id, turn + 1 AS line_no, role, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^$', '') AS body FROM conversations WHERE (turn + 1) % 5 NOT IN (0, 4) AND role IN ('user', 'assistant')"


@R.add("SRC4", f"SELECT conv_id, line_no, upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || body AS flat FROM ({_TURNS}) WHERE body <> ''")
def transcript_scan(spark, sf_dir):
    return readers.transcript_lines(transcript_records(spark, sf_dir)).select("conv_id", "line_no", "flat")


@R.add("SRC4_files", f"SELECT conv_id, count(*) AS messages FROM ({_TURNS}) WHERE body <> '' GROUP BY conv_id")
def transcript_files(spark, sf_dir):
    """Written as files and read back with the line numbers of each."""
    at = scratch(spark)
    transcript_records(spark, sf_dir).select(F.concat_ws("\t", F.col("conv_id").cast("string"), "line").alias("value")).write.text(at)
    back = readers.lines(spark, at).filter("line <> ''")
    parts = back.select(F.split("line", "\t", 2).alias("p"))
    return readers.transcript(parts.select(F.get("p", F.lit(0)).cast("long").alias("conv_id"), F.get("p", F.lit(1)).alias("line"))).groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"))


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    good = F.to_json(F.struct((F.unix_millis(F.col("ts").cast("timestamp"))).alias("ts"), F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("jobId"), F.when(F.col("event_type") == "view", "started").otherwise("finished").alias("action"), F.col("event_type").alias("status"), F.struct(F.floor("value").alias("input_tokens")).alias("usage")))
    return e.select("event_id", F.when(F.col("event_id") % 9 == 0, F.lit("{broken")).when(F.col("event_id") % 9 == 1, F.lit('{"ts": 1, "jobId": " ", "action": "finished"}')).otherwise(good).alias("line"))


@R.add("SRC5", "SELECT (epoch_us(ts) // 1000) AS ts, 'job-' || user_id AS job_id, event_type AS status, CAST(floor(value) AS BIGINT) AS tokens FROM events WHERE event_type <> 'view' AND event_id % 9 > 1")
def run_log_scan(spark, sf_dir):
    return readers.run_log(run_records(spark, sf_dir)).select("ts", "job_id", "status", F.get_json_object("usage", "$.input_tokens").cast("long").alias("tokens"))


@R.add("SRC6", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 500")
def log_tail(spark, sf_dir):
    return readers.tail(table(spark, sf_dir, "events").select("event_id"), "event_id", 500)


@R.add("SRC6_cursor", "SELECT doc_id, CASE WHEN n > 1500 THEN n - 1000 WHEN n >= 500 THEN 500 ELSE greatest(0, n - 1000) END AS start, n < 500 OR n - 500 > 1000 AS reset FROM (SELECT doc_id, strlen(text) AS n FROM documents)")
def cursor_tail(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", readers.byte_tail(F.col("text"), 500, 1000).alias("t"))
    return d.select("doc_id", F.col("t.start").cast("long").alias("start"), F.col("t.reset").alias("reset"))


@R.add("SRC8", "SELECT c_nationkey, 'key-' || c_custkey AS key, 's' || c_custkey AS session_id, c_custkey * 1000 AS updated_at FROM customer")
def session_store(spark, sf_dir):
    entry = F.struct(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("sessionId"), (F.col("c_custkey") * 1000).alias("updatedAt"))
    maps = F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("key-"), F.col("c_custkey").cast("string")), entry))))
    stores = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(maps.alias("json"))
    return readers.session_store(stores).select("c_nationkey", "key", "session_id", "updated_at")


@R.add("SRC9", "SELECT n_name AS store_path FROM nation")
def all_stores(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.col("n_name").alias("store_path"), F.lit(1).alias("agent"))
    return readers.all_stores(a, a.select("store_path"), a.filter("store_path > 'F'")).select("store_path")


@R.add("SRC11", "SELECT vec_id, round(sqrt(list_sum(list_transform(list_transform(v, lambda x: x / n), lambda x: x * x))), 6) AS length FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)")
def embedding_source(spark, sf_dir):
    """Vectors as they come from a provider, cleaned and scaled."""
    from lodestream.functions import vector

    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.norm(vector.unit(F.col("embedding"))), 6).alias("length"))


@R.add("SRC12", "SELECT doc_id, md5(coalesce(list_aggregate(string_split(text, chr(10))[2:3], 'string_agg', chr(10)), '')) AS part FROM documents")
def ranged_read(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(readers.file_slice(F.col("text"), 2, 2)).alias("part"))


@R.add("SRC14", "WITH l AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT user_id, event_id FROM l WHERE n = 1 AND event_type <> 'error'")
def compacted(spark, sf_dir):
    return readers.latest_records(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type").select("user_id", "event_id")


@R.add("SRC15", "SELECT event_id FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 50) WHERE event_id % 9 <> 0")
def last_lines(spark, sf_dir):
    """The cut comes before the validation."""
    last = readers.tail(run_records(spark, sf_dir), "event_id", 50)
    return last.filter(F.try_parse_json("line").isNotNull()).select("event_id")


@R.add("SRC1", "SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'MEMORY.md' ELSE 'memory/' || n_nationkey || '.md' END AS path, sha256(n_name) AS hash FROM nation WHERE n_nationkey % 5 <> 0 OR n_nationkey = 0")
def markdown_scan(spark, sf_dir):
    """Each nation as a file of a memory folder, scanned; what lies elsewhere isn't part of it."""
    at = scratch(spark)
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():  # a table of fixed size
        name = "MEMORY.md" if r[0] == 0 else f"notes/{r[0]}.md" if r[0] % 5 == 0 else f"memory/{r[0]}.md"
        sinks.JsonStore(spark, f"{at}/{name}").write(r[1])
    found = readers.markdown_files(spark, at)
    return found.select(F.regexp_extract("path", "((?:memory/[^/]+|MEMORY)\\.md)$", 1).alias("path"), F.sha2("content", 256).alias("hash"))


@R.add("SRC2", "SELECT n_nationkey, strlen(n_name) + 1 AS size, sha256(n_name || chr(10)) AS hash FROM nation")
def file_fingerprints(spark, sf_dir):
    at = scratch(spark)
    table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"), "n_name").repartition(25, "k").write.partitionBy("k").text(at)
    return readers.fingerprints(spark, at, glob="*.txt").select(F.regexp_extract("path", "/k=([0-9]+)/", 1).cast("int").alias("n_nationkey"), "size", "hash")


@R.add("SRC3", "SELECT r_regionkey, strlen(r_name) AS size FROM region WHERE r_regionkey <> 2")
def listed_files(spark, sf_dir):
    at = scratch(spark)
    for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect():
        sinks.JsonStore(spark, f"{at}/{r[0]}.{'jsonl' if r[0] != 2 else 'txt'}").write(r[1])
    return readers.files_of(spark, at).select(F.regexp_extract("path", "([0-9]+)[.]jsonl$", 1).cast("int").alias("r_regionkey"), "size")


@R.add("SRC7", "SELECT 'gateway-2024-01-' || (10 + max(r_regionkey)) || '.log' AS name, max_by(r_name, r_regionkey) AS line FROM region")
def newest_log(spark, sf_dir):
    """Among a log for each region's day and another file, the newest log."""
    at = scratch(spark)
    sinks.JsonStore(spark, f"{at}/other.log").write("z")
    for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect():
        sinks.JsonStore(spark, f"{at}/gateway-2024-01-{10 + r[0]}.log").write(r[1])
    found = readers.rolling_log(spark, at).first()
    return spark.read.text(found["path"]).select(F.lit(found["path"].rpartition("/")[2]).alias("name"), F.col("value").alias("line"))


@R.add("SNK4", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE n_name END AS n_name FROM nation UNION ALL SELECT 100, 'added'")
def chunk_upsert(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    new = n.filter("n_nationkey % 2 = 0").select("n_nationkey", F.lit("new").alias("n_name")).unionByName(spark.createDataFrame([(100, "added")], "n_nationkey int, n_name string"))
    store = sinks.VersionedTable(spark, scratch(spark))
    store.replace(n)
    store.upsert(new, ["n_nationkey"])
    return store.read()


@R.add("SNK5", "SELECT n_nationkey, n_name FROM nation")
def atomic_reindex(spark, sf_dir):
    """A rewrite that fails leaves the version before."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    store = sinks.VersionedTable(spark, scratch(spark))
    store.replace(n)
    try:
        store.replace(n.withColumn("n_name", F.raise_error(F.lit("stopped")).cast("string")))
    except Exception as e:  # the failure is the point
        if "stopped" not in str(e):
            raise
    return store.read()


@R.add("SNK6", "SELECT r_regionkey, true AS first, false AS again, true AS changed, '{\"name\": \"' || r_name || '\"}' AS kept, '{\"key\": ' || r_regionkey || '}' AS now FROM region")
def json_store(spark, sf_dir):
    """Each region's store written, written again and changed; what the file holds then, and what its backup does."""
    at, done = scratch(spark), []
    for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect():
        store, old, new = sinks.JsonStore(spark, f"{at}/{r[0]}.json"), f'{{"name": "{r[1]}"}}', f'{{"key": {r[0]}}}'
        wrote = store.write(old), store.write(old), store.write(new)
        done.append((r[0], *wrote, sinks.JsonStore(spark, f"{at}/{r[0]}.json.bak").read(), store.read()))
    return spark.createDataFrame(done, "r_regionkey int, first boolean, again boolean, changed boolean, kept string, now string")


@R.add("SNK7", "SELECT CAST(r_regionkey + 8 AS BIGINT) AS stamp, 2 + length(r_name) AS bytes FROM region ORDER BY r_regionkey DESC LIMIT 3")
def rotation(spark, sf_dir):
    """A store of each region's name rotated again and again; the backups of the largest stamps stay."""
    at = scratch(spark)
    for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect():
        sinks.JsonStore(spark, f"{at}/s.json").write(f"[{r[1]}]")
        sinks.rotate(spark, f"{at}/s.json", 2, 3, str(r[0] + 8))
    found = spark.read.format("binaryFile").option("pathGlobFilter", "s.json.bak.*").load(at)
    return found.select(F.regexp_extract("path", "[0-9]+$", 0).cast("long").alias("stamp"), F.col("length").alias("bytes"))


# --- records -------------------------------------------------------------------------------------


@R.add("JSN2", "SELECT event_id, 'hello ' || event_id AS message, lower(event_type) AS level, 'gw' AS subsystem FROM events WHERE event_id % 6 <> 0")
def log_lines(spark, sf_dir):
    line = F.concat(F.lit('{"0":"hello","1":'), F.col("event_id").cast("string"), F.lit(',"_meta":{"logLevelName":"'), F.upper("event_type"), F.lit('","name":"{\\"subsystem\\":\\"gw\\"}","date":"d"}}'))
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 6 == 0, F.lit("no json")).otherwise(line).alias("line"))
    return readers.log_records(e).select("event_id", "message", "level", "subsystem")


@R.add("JSN4", "SELECT vec_id::VARCHAR AS custom_id, CASE vec_id % 4 WHEN 1 THEN 'bad' WHEN 2 THEN 'status 500' WHEN 3 THEN 'empty embedding' END AS error, CASE WHEN vec_id % 4 = 0 THEN len(embedding) END AS size FROM embeddings")
def batch_output(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    number = F.col("vec_id").cast("string")
    ok = F.to_json(F.struct(number.alias("custom_id"), F.struct(F.lit(200).alias("status_code"), F.struct(F.array(F.struct("embedding")).alias("data")).alias("body")).alias("response")))
    bad = lambda rest: F.concat(F.lit('{"custom_id":"'), number, F.lit(f'",{rest}}}'))
    kind = F.col("vec_id") % 4
    line = F.when(kind == 0, ok).when(kind == 1, bad('"error":{"message":"bad"}')).when(kind == 2, bad('"response":{"status_code":500}')).otherwise(bad('"response":{"status_code":200,"body":{"data":[{"embedding":[]}]}}'))
    out = readers.batch_output(e.select(line.alias("line")))
    return out.select("custom_id", "error", F.when(F.col("embedding").isNotNull(), F.size("embedding").cast("long")).alias("size"))


@R.add("PRJ7", """SELECT conv_id, turn, length(t) > 60 AS truncated, turn % 2 = 0 AS redacted, CASE WHEN length(t) <= 60 THEN t ELSE substr(t, 1, 60) || chr(10) || '…(truncated)…' END AS body FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'API_KEY=*** ' ELSE 'API KEY ' END || regexp_replace(text, '[^a-zA-Z ]', '', 'g') AS t FROM conversations)""")
def history_rows(spark, sf_dir):
    """Texts redacted, cut, and flagged."""
    raw = F.concat(F.when(F.col("turn") % 2 == 0, "API_KEY=short ").otherwise("API KEY "), F.regexp_replace("text", "[^a-zA-Z ]", ""))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw"), docs.redacted(raw).alias("t"))
    long = F.length("t") > 60
    return c.select("conv_id", "turn", long.alias("truncated"), (F.col("raw") != F.col("t")).alias("redacted"), F.when(long, F.concat(F.substring("t", 1, 60), F.lit("\n…(truncated)…"))).otherwise(F.col("t")).alias("body"))


@R.add("SRC10", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 1")
def provider_rows(spark, sf_dir):
    """What follows a fetch: rows whose error is an ignored one are left out (the fetch itself is a network source)."""
    ignored = ("No credentials", "No token", "No API key", "Not logged in", "No auth")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") == 1, "No token").alias("error"))
    return rows.filter(F.col("error").isNull() | ~F.col("error").isin(*ignored)).select("n_nationkey", "n_name")

