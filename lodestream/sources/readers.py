"""Readers and record parsers (SRC*, JSN2, JSN4): everything through Spark's own sources, so any store works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lodestream.functions import text


def markdown_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, content) of MEMORY.md, memory.md and everything under memory/, each path once."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(list(paths))
    own = F.col("path").rlike(r"/(MEMORY|memory)\.md$") | F.col("path").rlike(r"/memory/.*\.md$")
    return files.filter(own).dropDuplicates(["path"]).select("path", F.col("content").cast("string").alias("content"))


def fingerprints(spark: SparkSession, *paths: str, glob: str = "*") -> DataFrame:
    """(path, mtime_ms, size, hash)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(list(paths))
    return files.select("path", F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"))


def files_of(spark: SparkSession, folder: str, suffix: str = ".jsonl") -> DataFrame:
    """(path, mtime_ms, size) of a folder's own files, newest first."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select("path", F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size")).orderBy(F.desc("mtime_ms"), "path")


def rolling_log(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the newest dated log."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*-[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9].log").load(folder)
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).filter("path IS NOT NULL")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) with 1-based numbers: files are read whole, as numbers need a file's order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    each = whole.select("path", F.posexplode(F.split("value", "\n")).alias("at", "line"))
    return each.select("path", (F.col("at") + 1).alias("line_no"), "line")


BLOCK = "array<struct<type:string,text:string,name:string,is_error:boolean>>"


def transcript(records: DataFrame, line: str = "line") -> DataFrame:
    """records with role and body: messages of users and assistants, content as text or an array of blocks; blank and broken lines are left out."""
    v = F.try_parse_json(F.col(line))
    get = lambda path, kind="string": F.try_variant_get(F.col("_v"), path, kind)
    own = records.withColumn("_v", v).filter(F.col("_v").isNotNull() & (get("$.type") == "message"))
    content = F.get_json_object(line, "$.message.content")
    plain = F.when(~F.startswith(F.ltrim(content), F.lit("[")), F.nullif(text.normalize_session_text(content), F.lit("")))
    body = F.coalesce(text.blocks_text(F.from_json(content, BLOCK)), plain)
    kept = own.withColumns({"role": get("$.message.role"), "body": body}).drop("_v")
    return kept.filter(F.col("role").isin("user", "assistant") & F.col("body").isNotNull())


def transcript_lines(records: DataFrame, line: str = "line") -> DataFrame:
    """transcript() flattened to ``User: ...`` and ``Assistant: ...`` lines."""
    return transcript(records, line).withColumn("flat", F.concat(F.initcap("role"), F.lit(": "), F.col("body")))


def run_log(records: DataFrame, line: str = "line") -> DataFrame:
    """Finished runs with a finite ts and a job id: ts, job_id, status, model, provider, usage (JSON)."""
    one = F.from_json(line, "ts double, jobId string, action string, status string, model string, provider string")
    own = records.select(one.alias("r"), F.get_json_object(line, "$.usage").alias("usage"))
    good = (F.col("r.action") == "finished") & F.col("r.ts").isNotNull() & ~F.isnan("r.ts") & (F.trim(F.coalesce("r.jobId", F.lit(""))) != "")
    return own.filter(good).select(F.col("r.ts").cast("long").alias("ts"), F.trim("r.jobId").alias("job_id"), "r.status", "r.model", "r.provider", "usage")


def tail(records: DataFrame, order: str, limit: int = 500, most: int = 5000, by: str | None = None) -> DataFrame:
    """The last lines, in order; a limit outside 1 to ``most`` is clamped. Within one file the cut is a top-k, not a sort of all lines."""
    n = max(1, min(most, limit))
    if by is None:
        return records.orderBy(F.desc(order)).limit(n).orderBy(order)
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return records.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def byte_tail(content: Column, cursor: int | None, max_bytes: int) -> Column:
    """Struct (start, reset, truncated, body) of a log read from a byte cursor: it restarts near the end if the cursor is beyond it or too far back, and a partial first line is dropped."""
    raw = F.encode(content, "UTF-8")
    size = F.octet_length(content)
    last = F.greatest(F.lit(0), size - max_bytes)
    if cursor is None:
        start, reset = last, F.lit(False)
    else:
        reset = (F.lit(cursor) > size) | (size - cursor > max_bytes)
        start = F.when(reset, last).otherwise(F.lit(cursor))
    truncated = F.when(F.lit(cursor is None) | reset, start > 0).otherwise(F.lit(False))
    body = F.make_valid_utf8(raw.substr(start + 1, size).cast("string"))
    edge = (start > 0) & (F.hex(raw.substr(start, F.lit(1))) != "0A")
    clean = F.when(edge, F.when(F.contains(body, F.lit("\n")), F.regexp_replace(body, r"^[^\n]*\n", "")).otherwise("")).otherwise(body)
    return F.struct(start.alias("start"), reset.alias("reset"), truncated.alias("truncated"), clean.alias("body"))


def session_store(stores: DataFrame, body: str = "json") -> DataFrame:
    """stores' other columns with key, session_id, updated_at for every entry of a key -> entry map, newest first within no particular store."""
    entry = F.explode(F.from_json(body, "map<string,struct<sessionId:string,updatedAt:bigint,label:string>>")).alias("key", "e")
    return stores.select(*[c for c in stores.columns if c != body], entry).select(*[c for c in stores.columns if c != body], "key", F.col("e.sessionId").alias("session_id"), F.col("e.updatedAt").alias("updated_at"), F.col("e.label").alias("label"))


def all_stores(*stores: DataFrame) -> DataFrame:
    """The union of stores, each store path once."""
    out = stores[0]
    for s in stores[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.dropDuplicates(["store_path"])


def file_slice(content: Column, start: int = 1, count: int | None = None) -> Column:
    """``count`` lines from a 1-based line on; empty beyond the end or for a missing file."""
    parts = F.slice(F.split(content, "\n"), max(1, start), count if count is not None else 1 << 30)
    return F.coalesce(F.array_join(parts, "\n"), F.lit(""))


TERMINAL = ("completed", "hangup-user", "hangup-bot", "timeout", "error", "failed", "no-answer", "busy", "voicemail")


def latest_records(records: DataFrame, key: str, order: str, state: str, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """The last record of each key, unless it is in a final state: a maximum by order, combined before the shuffle."""
    newest = records.groupBy(key).agg(F.max_by(F.struct(*records.columns), order).alias("r")).select("r.*")
    return newest.filter(~F.coalesce(F.col(state).isin(*terminal), F.lit(False)))


def log_records(df: DataFrame, line: str = "line") -> DataFrame:
    """df with time, level, subsystem, module, message of structured log lines; other lines are left out. Numbered keys make the message, in their order."""
    fields = F.from_json(line, "map<string,string>")
    own = df.withColumns({"_m": fields, "_ok": F.try_parse_json(F.col(line)).isNotNull()}).filter("_ok AND _m IS NOT NULL")
    numbered = F.array_sort(F.transform(F.filter(F.map_keys("_m"), lambda k: k.rlike(r"^\d+$")), lambda k: F.struct(k.cast("int").alias("n"), k.alias("k"))))
    message = F.array_join(F.filter(F.transform(numbered, lambda x: F.element_at(F.col("_m"), x["k"])), lambda x: x.isNotNull()), " ")
    meta = F.col("_m")["_meta"]
    name = F.get_json_object(meta, "$.name")
    return own.withColumns({
        "time": F.coalesce(F.col("_m")["time"], F.get_json_object(meta, "$.date")), "level": F.lower(F.get_json_object(meta, "$.logLevelName")),
        "subsystem": F.get_json_object(name, "$.subsystem"), "module": F.get_json_object(name, "$.module"), "message": message,
    }).drop("_m", "_ok")


def batch_output(df: DataFrame, line: str = "line") -> DataFrame:
    """(custom_id, embedding, error) of a provider's batch output: an error, a status of 400 or more, or no vector is an error."""
    one = F.from_json(line, "custom_id string, error struct<message:string>, response struct<status_code:int,body:struct<data:array<struct<embedding:array<double>>>,error:struct<message:string>>>")
    r = df.select(one.alias("r")).filter("r.custom_id IS NOT NULL")
    vector = F.get("r.response.body.data", F.lit(0))["embedding"]
    status = F.col("r.response.status_code")
    error = (
        F.when(F.col("r.error.message").isNotNull(), F.col("r.error.message"))
        .when(status >= 400, F.coalesce("r.response.body.error.message", F.concat(F.lit("status "), status.cast("string"))))
        .when(F.coalesce(F.size(vector), F.lit(0)) <= 0, F.lit("empty embedding"))
    )
    return r.select(F.col("r.custom_id").alias("custom_id"), F.when(error.isNull(), vector).alias("embedding"), error.alias("error"))
