"""The query functions that a caller uses, one for each method of the surface (EXT1-8)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestream.functions import timefns
from lodestream.operators import dsl, listing, retrieval, rollups, windows
from lodestream.sources import readers, sinks


class SearchManager(Protocol):
    """What a retrieval backend offers."""

    def search(self, query: str, max_results: int, min_score: float) -> DataFrame: ...

    def read(self, path: str, start: int, count: int | None) -> DataFrame: ...

    def status(self) -> DataFrame: ...


@dataclass
class ChunkIndex:
    """Retrieval over a chunk table: id, text, embedding, path, source, mtime_ms."""

    chunks: DataFrame
    embed: Callable[[str], DataFrame]
    now_ms: int
    share: float | None = None
    half_life_days: float = 30.0

    def search(self, query: str, max_results: int = 10, min_score: float = 0.0) -> DataFrame:
        return retrieval.search(self.chunks, query, self.embed(query), self.now_ms, k=max_results, least=min_score, half_life_days=self.half_life_days, share=self.share)

    def read(self, path: str, start: int = 1, count: int | None = None) -> DataFrame:
        """One row (path, text); empty text beyond the end or for a path that isn't there."""
        found = self.chunks.filter(F.col("path") == path).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "\n").alias("body"))
        return found.select(F.lit(path).alias("path"), readers.file_slice(F.nullif("body", F.lit("")), start, count).alias("text"))

    def status(self) -> DataFrame:
        return self.chunks.groupBy("source").agg(F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("chunks"))


@dataclass
class Fallback:
    """The first manager that answers; an error of one, also one that shows only when its rows are read, is kept and the next is asked. An answer is read once and held in memory: it is a result of a few rows."""

    managers: list[SearchManager]
    errors: list[str] = field(default_factory=list)

    def _first(self, ask: Callable[[SearchManager], DataFrame]) -> DataFrame:
        for i, manager in enumerate(self.managers):
            try:
                found = ask(manager)
                return found.sparkSession.createDataFrame(found.collect(), found.schema)
            except Exception as e:
                self.errors.append(str(e))
                if i == len(self.managers) - 1:
                    raise
        raise LookupError("no manager")

    def search(self, query: str, max_results: int = 10, min_score: float = 0.0) -> DataFrame:
        return self._first(lambda m: m.search(query, max_results, min_score))

    def read(self, path: str, start: int = 1, count: int | None = None) -> DataFrame:
        return self._first(lambda m: m.read(path, start, count))

    def status(self) -> DataFrame:
        return self._first(lambda m: m.status())


@dataclass
class Engine:
    """A context engine over messages (session, seq, tokens): order is what assembly keeps first."""

    order: Callable[[], list]

    def ingest(self, held: DataFrame, new: DataFrame) -> DataFrame:
        """What is held and what is new, each (session, seq) once; a new message replaces the one held."""
        return sinks.upserted(held, new.dropDuplicates(["session", "seq"]), ["session", "seq"])

    def assemble(self, messages: DataFrame, budget: float) -> DataFrame:
        """Each session's messages within the budget of tokens."""
        return windows.newest_within(messages, "session", self.order(), F.col("tokens"), budget)

    def compact(self, messages: DataFrame, budget: float) -> DataFrame:
        """(session, folded, folded_tokens, kept): how many messages go beyond the budget and their tokens, and how many stay."""
        stays = self.assemble(messages, budget).select("session", "seq", F.lit(True).alias("_stays"))
        marked = messages.join(stays, ["session", "seq"], "left").withColumn("_gone", F.col("_stays").isNull())
        return marked.groupBy("session").agg(F.count_if("_gone").alias("folded"), F.sum(F.when(F.col("_gone"), F.col("tokens"))).alias("folded_tokens"), F.count_if("_stays").alias("kept"))


class Engines:
    """Named context engines."""

    def __init__(self) -> None:
        self._made: dict[str, Engine] = {}

    def register(self, name: str, engine: Engine) -> None:
        if name in self._made:
            raise ValueError(f"engine {name} is registered twice")
        self._made[name] = engine

    def get(self, name: str) -> Engine:
        if name not in self._made:
            raise LookupError(f"no engine {name}; there are {sorted(self._made)}")
        return self._made[name]


ENGINES = Engines()
ENGINES.register("newest", Engine(lambda: [F.desc("seq")]))


def register_tools(spark: SparkSession) -> list[str]:
    """SQL functions for what Spark lacks; built-in expressions need none."""
    from lodestream.operators import documents

    made = {"redact_secrets": (documents.redact, "string"), "html_to_markdown": (documents.html_to_markdown, "string"), "visible_html": (documents.visible_html, "string")}
    for name, (function, kind) in made.items():
        spark.udf.register(name, documents._on_strings(function, kind))
    return sorted(made)


def sessions_usage(facts: DataFrame, now_ms: int, start: str | None = None, end: str | None = None, days: float | None = None, mode: str = "utc", utc_offset: str | None = None, limit: int = 50) -> DataFrame:
    """Totals of the sessions active in the range, the costliest first."""
    span = timefns.date_range(now_ms, start, end, days, mode, utc_offset)
    own = facts.filter(F.col("ts_ms").between(span.start_ms, span.end_ms))
    return rollups.rollup(own, "session").orderBy(F.desc("total_cost"), "session").limit(limit)


def usage_cost(facts: DataFrame, now_ms: int, days: float | None = None) -> DataFrame:
    span = timefns.date_range(now_ms, days=days)
    return rollups.rollup(facts.filter(F.col("ts_ms").between(span.start_ms, span.end_ms)), "date")


def usage_timeseries(facts: DataFrame, session: object, most: int = 1000) -> DataFrame:
    """Points of one session with running totals, the last ones if there are more."""
    points = rollups.cumulative(facts.filter(F.col("session") == session).withColumn("_cost", F.coalesce("total_cost", F.lit(0.0))), "session", ["ts_ms", "event_id"], {"cumulative_tokens": "total_tokens", "cumulative_cost": "_cost"})
    return points.drop("_cost").orderBy(F.desc("ts_ms"), F.desc("event_id")).limit(most)


def filtered_sessions(sessions: DataFrame, query: str) -> tuple[DataFrame, list[str]]:
    return dsl.filter_sessions(sessions, query)


def cron_list(jobs: DataFrame, query: str = "", enabled: str = "all", sort: str = "name", descending: bool = False, offset: int = 0, limit: int = 50) -> DataFrame:
    return listing.page(listing.jobs(jobs, enabled, query), sort, descending, "id", offset, limit)


def cron_runs(runs: DataFrame, job: object = "all", statuses: list[str] | None = None, deliveries: list[str] | None = None, query: str = "", sort: str = "ts", descending: bool = True, offset: int = 0, limit: int = 50) -> DataFrame:
    """Runs (id, job_id, status, delivery_status, summary) of one job or all, by time."""
    own = listing.runs(runs, "job_id", job, "status", statuses, "summary", query, "delivery_status", deliveries)
    return listing.page(own, sort, descending, "id", offset, limit)


def sessions_list(sessions: DataFrame, query: str = "", sort: str = "recent", limit: int = 50) -> DataFrame:
    """Sessions (key, and what the query language asks for) that the query keeps, the first ones by the sort."""
    return listing.sort_sessions(dsl.filter_sessions(sessions, query)[0], sort).limit(limit)


def logs_tail(records: DataFrame, limit: int = 500) -> DataFrame:
    return readers.tail(records, "line_no", limit)


def chat_history(messages: DataFrame, session: object, limit: int = 200, include_tools: bool = False) -> DataFrame:
    """The last messages of a session, tool rows left out unless asked for."""
    own = listing.without_tool_rows(messages.filter(F.col("session") == session), include_tools)
    return own.orderBy(F.desc("seq")).limit(limit).orderBy("seq")
