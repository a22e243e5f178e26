"""Run trees (GRF1-6, JN11): runs are edges from a requester's session to a child's session, cycles allowed.

A run table has run_id, requester, child, created_at, started_at, ended_at, cleanup_at (milliseconds, the last three may be null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestream.session import scratch


def reached(runs: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, session) for every session that can be reached from the roots (column root), the root included.

    A frontier join a level: each level joins only sessions that are new, so cycles end, and levels go on until there are none, or to ``max_depth``. Every level is written to the cluster's shared folder and what was seen is all levels so far.
    """
    spark = runs.sparkSession
    folder = scratch(spark)
    edges = runs.select("requester", "child").distinct()
    schema = roots.select("root", F.col("root").alias("session")).schema

    def level(df: DataFrame, n: int) -> DataFrame:
        df.write.parquet(f"{folder}/{n}")
        return spark.read.schema(schema).parquet(f"{folder}/{n}")

    frontier = level(roots.select("root", F.col("root").alias("session")).distinct(), 0)
    seen = frontier
    n = 0
    while max_depth is None or n < max_depth:
        n += 1
        after = frontier.join(edges, frontier["session"] == edges["requester"]).select("root", F.col("child").alias("session")).distinct()
        frontier = level(after.join(seen, ["root", "session"], "left_anti"), n)
        if frontier.isEmpty():
            break
        seen = spark.read.schema(schema).parquet(*[f"{folder}/{k}" for k in range(n + 1)])
    return seen


def descendants(runs: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, run columns): the runs whose requester is reached, each once a root."""
    sessions = reached(runs, roots, max_depth)
    return sessions.join(runs, sessions["session"] == runs["requester"]).drop("session")


def _pending():
    return F.col("ended_at").isNull() | F.col("cleanup_at").isNull() | (F.col("cleanup_at") < F.col("ended_at"))


def counts(runs: DataFrame, roots: DataFrame, excluded_run: object = None, max_depth: int | None = None) -> DataFrame:
    """(root, descendants, active, pending): active runs have no end; pending ones no end or no completed cleanup, without the excluded run."""
    own = descendants(runs, roots, max_depth)
    pending = _pending() if excluded_run is None else _pending() & (F.col("run_id") != excluded_run)
    found = own.groupBy("root").agg(F.count(F.lit(1)).alias("descendants"), F.count_if(F.col("ended_at").isNull()).alias("active"), F.count_if(pending).alias("pending"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("descendants", "active", "pending")}
    return roots.select("root").distinct().join(found, "root", "left").withColumns(zero)


def active_direct(runs: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, active_direct): direct runs without an end, or ended with pending descendants."""
    direct = roots.select("root").distinct().join(runs, F.col("root") == runs["requester"])
    below = counts(runs, direct.select(F.col("child").alias("root")), max_depth=max_depth).select(F.col("root").alias("child"), "pending")
    own = direct.join(below, "child", "left")
    found = own.groupBy("root").agg(F.count_if(F.col("ended_at").isNull() | (F.coalesce("pending", F.lit(0)) > 0)).alias("active_direct"))
    return roots.select("root").distinct().join(found, "root", "left").withColumn("active_direct", F.coalesce("active_direct", F.lit(0)))


def latest_per_child(runs: DataFrame) -> DataFrame:
    """(child, run_id, requester, settled): the newest run of each child, the first id on a tie; settled if it ended and was cleaned up."""
    best = F.max(F.struct("created_at", (-F.col("run_id")).alias("o"), "requester", "ended_at", "cleanup_at"))
    own = runs.groupBy("child").agg(best.alias("b"))
    settled = F.coalesce(F.col("b.ended_at").isNotNull() & (F.col("b.cleanup_at") >= F.col("b.ended_at")), F.lit(False))
    return own.select("child", (-F.col("b.o")).alias("run_id"), F.col("b.requester").alias("requester"), settled.alias("settled"))


def runs_of_child(runs: DataFrame, child: object) -> DataFrame:
    return runs.filter(F.col("child") == child)


def children_in_time(parents: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id of the parent, child_run): runs that a parent's session asked for while the parent ran; a bound that is missing is open. An equality join with the bounds as its condition."""
    p = parents.select(F.col("run_id").alias("parent_run"), F.col("child").alias("requester"), F.coalesce("started_at", "created_at").alias("lo"), F.col("ended_at").alias("hi"))
    c = runs.select("requester", F.col("run_id").alias("child_run"), F.col("created_at").alias("at"))
    inside = (F.col("lo").isNull() | (F.col("at") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("at") <= F.col("hi")))
    return p.join(c, "requester").filter(inside).select("parent_run", "child_run")
