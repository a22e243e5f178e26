"""Runs the machines on Structured Streaming, keyed and checkpointed, and over batches.

Rows of a key that arrive in one micro-batch are put in order of (at, id) first. State is kept in the stream's checkpoint as JSON. With an idle time it expires by event time: once the
watermark has passed the last row by that time, what is held comes out, if the machine can flush, and the key's state goes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestream.session import scratch
from lodestream.streaming.machines import Flush, Machine


def _ordered(frames: Iterator[pd.DataFrame]) -> list[dict]:
    rows = pd.concat(list(frames), ignore_index=True)
    return rows.sort_values(["at", "id"]).to_dict("records")


def _frame(key: str, value, out: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame([(value, *o) for o in out], columns=[key, *names])


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def keyed(stream: DataFrame, key: str, machine: Machine, schema: str, flush: Flush | None = None, idle_ms: int = 0) -> DataFrame:
    """Outputs of the machine for each key of a stream with the columns key, id, at (and, for an idle time, a watermark on a timestamp column)."""
    kind, names = stream.schema[key].dataType.simpleString(), _names(schema)

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        if state.hasTimedOut:
            out = flush(held)[1] if flush else []
            state.remove()
            yield _frame(key, keys[0], out, names)
            return
        out, last = [], 0
        for row in _ordered(frames):
            held, more = machine(held, row)
            out += more
            last = int(row["at"])
        state.update((json.dumps(held, default=int),))
        if idle_ms and held:
            state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield _frame(key, keys[0], out, names)

    timeout = GroupStateTimeout.EventTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {schema}", "state string", "append", timeout)


def batch(df: DataFrame, key: str, machine: Machine, schema: str, flush: Flush | None = None) -> DataFrame:
    """The same over a table, each key from its first row to its last, with what is left at the end."""
    kind, names = df.schema[key].dataType.simpleString(), _names(schema)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held: dict = {}
        out: list[tuple] = []
        for row in _ordered(iter([rows])):
            held, more = machine(held, row)
            out += more
        return _frame(key, rows[key].iloc[0], out + (flush(held)[1] if flush else []), names)

    return df.groupBy(key).applyInPandas(run, f"{key} {kind}, {schema}")


def files(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All that the stream has now, through a checkpointed file sink in the shared folder."""
    root = scratch(spark)
    query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
