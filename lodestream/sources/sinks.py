"""Writers (SNK4-8): upserts and versions on plain Parquet, idempotent JSON, rotation, fan-out."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows that new replaces, and new: what an upsert leaves."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


class VersionedTable:
    """A table of numbered folders and a pointer that names the current one; a failed rewrite leaves readers on the version before."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> int:
        """The number of the newest version that was committed, 0 if there is none."""
        p, fs = self._fs(f"{self.path}/_current")
        if not fs.exists(p):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(p)), default=0)

    def read(self) -> DataFrame:
        if not (n := self.current()):
            raise FileNotFoundError(f"no version of {self.path}")
        return self.spark.read.parquet(f"{self.path}/v{n}")

    def replace(self, df: DataFrame) -> int:
        """Writes a new version, then commits it by creating its marker, which is atomic in any store."""
        n = self.current() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{n}")
        p, fs = self._fs(f"{self.path}/_current/{n}")
        fs.create(p, False).close()
        return n

    def upsert(self, new: DataFrame, keys: list[str]) -> int:
        return self.replace(upserted(self.read(), new, keys) if self.current() else new)


class JsonStore:
    """A small JSON file written only when its bytes change, with the one before kept as .bak. The new file replaces the old one in a single rename, so a reader finds the one or the other at any time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _path(self, suffix: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path + suffix)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self) -> str | None:
        p, fs = self._path()
        return self.spark.read.text(self.path, wholetext=True).first()[0] if fs.exists(p) else None

    def write(self, text: str) -> bool:
        """Whether the file changed."""
        before = self.read()
        if before is not None and hashlib.sha256(before.encode()).digest() == hashlib.sha256(text.encode()).digest():
            return False
        if before is not None:
            self._put(".bak", before)
        self._put("", text)
        return True

    def _put(self, suffix: str, text: str) -> None:
        (p, fs), (tmp, _) = self._path(suffix), self._path(suffix + ".tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        hadoop, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        over = gateway.new_array(hadoop.Options.Rename, 1)
        over[0] = getattr(hadoop.Options, "Rename").OVERWRITE
        hadoop.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration()).rename(tmp, p, over)


def rotate(spark: SparkSession, path: str, max_bytes: int, keep: int = 3, stamp: str = "0") -> bool:
    """Renames a file over the size to path.bak.<stamp> and drops all but the newest backups: those of the largest stamps, by number where they are numbers."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p) or fs.getFileStatus(p).getLen() <= max_bytes:
        return False
    fs.rename(p, jvm.org.apache.hadoop.fs.Path(f"{path}.bak.{stamp}"))
    age = lambda name: (0, int(name), "") if name.isdigit() else (1, 0, name)
    backups = sorted((s.getPath().toString() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}.bak.*"))), key=lambda at: age(at.rpartition(".bak.")[2]), reverse=True)
    for old in backups[keep:]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(old), False)
    return True


def fan_out(*listeners: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives each batch to every listener, read once."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for listener in listeners:
                listener(batch, epoch)
        finally:
            batch.unpersist()

    return run
