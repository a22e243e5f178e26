"""Session factory for tests, the bench and interactive use; a cluster brings its own session."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_spark(cpus: int | str = "*", partitions: int = 8, app: str = "lodestream") -> SparkSession:
    """A local session with adaptive execution on and UTC pinned."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each context, so that Python workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_lodestream_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lodestream-")) / "lodestream.zip"  # on the driver, which serves it
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent).as_posix())
    context.addPyFile(str(archive))
    context._lodestream_shipped = True


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one that spark.checkpoint.dir names. Where that is unset, a folder of this machine serves a local session alone, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base}/lodestream/{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables; always through Spark's own reader, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
