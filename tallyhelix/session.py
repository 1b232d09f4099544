"""Shipping this package's modules to Python workers, and folders that all of them see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_tallyhelix_shipped", False):
        return
    top = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="tallyhelix-")) / "tallyhelix_modules.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(at))
    sc._tallyhelix_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset, a temporary one for this application, which must run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if not hasattr(sc, "_tallyhelix_shared"):
            own = tempfile.mkdtemp(prefix="tallyhelix-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            sc._tallyhelix_shared = "file://" + own
        found = sc._tallyhelix_shared
    return found.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written below the shared folder and read back: its plan starts here."""
    at = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._tallyhelix_written = True
    return out


def is_written(df: DataFrame) -> bool:
    """Whether the table is one of ``written``, so that reading it again costs little."""
    return getattr(df, "_tallyhelix_written", False)
