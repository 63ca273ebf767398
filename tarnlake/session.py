"""Session helpers: shipping the package to workers and cutting lineage in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers once per application, unless their path has it already."""
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    seen = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _SHIPPED or root.parent in seen:
        return
    _SHIPPED.add(app)
    at = Path(tempfile.mkdtemp(prefix="tarnlake-code-")) / "tarnlake.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(at))


def _shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may go without that setting."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tarnlake-checkpoint-")
    return at.rstrip("/")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own that driver and executors share."""
    return f"{_shared(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of df in spark.checkpoint.dir."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint(eager=True)
