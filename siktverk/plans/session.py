"""Session set-up: making the package importable in Python workers, and a local session for tests and benches."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Lets the Python workers of this session import the package, from this folder or, on a cluster, from a zip file."""
    context = spark.sparkContext
    context.environment.setdefault("PYTHONPATH", str(ROOT))
    if not context.master.startswith("local") and context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        folder = tempfile.mkdtemp(prefix="siktverk-")  # on the driver only; the executors fetch the file from it
        context.addPyFile(shutil.make_archive(f"{folder}/siktverk", "zip", ROOT, "siktverk"))
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", name: str = "siktverk") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
