"""The Spark session the library expects."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(app: str = "vocalmill", **settings: str) -> SparkSession:
    """UTC, ANSI arithmetic, adaptive plans, and RocksDB for stateful streams; ``settings`` override."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **settings,
    }
    return SparkSession.builder.appName(app).config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a Spark application; for operators that run Python there."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent
    if getattr(context, "_vocalmill_shipped", None) is None and package.is_dir():
        context._vocalmill_shipped = True
        archive = Path(tempfile.mkdtemp(prefix="vocalmill-")) / "vocalmill_package.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
