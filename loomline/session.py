"""Sessions, and getting this package to the Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cpus: str = "*", shuffle_partitions: int = 8, app: str = "loomline") -> SparkSession:
    """A session for tests and benchmarks. On a cluster, use the session that is there."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LOOMLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once for each application, so that it needn't be installed there."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        # executors fetch the bundle when their first task starts, so it stays until this process ends
        folder = tempfile.mkdtemp(prefix="loomline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        bundle = os.path.join(folder, "loomline_package.zip")
        with zipfile.ZipFile(bundle, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        spark.sparkContext.addPyFile(bundle)
        _shipped.add(app)
    return spark
