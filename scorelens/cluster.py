"""Ship this package to the workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's modules to all workers, now and later ones.

    Needed once per session where workers don't have the package installed: functions that run in Python workers
    refer to its modules by name. Spark copies the archive from the driver to each worker.
    """
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="scorelens-")) / "scorelens.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for module in sorted(root.rglob("*.py")):
            out.write(module, Path(root.name) / module.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
