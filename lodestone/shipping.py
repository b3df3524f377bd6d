"""Sends this package to the Python workers of a session, where it isn't installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from importlib import metadata
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def installed() -> bool:
    try:
        return bool(metadata.version("lodestone"))
    except metadata.PackageNotFoundError:
        return False


def ship(spark: SparkSession) -> None:
    """Once a session: a zip of the package's modules goes to all executors, unless the package is installed as a distribution.

    Spark serves the file from the driver; workers started later, on new executors too, fetch it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _DONE:
        return
    if not installed():
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        package, target = Path(__file__).parent, Path(folder, "lodestone.zip")
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, Path("lodestone", f.relative_to(package)))
        sc.addPyFile(str(target))
    _DONE.add(sc.applicationId)
