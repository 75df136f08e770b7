"""Gives the executors' Python workers this package where they can't import it by themselves."""

from __future__ import annotations

import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once. Only workers of a local master share the driver's PYTHONPATH and
    working directory; where they find it there it is not added."""
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    local = re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master)
    if (local and ROOT in map(os.path.abspath, filter(None, places))) or spark.sparkContext.applicationId in _shipped:
        return
    _shipped.add(spark.sparkContext.applicationId)
    folder = tempfile.mkdtemp(prefix="recollect-")
    package = os.path.basename(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, package), "zip", ROOT, package))
