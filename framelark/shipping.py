"""Send the package to the workers of a cluster."""

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def package_zip(folder: str) -> str:
    """A zip of the package's modules and those beside it, for ``addPyFile``."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(folder, "framelark.zip")
    with zipfile.ZipFile(path, "w") as out:
        for top, _, names in os.walk(os.path.join(root, "framelark")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.relpath(full, root))
    return path


def ship(spark: SparkSession) -> None:
    """Python jobs name functions of this package, which workers must import.

    A local session's workers see the driver's folders; others get a zip, once
    per application.
    """
    context = spark.sparkContext
    if context.master.startswith("local") or context.applicationId in _sent:
        return
    context.addPyFile(package_zip(tempfile.mkdtemp(prefix="framelark-zip-")))
    _sent.add(context.applicationId)
