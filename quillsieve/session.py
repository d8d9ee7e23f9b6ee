"""What a session needs before Python code of this package runs on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of one Arrow batch between the JVM and Python; the default bounds rows only, whatever they hold.
ARROW_BYTES = 4 << 20
HOME = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the executors once, so that they need no installed copy, and bounds Arrow batches by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    context = spark.sparkContext
    if getattr(context, "_quillsieve", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "quillsieve-package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(HOME.rglob("*.py")):
            out.write(file, str(file.relative_to(HOME.parent)))
    context.addPyFile(path)
    context._quillsieve = True
