"""What the Python workers need: this package's sources, and Arrow batches they can hold."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT = "cohortlens.llm.sent"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Documents in an Arrow batch where the session has Spark's default of 10,000.
BATCH_ROWS = 2_500


def ship_package(spark: SparkSession) -> None:
    """Add the package's sources to the session's Python files, once per application.

    What ``--py-files`` does at submission; the archive is a few hundred kB.  Arrow
    batches are made smaller where the session does not set their size itself: a batch
    is held by the executor and by the worker, and documents are long rows.
    """
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    if spark.conf.get(_SENT, "") == spark.sparkContext.applicationId:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    path = os.path.join(tempfile.mkdtemp(prefix="cohortlens-py-"), "cohortlens_src.zip")
    with open(path, "wb") as out:
        out.write(data.getvalue())
    spark.sparkContext.addPyFile(path)
    spark.conf.set(_SENT, spark.sparkContext.applicationId)
