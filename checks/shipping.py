from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from runsight.sources.staging import scratch_path

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the Python workers both packages, wherever the session was started, by way of the shared folder."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as bundle:
        for package in ("runsight", "checks"):
            for source in sorted((ROOT / package).rglob("*.py")):
                bundle.write(source, source.relative_to(ROOT))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, 'code')}/runsight_code.zip")
    target = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    target.write(bytearray(data.getvalue()))
    target.close()
    spark.sparkContext.addPyFile(path.toString())
    _shipped.add(application)
