"""Sends this package's code to the executors' Python workers, where it isn't installed."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: a zip of the package, by way of the folder that the cluster shares.

    A local master reads it from a temporary folder; a cluster without spark.checkpoint.dir is taken to have the
    package installed.
    """
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    _sent.add(sc.applicationId)
    root, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    name = f"lexquarry-{sc.applicationId}.zip"
    if sc.master.startswith("local["):
        path = Path(tempfile.mkdtemp(prefix="lexquarry-")) / name
        path.write_bytes(packed.getvalue())
        sc.addPyFile(str(path))
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        at = sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(packed.getvalue()))
        out.close()
        sc.addPyFile(f"{folder}/{name}")
