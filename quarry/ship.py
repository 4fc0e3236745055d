"""Makes this package importable where Python runs on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: this folder on the workers' path, and on a cluster the package itself as a file of the job."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    paths = sc.environment.get("PYTHONPATH", "")
    if str(ROOT) not in paths.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in (str(ROOT), paths) if p)
    if not sc.master.startswith("local"):
        path = os.path.join(tempfile.mkdtemp(prefix="quarry-"), "quarry.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted((ROOT / "quarry").rglob("*.py")):
                z.write(f, f.relative_to(ROOT))
        sc.addPyFile(path)
