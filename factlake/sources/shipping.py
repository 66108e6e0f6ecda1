"""Makes this package importable on executors that don't have it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Sends the package once, unless the workers' path has it already."""
    sc = spark.sparkContext
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_factlake_sent", False):
        return
    out = Path(tempfile.mkdtemp()) / "factlake_engine.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((_ROOT / "factlake").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(out))
    sc._factlake_sent = True
