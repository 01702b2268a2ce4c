"""Spark jobs for document retrieval, its evaluation, and training-data preparation."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

_shipped: set[str] = set()


def ship(spark) -> None:
    """Send this package to the session's Python workers, once for each application; there it need not be installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="lectern-")) / "lectern.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"lectern/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(path))
