"""Send this package to the executors, as ``--py-files`` would."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add a zip of the package to the Spark context, once per application.

    Python functions are pickled by reference to their module, so every worker must be able to
    import it, wherever the driver was started.
    """
    app = spark.sparkContext.applicationId
    if app in _DONE:
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="quillfold-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _DONE.add(app)
