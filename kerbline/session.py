"""Session defaults."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("kerbline")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        # Do not look up the Python line behind every column expression: it takes
        # most of the time of building a query.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # The JVM does not compile methods beyond 8000 bytes; smaller pieces run faster.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shipped(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, as ``--py-files`` would, so that
    tasks import it wherever the driver has it from. Once per application."""
    package = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.writestr(zipfile.ZipInfo(str(path.relative_to(package.parent))), path.read_bytes())
    name = f"{package.name}-{hashlib.sha256(data.getvalue()).hexdigest()[:12]}.zip"
    if name not in spark.sparkContext._python_includes:
        path = os.path.join(tempfile.mkdtemp(prefix="package-"), name)
        Path(path).write_bytes(data.getvalue())
        spark.sparkContext.addPyFile(path)
    return spark
