"""Sends the package to a session's Python workers, which need not see the driver's folders."""

from __future__ import annotations

import functools
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


@functools.cache
def _archive() -> str:
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="strandline-py-")) / "strandline.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    return str(path)


def ship(spark: SparkSession) -> None:
    """Once per application: add the package's sources as a Python file of the application."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        spark.sparkContext.addPyFile(_archive())
        _sent.add(app)


def shipped(query):
    """A query (spark, sf_dir) -> DataFrame that ships the package first."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str):
        ship(spark)
        return query(spark, sf_dir)

    return run


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share (spark.checkpoint.dir). Where none is set, a local one is made if the master
    is local; on a cluster that is an error, as executors would write to disks of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/strandline-{name}-{uuid.uuid4().hex[:12]}"
