"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def build_session(app: str = "rentlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans rely on.

    Adaptive execution is what splits a hot join key at run time and turns a
    planned sort-merge join into a broadcast once the real size is known, so
    it is switched on explicitly. Everything else stays with the cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master gets a temporary folder of its own; on a cluster a
    machine-local folder would be lost with the machine, so that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="rentlens-")
    return _local_dirs[context.applicationId]


def ship_package(spark: SparkSession) -> SparkSession:
    """Gives the executors this package, once per application, for jobs that were not started with --py-files."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        with tempfile.TemporaryDirectory() as folder:
            ignored = shutil.ignore_patterns("__pycache__")
            shutil.copytree(Path(__file__).resolve().parent, Path(folder, "rentlens"), ignore=ignored)
            kept = tempfile.mkdtemp(prefix="rentlens-package-")
            context.addPyFile(shutil.make_archive(f"{kept}/rentlens", "zip", folder, "rentlens"))
        _shipped.add(context.applicationId)
    return spark
