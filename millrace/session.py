"""Session defaults."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive planning on; `conf` keys use `__` for dots.

    Python workers on this machine, and executors that share its paths, find the package where the driver found it;
    others need it installed or shipped with --py-files.
    """
    root = str(Path(__file__).resolve().parent.parent)
    path = os.environ.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        os.environ["PYTHONPATH"] = path = os.pathsep.join(filter(None, (root, path)))
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.executorEnv.PYTHONPATH": path,
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
