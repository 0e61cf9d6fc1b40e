"""Lets Python workers find this package where it isn't installed or sent with the job."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> None:
    """Adds the package's folder to the workers' path, unless the environment has it; on other machines --py-files does it."""
    env = spark.sparkContext.environment
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *env.get("PYTHONPATH", "").split(os.pathsep)]
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
