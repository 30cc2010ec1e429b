"""Spark session for tests and benchmarks on one machine."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "8", memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("mixscore")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """A new folder name in the shared folder; on a local master without one, in a folder that goes at exit."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="mixscore-checks-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        folder = _local[0]
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
