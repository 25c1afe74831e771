"""The folder that all executors share, for tables that this package derives and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Folders of local sessions without spark.checkpoint.dir, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a session in one process gets a
    folder of its own; a cluster is refused, as its executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = _OWN.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="lumenfold-")
        _OWN[app] = found
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for a table of this application."""
    return f"{shared_dir(spark)}/lumenfold/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
