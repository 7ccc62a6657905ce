"""Session defaults and checkpoint location."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(
    app: str = "corpusmill", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    """A session with adaptive execution on; ``master`` is for local use only."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(session: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; our own folder only on a single machine without one."""
    context = session.sparkContext
    shared = session.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="corpusmill-")
        session.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so several jobs can read it without recomputing.

    Uses the cluster's ``spark.checkpoint.dir``; a folder of our own is made only
    where none is set, which is the case in local tests.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`settle` for rows of text that many jobs read: compressed, and read by columns."""
    spark = df.sparkSession
    folder = f"{spark.sparkContext.getCheckpointDir() or shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder)


_shipped: set[str] = set()


def ship_code(spark: SparkSession, root: str) -> None:
    """Send the package under ``root`` to the executors, once per application.

    Python workers need it for the few jobs with Python in their tasks; where the
    package is installed on the cluster this is not needed.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="corpusmill-code-"), "corpusmill_code.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for folder, _, names in os.walk(os.path.join(root, "corpusmill")):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    packed.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)
