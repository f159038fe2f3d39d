"""Session set-up and the shared folder for tables that several jobs reuse."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_STAGED: dict[tuple[str, str], str] = {}
_SHIPPED: set[str] = set()


def local_session(cores: str = "8", partitions: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hearthspark")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
    )
    if "spark.checkpoint.dir" not in conf:
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="hearthspark-"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    ``local_session`` sets it. A local session of another make that does not
    gets a folder of its own; on a cluster a machine-local path would be lost
    with its executor, so the setting must be there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = (spark.sparkContext.applicationId, "")
    if key not in _STAGED:
        _STAGED[key] = tempfile.mkdtemp(prefix="hearthspark-")
    return _STAGED[key]


def use_checkpoints(spark: SparkSession) -> None:
    """Point RDD checkpoints (used by the tree learner) at the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def stage_path(spark: SparkSession, name: str) -> str:
    digest = hashlib.sha1(name.encode()).hexdigest()[:16]
    return f"{shared_dir(spark)}/hearthspark/{spark.sparkContext.applicationId}/{digest}"


def staged(spark: SparkSession, name: str, build) -> DataFrame:
    """Write ``build()`` once per application and read it back afterwards.

    Several jobs read the cleaned table and the search index; a written table
    cuts their lineage, survives lost executors and gives Catalyst real sizes.
    """
    key = (spark.sparkContext.applicationId, name)
    if key not in _STAGED:
        path = stage_path(spark, name)
        build().write.mode("overwrite").parquet(path)
        _STAGED[key] = path
    return spark.read.parquet(_STAGED[key])


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read back: for what a job of several steps reads twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hearthspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, as ``--py-files`` would, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="hearthspark-"), "hearthspark.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
