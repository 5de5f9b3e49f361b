"""Session helpers: a local session for tests and the bench, and the shared
checkpoint folder taken from the session's own configuration."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "stintwise") -> SparkSession:
    """A local session as used by tests and bench.py (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names shared storage and is used as
    is; if it is unset there, this fails rather than fall back to a folder
    only one machine can see. In local mode (tests, bench) an unset folder
    is replaced by a scratch folder.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(
                f"set {CHECKPOINT_KEY} to a shared folder (lineage is cut with written tables there)")
        path = tempfile.mkdtemp(prefix="stintwise-ckpt-")
        spark.conf.set(CHECKPOINT_KEY, path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, for written tables
    that cut lineage or stage files. The configured value may be a URI, so it
    is joined as text and its scheme is kept."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


METHOD_LIMIT_KEY = "spark.sql.codegen.hugeMethodLimit"


def compile_wide_rows(spark: SparkSession) -> None:
    """Let tables of fifty and more columns run compiled, from now on in this
    session: HotSpot interprets methods over 8,000 bytes, and Spark's default
    limit of 65,535 lets a wide row's generated code be one. Another value set
    by the user stays."""
    if spark.conf.get(METHOD_LIMIT_KEY) == "65535":
        spark.conf.set(METHOD_LIMIT_KEY, "8000")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package's modules (once per application), for
    clusters where it is installed on the driver only. Needed by the few
    operators that run Python in tasks."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="stintwise-")) / "stintwise_core.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
