"""Session settings the engine relies on, and the place where lineage may be cut."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # signal rows carry arrays of hundreds of samples: keep Arrow batches a few MB
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; clusters bring their own and only need SETTINGS."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName("rillwave")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    return ship(b.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; only a local session may go without and gets a scratch one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rillwave-ckpt-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers (once per application)."""
    if spark.conf.get(_BATCH) == "10000":                      # Spark's default; rows here carry arrays and whole texts
        spark.conf.set(_BATCH, SETTINGS[_BATCH])
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="rillwave-ship-")) / "rillwave.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"rillwave/{f.relative_to(root)}")
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(app)
    return spark
