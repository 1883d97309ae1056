"""Session settings that the library's plans expect."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", app: str = "lectern", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, unless PYTHONPATH gives it to them already."""
    root = Path(__file__).resolve().parent.parent
    sc = spark.sparkContext
    if getattr(sc, "_lectern_shipped", False) or str(root) in [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]:
        return
    out = Path(tempfile.mkdtemp(prefix="spark-lectern-")) / "lectern.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((root / "lectern").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(out))
    sc._lectern_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the one that all executors share.

    That is the one in spark.checkpoint.dir, or the context's checkpoint folder. Only a local session, as in tests, falls
    back to a folder of its own; on a cluster a missing setting is an error. The JVM deletes the folder when it ends.
    """
    sc = spark.sparkContext
    where = getattr(sc, "_lectern_dir", None)
    if where is None:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-lectern-")
        where = sc._lectern_dir = f"{base}/lectern-{sc.applicationId}"
        path = sc._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; frames that read them can't be used afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later stages neither recompute it nor depend on executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
