"""Session helpers: a local builder for tests and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as tests and bench use it. Clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("talkloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_base(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local is a temporary folder of this machine
    used; on a cluster an unset folder is an error, as executors could not share the files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "talkloom-scratch")


_made: list[tuple] = []


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder. It is deleted when this process ends, as results may be read until then."""
    path = f"{scratch_base(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(clean_up)
    _made.append((path, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()))
    return path


def clean_up() -> int:
    """Deletes the folders of ``scratch_dir``; returns how many. Results that still read them are lost."""
    gone = 0
    while _made:
        path, jvm, conf = _made.pop()
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            gone += bool(p.getFileSystem(conf).delete(p, True))
        except Exception:  # the JVM has ended before
            break
    return gone


def cut(df, name: str):
    """Write ``df`` to the shared folder and read it back: lineage is cut and any executor may be lost."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
