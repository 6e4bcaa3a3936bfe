"""Session settings and shipping of this package to the executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and ANSI errors; settings given win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session in one process, as in tests, that has none gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stable(df: DataFrame) -> DataFrame:
    """The frame with its rows fixed in reliable storage, where what follows hangs on how they are dealt: a lost
    executor must not draw range bounds anew."""
    sc, root = df.sparkSession.sparkContext, shared_folder(df.sparkSession)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The frame as Parquet in the shared folder, read back: like ``stable``, but ``released`` deletes it when nothing needs it any more."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def add(rows: DataFrame, to: DataFrame) -> None:
    """More rows for a written frame; ``again`` reads what it holds now."""
    rows.write.mode("append").parquet(to._written_to)


def again(df: DataFrame) -> DataFrame:
    out = df.sparkSession.read.schema(df.schema).parquet(df._written_to)
    out._written_to = df._written_to
    return out


def released(*frames: DataFrame) -> None:
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers through Spark's own file server, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), "tidemark_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(home):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
    sc.addPyFile(path)
    sc._tidemark_shipped = True
