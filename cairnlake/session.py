"""Session settings for local work and tests; a cluster brings its own."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", *, shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("cairnlake").config("spark.driver.memory", memory)
    settings = {"spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return builder.config(map=settings | conf).getOrCreate()


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="cairnlake-")


def scratch_folder(session: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; what lies there goes when the driver's JVM ends.

    Where the session names no folder a local master gets a temporary one, and any
    other is an error, as executors share none.
    """
    folder = session.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not session.sparkContext.master.startswith("local") or session.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = _own_folder()
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    place = session._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(session._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in a scratch folder, for narrow rows that several branches read."""
    session = df.sparkSession
    path = f"{scratch_folder(session, 'narrow')}/table"
    df.write.parquet(path)
    return session.read.schema(df.schema).parquet(path)
