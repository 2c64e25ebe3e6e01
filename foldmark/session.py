"""Session construction and the shared folder for tables that cut lineage.

Iterative operators write their intermediate results as Parquet into the folder
named by ``spark.checkpoint.dir``. Every executor must reach it, so a lost
executor costs a re-read and never a recomputation of earlier rounds.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER_KEY = "spark.checkpoint.dir"
_made: dict[str, str] = {}


def session(app: str = "foldmark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume: UTC, ANSI, AQE with skew handling."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs in one process."""
    root = spark.conf.get(_FOLDER_KEY, None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError(f"set {_FOLDER_KEY} to a folder that all executors share")
    return _made.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="foldmark-"))


class Scratch:
    """Tables of one operator run below the shared folder.

    ``write`` stores a DataFrame and returns it as read back. ``drop`` deletes
    tables that no returned plan needs any more, ``clear`` all of them, also those of
    runs ``within`` this one; the rest goes when the driver process ends.
    """

    def __init__(self, spark: SparkSession, label: str, within: Scratch | None = None):
        self.spark = spark
        self.root = f"{within.root if within else shared_folder(spark) + '/foldmark'}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._close)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)

    def _close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001 - the JVM may already be gone
            pass
