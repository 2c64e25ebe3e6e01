"""Copying new files as they are scanned: micro-batches, exactly once per file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from foldmark.operators.merge import keep_one
from foldmark.schema import schema_of
from foldmark.session import Scratch

#: Scan files taken per micro-batch, its interval, and how long a stop may take: fixed values.
BATCH_FILES, INTERVAL, STOP_SECONDS = 150, "8 seconds", 300
#: Rows between two flushes of the progress: fixed value.
FLUSH_ROWS = 100


def remote_path(base: str, path: Column) -> Column:
    """Where a file goes: its absolute path mirrored below the base."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(path, r"^/+", ""))


def scanned_files(spark: SparkSession, folder: str, batch_files: int = BATCH_FILES) -> DataFrame:
    """Rows of the files table as a stream of the Parquet files that scans add to a folder."""
    return spark.readStream.schema(schema_of("files")).option("maxFilesPerTrigger", batch_files).parquet(folder)


def upload_stream(files: DataFrame, copy: Callable[[DataFrame], DataFrame], uploads: str, base: str, checkpoint: str, once: bool = False, present: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Copy each file of the stream once and record it below ``uploads``.

    ``copy`` takes rows (file_id, abs_path, remote_path), copies them and
    returns those that arrived; the rest is retried when it is scanned again.
    A file is recorded once. A batch that is replayed after a failure leaves out
    what other batches recorded and what it had recorded itself, copies the rest, and
    adds it to its record; copying must bear repetition, as a failure between
    copying and recording repeats it. Rows without a path, and with ``present`` (a
    filter of rows) files that are gone by then, are left out. ``once`` drains what is there and stops.
    """
    rows = files.select(F.col("id").alias("file_id"), "abs_path", remote_path(base, F.col("abs_path")).alias("remote_path")).where("abs_path is not null and file_id is not null")

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        fresh = keep_one(df, ["file_id"], [F.col("abs_path")])
        if present is not None:
            fresh = present(fresh)
        done = _recorded(spark, uploads)
        if done is not None:
            fresh = fresh.join(done.select("file_id"), "file_id", "left_anti")
        # copied once, though the record is read more than once
        arrived = Scratch(spark, "uploads").write(copy(fresh).select("file_id", "abs_path", "remote_path"), "arrived")
        # a replay adds to its batch what is new, and never overwrites a folder that its plan reads
        arrived.write.mode("append").parquet(f"{uploads}/batch={number}")

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=INTERVAL)).start()


def _recorded(spark: SparkSession, uploads: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uploads)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not any(s.getPath().getName().startswith("batch=") for s in fs.listStatus(path)):
        return None
    return spark.read.parquet(uploads)


def existing_files(rows: DataFrame) -> DataFrame:
    """The rows whose abs_path is a file that the executors can see."""
    import os

    import pandas as pd

    def there(batches):
        for batch in batches:
            yield batch[pd.Series([os.path.isfile(p) for p in batch["abs_path"]], index=batch.index, dtype=bool)]

    return rows.mapInPandas(there, rows.schema)


def drain(query: StreamingQuery, seconds: int = STOP_SECONDS) -> bool:
    """Let a query process what has arrived, then stop it; false if it had to be cut off after ``seconds``."""
    if query.isActive:
        ended = query.awaitTermination(seconds)
        if not ended:
            query.stop()
        return ended
    return True


class Progress(StreamingQueryListener):
    """Counts of the batches seen so far, handed to ``flush`` whenever another ``every`` rows have come and at the end."""

    def __init__(self, flush: Callable[[dict], None] | None = None, every: int = FLUSH_ROWS) -> None:
        self.batches = self.rows = self.flushed = 0
        self.flush, self.every = flush, every

    def _hand_over(self) -> None:
        if self.flush is not None and self.rows > self.flushed:
            self.flush({"batches": self.batches, "rows": self.rows})
            self.flushed = self.rows

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.rows += event.progress.numInputRows
        if self.rows - self.flushed >= self.every:
            self._hand_over()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._hand_over()
