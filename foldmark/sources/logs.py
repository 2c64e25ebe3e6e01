"""What worker logs say about a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmark.functions import logs


def tail(lines: DataFrame, n: int = 8) -> DataFrame:
    """The last n lines (line_no, value), in order."""
    return lines.orderBy(F.desc("line_no")).limit(n).orderBy("line_no")


def last_error(lines: DataFrame) -> DataFrame:
    """Per worker the last line that is an error, null if none."""
    return lines.groupBy("worker").agg(F.max_by(F.when(logs.is_error(F.col("value")), F.trim("value")), F.when(logs.is_error(F.col("value")), F.col("line_no"))).alias("error"))


def worker_progress(lines: DataFrame, done_mark: str = "DONE") -> DataFrame:
    """worker, n_files, rate (both last seen), done, error (only if not done) of lines (worker, line_no, value)."""
    count, rate = logs.progress_count(F.col("value")), logs.progress_rate(F.col("value"))
    at = F.when(count.isNotNull(), F.col("line_no"))
    bad = logs.is_error(F.col("value"))
    per = lines.groupBy("worker").agg(
        F.max_by(count, at).alias("n_files"), F.max_by(rate, at).alias("rate"), F.max(F.contains("value", F.lit(done_mark))).alias("done"), F.max_by(F.when(bad, F.trim("value")), F.when(bad, F.col("line_no"))).alias("error")
    )
    return per.withColumn("error", F.when(~F.col("done"), F.col("error")))


def run_status(progress: DataFrame, workers: int) -> DataFrame:
    """One row over all workers: files, rate, workers done, first error and the stage."""
    total = progress.agg(F.coalesce(F.sum("n_files"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("rate"), F.lit(0.0)).alias("rate"), F.count_if("done").alias("n_done"), F.min(F.when(F.col("error").isNotNull(), F.struct("worker", "error")))["error"].alias("error"))
    return total.withColumn("stage", logs.stage_of(F.col("n_done") == workers, F.col("n_files") > 0, F.col("error").isNull() & (F.col("n_done") > 0)))
