"""Running totals over arriving rows, and polling for input."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds between two looks, between two calls of a remote service, and the calls that must be left: fixed values.
POLL_SECONDS, CALL_GAP_SECONDS, LEAST_CALLS = 6.0, 1.0, 50


def content_counts(files: DataFrame) -> DataFrame:
    """Rows and bytes per digest of a stream (or table) of files; state grows with the number of digests."""
    return files.where("sha256 is not null and sha256 <> ''").groupBy("sha256").agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes"))


def arrivals_per_hour(files: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Files by hour of their scan, late rows up to ``lateness``."""
    timed = files.withColumn("at", F.timestamp_seconds("scanned_at"))
    return timed.withWatermark("at", lateness).groupBy(F.window("at", "1 hour"), "drive").agg(F.count("*").alias("n_rows"))


def wait_for(path: str, seconds: float, poll: float = POLL_SECONDS, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> bool:
    """Whether a file appears within the time."""
    end = clock() + seconds
    while not os.path.exists(path):
        if clock() >= end:
            return False
        sleep(min(poll, max(0.0, end - clock())))
    return True


def poll(triggers: Mapping[str, tuple[Callable[[], bool], Callable[[], None]]], rounds: int, poll: float = POLL_SECONDS, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """Look at the conditions every ``poll`` seconds, ``rounds`` times at most, and run the action of each once, when its condition first holds. Returns the names in the order they fired; stops when all have."""
    fired: list[str] = []
    for k in range(rounds):
        if k:
            sleep(poll)
        for name, (holds, act) in triggers.items():
            if name not in fired and holds():
                act()
                fired.append(name)
        if len(fired) == len(triggers):
            break
    return fired


def when_there(path: str, run: Callable[[], object], seconds: float, **clockwork) -> object | None:
    """Run a pipeline when a file appears; null if it does not within the time."""
    return run() if wait_for(path, seconds, **clockwork) else None


class CallGate:
    """Spaces calls of a service and waits for its limit to reset when few are left."""

    def __init__(self, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time):
        self.sleep, self.clock, self.last = sleep, clock, float("-inf")

    def before(self, remaining: int | None = None, resets_at: float | None = None) -> None:
        if remaining is not None and remaining < LEAST_CALLS and resets_at is not None:
            self.sleep(max(0.0, resets_at - self.clock()))
        self.sleep(max(0.0, self.last + CALL_GAP_SECONDS - self.clock()))
        self.last = self.clock()
