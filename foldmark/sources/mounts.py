"""The drives of a machine, from a mount table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmark.functions.paths import mount_letter
from foldmark.operators.merge import keep_one

#: File systems that hold no user files, and where such mounts lie: fixed values.
VIRTUAL = (
    "proc", "sysfs", "devtmpfs", "devpts", "tmpfs", "cgroup", "cgroup2", "pstore", "securityfs", "debugfs", "tracefs", "bpf", "hugetlbfs", "mqueue", "fusectl", "configfs", "autofs", "efivarfs", "binfmt_misc", "overlay", "nsfs", "rpc_pipefs", "nfsd",
)
SYSTEM_PREFIXES = ("/proc", "/sys", "/dev", "/run", "/snap")


def mount_entries(lines: DataFrame) -> DataFrame:
    """device, mount_point, fs_type, line_no of lines (line_no, value) with three fields or more; blanks in names are written as \\040."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.size(f) >= 3)
    text = lambda k: F.replace(F.get(f, F.lit(k)), F.lit("\\040"), F.lit(" "))
    return rows.select("line_no", text(0).alias("device"), text(1).alias("mount_point"), F.get(f, F.lit(2)).alias("fs_type"))


def drives(entries: DataFrame, readable: DataFrame | None = None) -> DataFrame:
    """The drives among mount entries, each mount point once, Windows letters first. ``readable`` may list the mount points (mount_point, total_bytes, free_bytes) that can be read."""
    system = F.lit(False)
    for prefix in SYSTEM_PREFIXES:
        system = system | F.col("mount_point").startswith(prefix)
    once = keep_one(entries, ["mount_point"], [F.col("line_no")]).where(~F.col("fs_type").isin(*VIRTUAL) & ~system)
    if readable is not None:
        once = once.join(readable, "mount_point").withColumn("used_bytes", F.col("total_bytes") - F.col("free_bytes"))
    letter = mount_letter(F.col("mount_point"))
    windows = F.col("mount_point").startswith("/mnt/") & letter.rlike("^[a-z]$")
    label = F.when(windows, F.concat(F.upper(letter), F.lit(":"))).when(F.col("device").isin("none", "tmpfs", "overlay"), letter).otherwise(F.substring_index("device", "/", -1))
    rows = once.drop("line_no").withColumns({"letter": letter, "is_windows": windows, "label": label})
    return rows.orderBy(F.desc("is_windows"), "letter", "mount_point")


def read_mounts(spark: SparkSession, path: str = "/proc/mounts") -> DataFrame:
    """Entries of a mount table file. Such a file is small, so its lines are numbered in one partition."""
    with open(path, errors="replace") as f:
        lines = list(enumerate(f.read().splitlines()))
    return mount_entries(spark.createDataFrame(lines, "line_no int, value string"))
