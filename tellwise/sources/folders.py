"""Folders that the driver and all executors reach, and the few file operations that Spark's
writers don't offer."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder in the warehouse where that is unset. On a
    cluster a warehouse on the driver's own disk is refused."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    on_disk = warehouse.startswith("file:") or not re.match(r"\w+:", warehouse)
    if on_disk and not conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    return f"{warehouse}/_shared"


class Files:
    """Exists, move, remove and list, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        found = self._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self._conf), found

    def exists(self, path: str) -> bool:
        system, found = self._at(path)
        return system.exists(found)

    def move(self, source: str, target: str) -> bool:
        """False if target is there already."""
        system, found = self._at(source)
        goal = self._jvm.org.apache.hadoop.fs.Path(target)
        system.mkdirs(goal.getParent())
        return not system.exists(goal) and system.rename(found, goal)

    def remove(self, folder: str) -> None:
        system, found = self._at(folder)
        system.delete(found, True)

    def listed(self, folder: str) -> list[tuple[str, int, int]]:
        """(path, length, time of the last change) of what a folder holds."""
        system, found = self._at(folder)
        return [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in system.listStatus(found)]
