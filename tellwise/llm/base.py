"""What the operators share: reading tables, the shared folder, cutting lineage."""

from __future__ import annotations

import gc
import os
import re
import time
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors reach: spark.checkpoint.dir, or a folder in the
    warehouse where that is unset. On a cluster a warehouse on the driver's own disk is refused."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if as_uri(warehouse).startswith("file:") and not conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    return f"{warehouse}/_shared"


def settled(df: DataFrame, release: bool = False, packed: bool = False) -> DataFrame:
    """df computed once and kept as a Parquet table in the shared folder. Its lineage ends
    there, so a lost executor costs a read; so does what the optimizer has inferred about its
    columns, which in a loop would grow from turn to turn. release lets go of the shuffle files that
    led to it at once: Spark deletes them when the driver's garbage is collected, which may be long
    after a large step. packed is for large texts, nearly all different: no dictionary is tried for them."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd", "parquet.enable.dictionary": "false"} if packed else {"compression": "snappy"}).parquet(folder)
    for _ in range(2 * release):  # what the first collection frees holds the files for the second
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    return spark.read.schema(df.schema).parquet(folder)


def discard(df: DataFrame) -> None:
    """Deletes the files of a settled table that nothing will read again."""
    jvm, files = df.sparkSession._jvm, df.inputFiles()
    if files and "/tables/" in files[0]:
        folder = jvm.org.apache.hadoop.fs.Path(os.path.dirname(files[0]))
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def text_or_empty(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def as_uri(folder: str) -> str:
    return folder if re.match(r"\w+:", folder) else f"file://{os.path.abspath(folder)}"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that driver and executors share, and the folder's path in it."""
    return fs.FileSystem.from_uri(uri)
