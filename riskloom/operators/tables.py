"""Tables that one computation writes to the folder which driver and executors share, and removes when it is done."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where it is unset, a temporary folder, on a local master only: executors of
    a cluster would each write to their own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "riskloom-checkpoints")
        spark.sparkContext.setCheckpointDir(root)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, purpose: str) -> str:
    """The address of a fresh folder (not yet made) in the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str = "cut") -> tuple[DataFrame, str]:
    """``df`` computed once, written as compressed Parquet to a fresh folder in the shared folder and read back; and the folder.

    Unlike a checkpoint's, the files are columns, compressed, of a size that the optimizer knows, and can be removed when a
    loop is done with them. (A checkpoint also keeps the size that the optimizer guessed: in loops of joins, a product of
    products that soon has millions of digits.)
    """
    folder = new_folder(df.sparkSession, purpose)
    for open_list in _OWNED:
        open_list.append(folder)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder: its lineage ends there."""
    return written(df)[0]


_OWNED: list[list[str]] = []


@contextmanager
def owned() -> Iterator[list[str]]:
    """Collects the folders written inside, so that their owner can remove them when what reads them is done."""
    mine: list[str] = []
    _OWNED.append(mine)
    try:
        yield mine
    finally:
        _OWNED.remove(mine)


class Scratch:
    """The intermediate tables of one computation: ``keep`` writes one, ``drop`` removes one early, leaving the ``with`` removes the rest.
    ``folder`` is one for other files, which go then too."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folders, self.others = spark, {}, []

    def folder(self, purpose: str) -> str:
        self.others.append(new_folder(self.spark, purpose))
        return self.others[-1]

    def keep(self, df: DataFrame, purpose: str = "step") -> DataFrame:
        table, folder = written(df, purpose)
        self.folders[id(table)] = (table, folder)
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            remove(self.spark, self.folders.pop(id(table))[1])
        sweep(self.spark)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        for folder in self.others:
            remove(self.spark, folder)
        self.drop(*[table for table, _ in self.folders.values()])


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps: its cleaner follows the driver's garbage collection, which on a
    large heap may not come about for long."""
    gc.collect()
    spark._jvm.System.gc()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that ``written`` made, in whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
