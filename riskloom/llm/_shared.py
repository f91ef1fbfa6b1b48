"""The folder that the driver and all executors share, and small helpers that operators have in common."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.tables import Scratch, cut, new_folder, owned, remove, shared_root, sweep, written

__all__ = ["Scratch", "cut", "documents", "mounted", "new_folder", "owned", "remainder", "remove", "shared_root", "sweep", "write_whole", "written"]


def mounted(address: str) -> str:
    """The path under which Python opens ``address``. Files that workers map into memory need a mounted (POSIX) shared folder."""
    parts = urlparse(address)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder in spark.checkpoint.dir, not {parts.scheme}://")
    return parts.path


def write_whole(path: str, *parts: bytes) -> None:
    """A file that is either absent or whole: a task that runs twice or is lost half way leaves no torn file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with open(own, "wb") as f:
        for x in parts:
            f.write(x)
    os.replace(own, path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(column: str, modulus: int):
    """crc32 of a column as text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")) % modulus
