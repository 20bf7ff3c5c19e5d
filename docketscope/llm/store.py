"""Files in shared storage, opened from tasks: a local or mounted folder, S3, HDFS, by the folder's address."""

from __future__ import annotations

import uuid
from functools import lru_cache
from urllib.parse import unquote, urlsplit

from pyarrow import fs
from pyspark.sql import SparkSession

from docketscope.session import ensure_checkpoint_dir


@lru_cache(maxsize=64)
def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system that holds a folder, and the folder's path in it."""
    parts = urlsplit(folder)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else folder
    return fs.FileSystem.from_uri(folder)


def new_folder(spark: SparkSession, name: str) -> str:
    """The address of a fresh folder beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def create(folder: str, name: str):
    """A new file to write from start to end."""
    where, path = store(folder)
    where.create_dir(path, recursive=True)
    return where.open_output_stream(f"{path}/{name}", compression=None)


def open_file(folder: str, name: str):
    """A file to read ranges of."""
    where, path = store(folder)
    return where.open_input_file(f"{path}/{name}")
