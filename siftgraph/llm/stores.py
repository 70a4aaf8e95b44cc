"""Files and tables in the shared store, by URI."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path


def store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def put(uri: str, write: Callable[[BinaryIO], None]) -> None:
    """A file that appears whole under its name or not at all.

    A task that is run again, or twice at once, writes the same bytes under the same name.
    """
    system, path = store(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    unfinished = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(unfinished) as out:
        write(out)
    system.move(unfinished, path)


def get(uri: str) -> BinaryIO:
    system, path = store(uri)
    return system.open_input_file(path)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` from a table in the shared folder, and where that is: ``discard`` it once all that
    reads it is written itself."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
