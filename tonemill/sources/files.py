"""Small work on files of any store that Spark knows: listing, deleting, writing one text."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_own: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; where that is unset in a temporary one, in local mode alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tonemill-"))
        shared = _own[0]
    return f"{shared.rstrip('/')}/tonemill/{name}-{uuid.uuid4().hex}"


def names(spark: SparkSession, path: str, ending: str = "") -> list[str]:
    """Names of the files and folders in a folder that end with ``ending``; none if there is no such folder."""
    made, fs = _path(spark, path)
    if not fs.exists(made):
        return []
    return sorted(n for s in fs.listStatus(made) if (n := s.getPath().getName()).endswith(ending))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder."""
    made, fs = _path(spark, path)
    return bool(fs.exists(made))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if there is one."""
    made, fs = _path(spark, path)
    fs.delete(made, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file with a text, replaced as a whole."""
    made, fs = _path(spark, path)
    out = fs.create(made, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
