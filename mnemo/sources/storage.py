"""Files of any store that Spark knows, from the driver and within tasks."""

from __future__ import annotations

import json

from pyarrow import fs as pafs
from pyspark.sql import SparkSession


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(address, bytes) of the files that a path, folder or glob names, by name.  Mount points are followed, so that tasks,
    which have no Hadoop client, can open the addresses."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found, open_ = [], [s for s in (store.globStatus(hadoop) or [])]
    while open_:
        s = open_.pop()
        name = s.getPath().getName()
        if s.isDirectory():
            open_ += list(store.listStatus(s.getPath()))
        elif not name.startswith(("_", ".")):
            at = store.resolvePath(s.getPath())
            found.append((at.toUri().toString(), int(s.getLen())))
    return sorted(found)


def opened(address: str):
    """(file system, path within it) of an address: local, S3, GCS, HDFS."""
    if address.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + address[len("file:") :].lstrip("/")
    return (pafs.LocalFileSystem(), address) if address.startswith("/") else pafs.FileSystem.from_uri(address)


def resolved(spark: SparkSession, path: str) -> str:
    """The address of a folder, made if it is missing, for tasks that write there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(hadoop)
    return store.resolvePath(hadoop).toUri().toString()


def packed(value) -> str:
    """An option of a data source."""
    return json.dumps(value)
