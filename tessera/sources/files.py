"""Single files: through Hadoop's clients on the driver, through Arrow's on executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from ..config import StoreConfig


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def join(folder: str, *names: str) -> str:
    """A path below a folder of any scheme; pathlib would take `s3a://b` apart."""
    return "/".join([folder.rstrip("/"), *(n.strip("/") for n in names)])


def relative_key(path: str, prefix: str) -> str:
    """What follows a prefix in a path, without leading slashes; the last name if nothing does."""
    return path.removeprefix(prefix).lstrip("/") or path.rstrip("/").rsplit("/", 1)[-1]


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Make or replace a file."""
    p, fs = _hadoop(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def concatenate(spark: SparkSession, parts: list[str], path: str, head: bytes = b"") -> None:
    """Make or replace a file from the head and other files, in order, a buffer at a time."""
    p, fs = _hadoop(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(head))
        for part in parts:
            q, other = _hadoop(spark, part)
            data = other.open(q)
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, out, spark._jsc.hadoopConfiguration(), False)
            finally:
                data.close()
    finally:
        out.close()


def part_files(spark: SparkSession, folder: str) -> list[str]:
    """The files that a Spark write left in a folder, in the order of its partitions."""
    p, fs = _hadoop(spark, folder)
    names = (str(s.getPath().toString()) for s in fs.listStatus(p))
    return sorted(n for n in names if n.rsplit("/", 1)[-1].startswith("part-"))


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that the driver and all executors share, spark.checkpoint.dir; a local one only if none is set."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return join(shared or os.path.join(tempfile.gettempdir(), "tessera"), f"{label}-{uuid.uuid4().hex}")


def arrow_place(path: str, region: str | None = None):
    """(file system, path in it) of Arrow for a path or URI, for use on executors."""
    from pyarrow import fs

    if re.match(r"s3[an]?://", path):
        return fs.S3FileSystem(region=region or StoreConfig().region), path.split("://", 1)[1]
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)
