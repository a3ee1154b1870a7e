"""Object stores and other file systems (s3a://, file://, ...): listing, push and pull of prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

#: Bytes of a file that a worker holds while it copies.
BUFFER = 8 << 20


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, size_mb, length) of all files under a path, empty and hidden ones too; contents are not read.

    The file system's own listing, page by page on the driver; what it holds are names and sizes.
    """
    root, fs = files._hadoop(spark, path)
    found, rows = fs.listFiles(root, True), []
    while found.hasNext():
        f = found.next()
        rows.append((f.getPath().toString(), f.getModificationTime(), f.getLen()))
    df = spark.createDataFrame(rows, "path string, modified long, length long")
    return df.select("path", F.timestamp_millis("modified").alias("modified"), (F.col("length") / 1048576).alias("size_mb"), "length")


def size_text(length: Column) -> Column:
    """Bytes as megabytes with two decimals."""
    return F.format_string("%8.2f MB", length / 1048576)


def copy(spark: SparkSession, source: str, target: str, region: str | None = None) -> bool:
    """Copy a file to target, or all files under source to the same relative places under target; False if there is none.

    Executors copy, each file by itself, a buffer at a time; a file stands under its own name only when it is whole. A copy
    that fails is tried again as a task is, and then fails the job.
    """
    if not files.exists(spark, source):
        return False
    found = listing(spark, source).select("path", "length")
    n = found.count()
    if n == 0:
        return False
    # Listed paths are whole URIs; what follows the source's own is the relative key.
    root, fs = files._hadoop(spark, source)
    prefix = str(fs.makeQualified(root).toString())
    one = fs.getFileStatus(root).isFile()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                here, name = files.arrow_place(path, region)
                there, to = files.arrow_place(target if one else files.join(target, files.relative_key(path, prefix)), region)
                there.create_dir(to.rsplit("/", 1)[0], recursive=True)
                with here.open_input_stream(name) as data, there.open_output_stream(f"{to}.part") as out:
                    while block := data.read(BUFFER):
                        out.write(block)
                there.move(f"{to}.part", to)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])

    parts = min(n, spark.sparkContext.defaultParallelism)
    return found.repartition(parts, "path").mapInArrow(run, "path string").count() == n


push = pull = copy


def pull_golden(spark: SparkSession, prefix: str, target: str) -> dict[str, tuple[int, int] | str]:
    """Fetch the golden train and validation tables; each one's rows and columns, or why there is none."""
    out: dict[str, tuple[int, int] | str] = {}
    for name in ("golden_train.parquet", "golden_val.parquet"):
        if pull(spark, files.join(prefix, name), files.join(target, name)):
            df = spark.read.parquet(files.join(target, name))
            out[name] = df.count(), len(df.columns)
        else:
            out[name] = f"nothing under {files.join(prefix, name)}"
    return out
