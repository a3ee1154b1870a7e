"""What the operators of this subpackage share: tables, the shared folder, small Arrow helpers."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The six bytes that separate words, `[\x20\x09-\x0D]`; bytes.split() splits at exactly these.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of an Arrow batch that goes to a Python worker, unless a single row has more. Bounds memory, not results.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """stage(spark, ...), whose Arrow batches are of at most BATCH_BYTES: an executor holds some for each task, in and outside Python.

    By default a batch has 10,000 rows or 64 MB. The session keeps the setting, as the plan is made when the result is
    written; a smaller one of the caller's stays.
    """

    @functools.wraps(stage)
    def bounded(spark: SparkSession, *args, **kwargs) -> DataFrame:
        # The setting as Spark reads it: a number of bytes, whatever unit it was given in.
        if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
            spark.conf.set(_BATCH, str(BATCH_BYTES))
        return stage(spark, *args, **kwargs)

    return bounded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir.

    Only where a session sets none (tests in local mode) a folder is made and set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_with_sums(df: DataFrame, label: str) -> tuple[DataFrame, tuple[int, int, int]]:
    """materialize(), and what the write saw: the number of rows and two checksums that no order of rows changes."""
    seen = Observation()
    sums = [F.coalesce(F.bit_xor(F.xxhash64(F.lit(i), *df.columns)), F.lit(0)).alias(f"x{i}") for i in range(2)]
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n"), *sums), label)
    got = seen.get
    return out, (got.get("n", 0), got.get("x0", 0), got.get("x1", 0))


def free_name(wanted: str, *taken: list[str]) -> str:
    """A column name that is not taken, in any case of letters."""
    used = {c.lower() for columns in taken for c in columns}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def meet(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join of two sides that both grow with the data: both are shuffled, neither is broadcast.

    Spark takes what an explode makes to have as many rows as went in, and a file to be as large in memory: by such
    estimates it would gather tables on the driver that do not fit there.
    """
    return left.join(right.hint("merge"), on, how)


def attach(rows: DataFrame, values: DataFrame, key: str, spread: Column, salts: int) -> DataFrame:
    """Inner join of rows with values, one row a key, where a key may have very many rows: they meet in salted parts.

    spread: what tells the rows of a key apart. Each part of a key's rows gets its own copy of the key's values.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    parts = salted.select(key, "_salt").distinct()
    return meet(salted, meet(values, parts, key), [key, "_salt"]).drop("_salt")


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing lazy reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, mod k; a null id counts as the empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % k
