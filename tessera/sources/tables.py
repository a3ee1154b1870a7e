"""Tables from and to files."""

from __future__ import annotations

import csv
import io
import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import na_to_null
from . import files

path_exists = files.exists


def header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).where("value <> ''").first()
    return next(csv.reader([first[0]])) if first else []


def has_quoted_newlines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field goes on in another line: some line then has an odd number of quotes. One scan, in as many tasks as splits."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """All columns as text, missing tokens as null; quoted newlines and doubled quotes are read, blank lines skipped.

    A file is read as one split only if a quoted field holds a newline; multi_line says so, else the file is looked through.
    Rows of fewer fields than the header end in nulls; a row of more makes the query fail when it is read.
    """
    names = header(spark, path)
    if not names:
        return spark.createDataFrame([], "struct<>")
    if multi_line is None:
        multi_line = has_quoted_newlines(spark, path)
    # A field more than the header has, in which only a row of too many fields has a value.
    spare = next(s for s in itertools.accumulate(itertools.repeat("_")) if s not in names)
    schema = ", ".join(f"`{n}` string" for n in [*names, spare])
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("emptyValue", "").option("nullValue", "\u0000")
    df = reader.schema(schema).csv(path)
    too_many = F.raise_error(F.lit(f"a row has more fields than the {len(names)} of the header"))
    return df.select(*(F.when(F.col(spare).isNotNull(), too_many).otherwise(na_to_null(F.col(f"`{n}`"))).alias(n) for n in names))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet for a name that ends in .parquet, else CSV."""
    return spark.read.parquet(path) if path.endswith(".parquet") else read_csv(spark, path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """A folder of CSV files, or a single file: written in parallel too, then put together in order, a buffer at a time."""
    writer = lambda: df.write.mode("overwrite").option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if not single:
        writer().option("header", True).csv(path)
        return
    spark, line = df.sparkSession, io.StringIO()
    parts = f"{path.rstrip('/')}.parts"
    writer().option("header", False).csv(parts)
    csv.writer(line, lineterminator="\n").writerow(df.columns)
    files.delete(spark, path)
    files.concatenate(spark, files.part_files(spark, parts), path, line.getvalue().encode())
    files.delete(spark, parts)


def shape(df: DataFrame) -> tuple[int, int]:
    """Rows and columns."""
    return df.count(), len(df.columns)


def preview(df: DataFrame, n: int = 5) -> list[dict]:
    """The first n rows."""
    return [r.asDict() for r in df.limit(n).collect()]
