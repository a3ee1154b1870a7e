"""Seeded orders and global ranks without a single-partition sort."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_key(id_col: Column | None, seed: int, df: DataFrame | None = None) -> Column:
    """Pseudo-random sort key: md5 of seed and id, or of the whole row where there is no id."""
    text = id_col.cast("string") if id_col is not None else F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(text, F.lit(""))))


#: Rows of a bucket, about, that one task ranks; results do not depend on it.
BUCKET_ROWS = 250_000
#: Ranges of groups, about, for sums over groups; results do not depend on it.
RANGES = 200


def prefix_digits(rows: int) -> int:
    """Hex digits of a uniform key that part so many rows into buckets of about BUCKET_ROWS, two at least."""
    return max(2, math.ceil(math.log(max(rows, 1) / BUCKET_ROWS, 16))) if rows > BUCKET_ROWS else 2


def in_ranges(df: DataFrame, col: str, rows: int, name: str = "_range") -> DataFrame:
    """df, one row for each value of col, with the number of the value's range; ranges are in the values' order, nulls first.

    Bounds are values picked by a hash, RANGES of them about, so that every evaluation finds the same ranges.
    """
    picked = F.pmod(F.xxhash64(col), F.lit(max(1, rows // RANGES))) == 0
    bounds = df.where(picked).agg(F.collect_set(col).alias("_bounds"))
    below = F.when(F.col(col).isNull(), -1).otherwise(F.size(F.filter("_bounds", lambda b: b < F.col(col))))
    # One row of about RANGES values.
    return df.crossJoin(F.broadcast(bounds)).withColumn(name, below).drop("_bounds")


def sums_before(sizes: DataFrame, col: str, n: str, name: str) -> DataFrame:
    """sizes, one row for each value of col, with the sum of n over all smaller values (null is the smallest).

    Sums run inside ranges of values, then over the ranges, so no task holds all values.
    """
    ranged = in_ranges(sizes, col, sizes.count())
    whole = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(F.col("_range").alias("_r")).agg(F.sum(n).alias("_total"))
    totals = totals.select("_r", F.coalesce(F.sum("_total").over(whole), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(F.col(col).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn(name, F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return summed.join(F.broadcast(totals), F.col("_range") == F.col("_r")).withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_r", "_before")


def global_rank(df: DataFrame, order: list[Column], key: str, rows: int, name: str = "rank", group: str | None = None) -> DataFrame:
    """Rank 1..n in an order that begins with the group, if there is one, and the hex column key.

    Local ranks in buckets (group and first digits of the key, as many as the number of rows asks for) plus the sizes of what
    comes before: of smaller groups, and of the group's own smaller digits.
    """
    df = df.withColumn("_digits", F.substring(key, 1, prefix_digits(rows)))
    by = ["_digits"] if group is None else [group, "_digits"]
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    digits = Window.orderBy("_digits") if group is None else Window.partitionBy(group).orderBy("_digits")
    before = F.coalesce(F.sum("_n").over(digits.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Without a group the window's rows are the different digits: 16 for every BUCKET_ROWS rows at most, or 256.
    offsets = sizes.select(*(F.col(c).alias(f"{c}_") for c in by), before.alias("_offset"))
    if group is not None:
        groups = sums_before(df.groupBy(group).agg(F.count("*").alias("_n")), group, "_n", "_smaller").select(F.col(group).alias("_g"), "_smaller")
        offsets = offsets.join(groups, F.col(f"{group}_").eqNullSafe(F.col("_g"))).withColumn("_offset", F.col("_offset") + F.col("_smaller")).drop("_g", "_smaller")
    local = df.withColumn("_local", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"{c}_")) for c in by))
    return local.join(offsets, same).withColumn(name, (F.col("_local") + F.col("_offset")).cast("long")).drop("_digits", "_local", "_offset", *(f"{c}_" for c in by))
