"""Fold assignment and golden samples."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import files
from ..sources.tables import read_table, write_csv
from .ranking import global_rank, in_ranges, seeded_key


def _with_key(df: DataFrame, id_col: str | None, seed: int) -> tuple[DataFrame, list]:
    key = seeded_key(F.col(id_col) if id_col else None, seed, df)
    return df.withColumn("_key", key), [F.col("_key"), *([F.col(id_col)] if id_col else [])]


def kfold(df: DataFrame, n_splits: int = 5, seed: int = 42, id_col: str | None = None) -> DataFrame:
    """fold 0..n_splits-1 over a seeded order; the first n % n_splits folds have one row more."""
    df, order = _with_key(df.drop("fold"), id_col, seed)
    n = df.count()
    if n < n_splits:
        raise ValueError(f"n_splits={n_splits} is more than {n} rows")
    ranked = global_rank(df, order, "_key", n, "_rank")
    size, extra = divmod(n, n_splits)
    r, cut = F.col("_rank") - 1, extra * (size + 1)
    fold = F.when(r < cut, F.floor(r / (size + 1))).otherwise(F.lit(extra) + F.floor((r - cut) / size))
    return ranked.withColumn("fold", fold.cast("int")).drop("_key", "_rank")


def stratified_kfold(df: DataFrame, target_col: str, n_splits: int = 5, seed: int = 42, id_col: str | None = None) -> DataFrame:
    """Round robin over rows sorted by class and seeded key: classes and folds differ by one row at most. Null is a class, 'nan'."""
    df, order = _with_key(df.drop("fold"), id_col, seed)
    df = df.withColumn("_class", F.coalesce(F.col(target_col).cast("string"), F.lit("nan")))
    largest, n = df.groupBy("_class").count().agg(F.max("count"), F.sum("count")).first()
    if (largest or 0) < n_splits:
        raise ValueError(f"n_splits={n_splits} is more than the members of any class")
    ranked = global_rank(df, order, "_key", n, "_rank", group="_class")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % n_splits).cast("int")).drop("_key", "_rank", "_class")


def deal(sizes: list[tuple[int, int]], n_splits: int) -> list[tuple[int, int, int, list[int]]]:
    """Runs (size, first, end, folds) of a greedy deal, from (size, number of groups), largest size first.

    The r-th group of a size, first <= r < end, goes to folds[(r - first) % len(folds)]. Equal groups fill the folds that
    are lighter than the lightest with one group more, in turn, until that reaches the next fold: so a size has at most
    n_splits runs.
    """
    loads, runs = [0] * n_splits, []
    for size, count in sizes:
        done = 0
        while done < count:
            order = sorted((load, k) for k, load in enumerate(loads))
            least, k = order[0]
            folds = [j for load, j in order if (load, j) < (least + size, k)]
            n = count - done
            if len(folds) < n_splits:
                load, j = order[len(folds)]
                rounds, rest = divmod(load - least, size)
                n = min(n, (rounds - (rest == 0 and j < k)) * len(folds))
            for i, j in enumerate(folds):
                loads[j] += size * (n // len(folds) + (i < n % len(folds)))
            runs.append((size, done, done + n, folds))
            done += n
    return runs


def group_folds(df: DataFrame, group_col: str, n_splits: int = 5) -> DataFrame:
    """(group, n, fold): largest group first into the lightest fold; ties by group and by lowest fold.

    The driver holds a few rows for each different size of a group; groups of a size are ranked in ranges of groups.
    """
    sizes = df.groupBy(F.col(group_col).alias("group")).agg(F.count("*").alias("n"))
    kinds = [tuple(r) for r in sizes.groupBy("n").count().orderBy(F.desc("n")).collect()]
    n = sum(c for _, c in kinds)
    if n < n_splits:
        raise ValueError(f"n_splits={n_splits} is more than {n} groups")
    runs = df.sparkSession.createDataFrame(deal(kinds, n_splits), "_size long, _first long, _end long, _folds array<int>")
    ranged = in_ranges(sizes, "group", n)
    before = F.sum("_n").over(Window.partitionBy("_size").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranged.groupBy(F.col("n").alias("_size"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    offsets = offsets.select("_size", "_r", F.coalesce(before, F.lit(0)).alias("_offset"))
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("n", "_range").orderBy(F.col("group").asc_nulls_first())))
    ranked = local.join(offsets, (F.col("n") == F.col("_size")) & (F.col("_range") == F.col("_r"))).select("group", "n", (F.col("_local") + F.col("_offset") - 1).alias("_rank"))
    met = ranked.join(F.broadcast(runs), (F.col("n") == F.col("_size")) & F.col("_rank").between(F.col("_first"), F.col("_end") - 1))
    return met.select("group", "n", F.get("_folds", F.pmod(F.col("_rank") - F.col("_first"), F.size("_folds")).cast("int")).alias("fold"))


def group_kfold(df: DataFrame, group_col: str, n_splits: int = 5) -> DataFrame:
    folds = group_folds(df, group_col, n_splits).select(F.col("group").alias("_group"), "fold")
    df = df.drop("fold")
    return df.join(folds, df[group_col].eqNullSafe(folds["_group"])).drop("_group")


def low_cardinality(df: DataFrame, target_col: str) -> bool:
    """Whether a target has fewer kinds (nulls apart) than half the rows."""
    kinds, n = df.agg(F.count_distinct(target_col), F.count("*")).first()
    return kinds < 0.5 * n


def assign_folds(df: DataFrame, target_col: str | None = None, group_col: str | None = None, n_splits: int = 5, seed: int = 42, id_col: str | None = None) -> DataFrame:
    """Group folds if the group column exists, else stratified folds for a target of few kinds, else plain folds."""
    if group_col and group_col in df.columns:
        return group_kfold(df, group_col, n_splits)
    if target_col and target_col in df.columns and low_cardinality(df, target_col):
        return stratified_kfold(df, target_col, n_splits, seed, id_col)
    return kfold(df, n_splits, seed, id_col)


def scaled_sizes(n: int, train: int, val: int) -> tuple[int, int]:
    """Requested sizes, or their proportion of n rows if there are fewer."""
    if n >= train + val:
        return train, val
    fitted = int(n * train / (train + val))
    return fitted, n - fitted


def sample_exact(df: DataFrame, n: int, seed: int = 42, id_col: str | None = None) -> DataFrame:
    df, order = _with_key(df, id_col, seed)
    return df.orderBy(*order).limit(n).drop("_key")


def sample_stratified(df: DataFrame, target_col: str, total: int, seed: int = 42, id_col: str | None = None) -> DataFrame:
    """round(total / n * size) rows of each class (half to even), null classes left out."""
    n = df.count()
    share = min(1.0, total / n) if n else 0.0
    known = df.where(F.col(target_col).isNotNull())
    quota = known.groupBy(F.col(target_col).alias("_class")).agg(F.bround(F.count("*") * F.lit(share), 0).cast("long").alias("_quota"))
    most = quota.agg(F.max("_quota")).first()[0] or 0
    keyed, order = _with_key(known, id_col, seed)
    ranked = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy(target_col).orderBy(*order))).where(F.col("_rn") <= most)
    return ranked.join(quota, ranked[target_col] == quota["_class"]).where("_rn <= _quota").drop("_key", "_rn", "_class", "_quota")


def golden(df: DataFrame, target_col: str | None = None, train_size: int = 5000, val_size: int = 1000, seed: int = 42, id_col: str | None = None, strict: bool = False) -> DataFrame:
    """A sample with a column `split` ('val' or 'train'), val drawn first.

    A target of few kinds is sampled by class. Rounding may leave the pool short: strict raises, else rows outside the pool fill it up.
    """
    n = df.count()
    train, val = scaled_sizes(n, train_size, val_size)
    total = train_size + val_size
    if target_col and target_col in df.columns and low_cardinality(df, target_col):
        pool = sample_stratified(df, target_col, total, seed, id_col)
        short = min(total, n) - pool.count()
        if short > 0:
            if strict:
                raise ValueError(f"the stratified pool is {short} rows short")
            rest = df.join(pool.select(id_col), id_col, "left_anti") if id_col else df.exceptAll(pool)
            pool = pool.unionByName(sample_exact(rest, short, seed, id_col))
    else:
        pool = sample_exact(df, min(total, n), seed, id_col)
    keyed, order = _with_key(pool, id_col, seed + 1)
    ranked = global_rank(keyed, order, "_key", min(total, n), "_rank").drop("_key")
    return ranked.where(F.col("_rank") <= val + train).withColumn("split", F.when(F.col("_rank") <= val, "val").otherwise("train")).drop("_rank")


def run_splitter(spark, input_file: str, output_dir: str, target_col: str | None = None, group_col: str | None = None, golden_train: int = 5000, golden_val: int = 1000, n_splits: int = 5, seed: int = 42, id_col: str | None = None) -> dict:
    """Golden split and folds of a table, written to output_dir (a path of any scheme) with metadata.

    The golden sample is written once, by split, and its two tables are made from what was written.
    """
    df = read_table(spark, input_file)
    path = files.join(output_dir, "golden.parts")
    golden(df, target_col, golden_train, golden_val, seed, id_col).write.mode("overwrite").parquet(path)
    picked, sizes = spark.read.parquet(path), {}
    for name in ("train", "val"):
        part = picked.where(F.col("split") == name).drop("split")
        part.write.mode("overwrite").parquet(files.join(output_dir, f"golden_{name}.parquet"))
        write_csv(part, files.join(output_dir, f"golden_{name}.csv"), single=True)
        sizes[name] = part.count()
    files.delete(spark, path)
    assign_folds(df, target_col, group_col, n_splits, seed, id_col).write.mode("overwrite").parquet(files.join(output_dir, "train_folded.parquet"))
    meta = {"source_rows": df.count(), "target_col": target_col, "group_col": group_col, "golden_train_rows": sizes["train"], "golden_val_rows": sizes["val"], "n_splits": n_splits, "seed": seed}
    files.write_bytes(spark, files.join(output_dir, "split_metadata.json"), json.dumps(meta, indent=2).encode())
    return meta
