"""Prediction scores from one table of (truth, prediction) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_float, py_str, py_strip

EPSILON = 1e-8


def join_predictions(truth: DataFrame, pred: DataFrame, id_col: str = "index", target_col: str = "prediction", pred_col: str | None = None) -> DataFrame:
    """Inner join on id (null matches null) with columns y_true and y_pred; many-to-many ids multiply."""
    pred_col = pred_col or target_col
    for df, c, side in ((truth, target_col, "truth"), (pred, pred_col, "predictions"), (truth, id_col, "truth"), (pred, id_col, "predictions")):
        if c not in df.columns:
            raise ValueError(f"column '{c}' is missing from {side}")
    t = truth.select(F.col(id_col).alias("_t"), F.col(target_col).alias("y_true"))
    p = pred.select(F.col(id_col).alias("_p"), F.col(pred_col).alias("y_pred"))
    return t.join(p, F.col("_t").eqNullSafe(F.col("_p"))).select(F.col("_t").alias(id_col), "y_true", "y_pred")


def _text(df: DataFrame, name: str) -> Column:
    return py_strip(py_str(F.col(name), dict(df.dtypes)[name]))


def confusion(df: DataFrame) -> DataFrame:
    """(t, p, n): pairs of stripped labels, case kept."""
    return df.groupBy(_text(df, "y_true").alias("t"), _text(df, "y_pred").alias("p")).agg(F.count("*").alias("n"))


def f1_per_class(df: DataFrame) -> DataFrame:
    """(label, tp, true_n, pred_n, f1) over the union of true and predicted labels."""
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    sides = F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("true_n"), F.lit(0).cast("long").alias("pred_n"), hit.alias("tp")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("true_n"), F.col("n").alias("pred_n"), F.lit(0).cast("long").alias("tp"))))
    by = confusion(df).select(sides.alias("x")).groupBy("x.label").agg(*(F.sum(f"x.{c}").alias(c) for c in ("tp", "true_n", "pred_n")))
    return by.withColumn("f1", 2.0 * F.col("tp") / (F.col("true_n") + F.col("pred_n")))


def f1_scores(df: DataFrame) -> DataFrame:
    c = f1_per_class(df)
    tp, t, p = F.sum("tp"), F.sum("true_n"), F.sum("pred_n")
    return c.agg(F.avg("f1").alias("f1_macro"), (2.0 * tp / (t + p)).alias("f1_micro"), (F.sum(F.col("f1") * F.col("true_n")) / t).alias("f1_weighted"))


def exact_match(df: DataFrame) -> Column:
    """Share of pairs equal after strip and lower case."""
    return F.avg((F.lower(_text(df, "y_true")) == F.lower(_text(df, "y_pred"))).cast("double"))


def smape(t: Column, p: Column) -> Column:
    return F.avg(F.abs(p - t) / ((F.abs(t) + F.abs(p)) / 2 + F.lit(EPSILON))) * 100


def smape_gated(df: DataFrame) -> Column:
    """SMAPE if every value of both sides parses as a float, else null."""
    t, p = py_float(_text(df, "y_true")), py_float(_text(df, "y_pred"))
    return F.when(F.bool_and(t.isNotNull() & p.isNotNull()), smape(t, p))


def evaluate(df: DataFrame) -> DataFrame:
    """One row: exact_match, f1_macro, f1_micro, f1_weighted, smape, n_joined. All from one confusion table, so df is read once."""
    conf = confusion(df)
    n, t, p = F.col("n"), py_float(F.col("t")), py_float(F.col("p"))
    term = F.abs(p - t) / ((F.abs(t) + F.abs(p)) / 2 + F.lit(EPSILON)) * n
    zero = F.lit(0).cast("long")
    count = lambda hit: F.when(hit, n).otherwise(zero)
    # A pair of labels counts once for each side; what is summed over pairs rides on the true side.
    true = F.struct(F.col("t").alias("label"), n.alias("true_n"), zero.alias("pred_n"), count(F.col("t") == F.col("p")).alias("tp"), count(F.lower("t") == F.lower("p")).alias("exact"), F.coalesce(term, F.lit(0.0)).alias("term"), count(term.isNull()).alias("unread"))
    pred = F.struct(F.col("p").alias("label"), zero.alias("true_n"), n.alias("pred_n"), zero.alias("tp"), zero.alias("exact"), F.lit(0.0).alias("term"), zero.alias("unread"))
    sums = ("true_n", "pred_n", "tp", "exact", "term", "unread")
    by = conf.select(F.explode(F.array(true, pred)).alias("x")).groupBy("x.label").agg(*(F.sum(f"x.{c}").alias(c) for c in sums))
    f1, total = 2.0 * F.col("tp") / (F.col("true_n") + F.col("pred_n")), lambda c: F.sum(c)
    return by.agg(
        (total("exact") / total("true_n")).alias("exact_match"),
        F.avg(f1).alias("f1_macro"),
        (2.0 * total("tp") / (total("true_n") + total("pred_n"))).alias("f1_micro"),
        (F.sum(f1 * F.col("true_n")) / total("true_n")).alias("f1_weighted"),
        F.when(total("unread") == 0, total("term") / total("true_n") * 100).alias("smape"),
        F.coalesce(total("true_n"), zero).alias("n_joined"),
    )


def coverage(truth: DataFrame, pred: DataFrame, id_col: str = "index") -> DataFrame:
    """One row: n_truth, n_pred and n_joined rows, many-to-many ids multiplied, and n_missing ids of truth without a prediction."""
    sizes = lambda df, name: df.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias(name))
    a, b = sizes(truth, "a"), sizes(pred, "b").withColumnRenamed("id", "other")
    both = a.join(b, F.col("id").eqNullSafe(F.col("other")), "full")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(total("a").alias("n_truth"), total("b").alias("n_pred"), total(F.col("a") * F.col("b")).alias("n_joined"), F.count_if(F.col("a").isNotNull() & F.col("b").isNull()).alias("n_missing"))
