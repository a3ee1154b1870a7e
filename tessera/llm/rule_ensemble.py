"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees are grown on bootstrap samples of labelled texts; every path from a root is a rule, a conjunction of conditions on
statistics. A logistic regression with a lasso penalty weighs the rules, and those with a weight are compiled into one
Spark column expression. Training sees at most MAX_ROWS labelled rows (those first by a hash of doc_id), a bounded sample; each
tree draws as many of them, with replacement. Scoring covers every whole text. doc_id, source and lang are never statistics.

Null and empty texts have all statistics zero and get a score like any other. A null doc_id counts as held out and is never
learned from. A doc_id with several labels counts as its least one; one with several texts gives each of them. Repeated rows
are learned once and scored each. Texts of any length are measured whole. Without both classes in the labels the score is their
share of 1 (0.5 without labels). An empty table gives no rows. All columns are kept, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Most labelled rows that training sees.
MAX_ROWS = 8000
THRESHOLD = 0.3
STATISTICS = ("n_words", "mean_word", "distinct_words", "top_word", "repeat_run", "repeat_triples", "upper", "digits", "symbols", "pipes", "marks", "stops", "lines", "dup_lines", "short_lines", "bytes_per_char", "compression")


def statistics(text: str | None) -> tuple[float, ...]:
    import zlib

    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    size = sum(map(len, words))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    triples = n - 2
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    distinct = len(set(zip(words, words[1:], words[2:], strict=False)))
    low = raw.lower()
    return (
        math.log1p(n),
        size / n,
        len(counts) / n,
        max(counts.values()) / n,
        same / n,
        1 - distinct / triples if triples > 0 else 0.0,
        int(np.count_nonzero(np.frombuffer(raw, np.uint8) != np.frombuffer(low, np.uint8))) / size,
        sum(raw.count(c) for c in b"0123456789") / size,
        sum(raw.count(c) for c in b"#*$%&<>{}[]=_") / size,
        raw.count(b"|") / n,
        raw.count(b"!") / n,
        (raw.count(b".") + raw.count(b",")) / n,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        n / len(lines) / 1000,
        len(raw) / len(text),
        len(zlib.compress(raw, 1)) / len(raw),
    )


def features(text: Column) -> Column:
    def of(texts: pa.Array) -> pa.Array:
        rows = [statistics(t.as_py()) for t in texts]
        cols = list(zip(*rows, strict=True)) or [()] * len(STATISTICS)
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in cols], names=list(STATISTICS))

    of.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(of, "struct<" + ",".join(f"{s}:double" for s in STATISTICS) + ">").asNondeterministic()(text.cast("string"))


#: A rule: conditions (statistic, is_greater, bound), all of which must hold.
Rule = tuple[tuple[int, bool, float], ...]


def grow(x: np.ndarray, y: np.ndarray, bounds: list[np.ndarray], rng: np.random.Generator, depth: int, path: Rule = ()) -> list[Rule]:
    """Rules of all nodes but the root of a tree grown by Gini impurity over a random half of the statistics."""
    if depth == 0 or len(y) < 10 or y.min() == y.max():
        return []
    best, choice = 1e-9, None
    p = y.mean()
    for f in rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2]:
        for bound in bounds[f]:
            right = x[:, f] > bound
            n = int(right.sum())
            if n < 5 or len(y) - n < 5:
                continue
            pr = y[right].mean()
            pl = (p * len(y) - pr * n) / (len(y) - n)
            gain = p * (1 - p) - (n * pr * (1 - pr) + (len(y) - n) * pl * (1 - pl)) / len(y)
            if gain > best:
                best, choice = gain, (int(f), float(bound), right)
    if choice is None:
        return []
    f, bound, right = choice
    out: list[Rule] = []
    for side, greater in ((~right, False), (right, True)):
        rule = (*path, (f, greater, bound))
        out += [rule, *grow(x[side], y[side], bounds, rng, depth - 1, rule)]
    return out


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, greater, bound in rule:
        out &= (x[:, f] > bound) == greater
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with an L1 penalty, by accelerated proximal gradients."""
    w, b = np.zeros(r.shape[1]), math.log(y.mean() / (1 - y.mean()))
    v, vb, t = w.copy(), b, 1.0
    rate = 4 * len(y) / (np.linalg.norm(r, 2) ** 2 + len(y))
    for _ in range(steps):
        g = (1 / (1 + np.exp(-(r @ v + vb))) - y) / len(y)
        nw = v - rate * (r.T @ g)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nb = vb - rate * g.sum()
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 5e-4, seed: int = 1) -> tuple[list[tuple[Rule, float]], float]:
    """Weighted rules and the intercept."""
    if len(y) < 20 or y.min() == y.max():
        p = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return [], math.log(p / (1 - p))
    rng = np.random.default_rng(seed)
    bounds = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 25))) for f in range(x.shape[1])]
    rules: list[Rule] = []
    for _ in range(trees):
        at = rng.integers(0, len(y), len(y))
        rules += grow(x[at], y[at], bounds, rng, depth)
    rules = list(dict.fromkeys(rules))
    r = np.stack([holds(rule, x) for rule in rules], axis=1).astype(np.float64)
    # Rules that hold for the same rows are one; the shortest stays.
    first: dict[bytes, int] = {}
    for i in sorted(range(len(rules)), key=lambda i: len(rules[i])):
        first.setdefault(np.packbits(r[:, i] > 0).tobytes(), i)
    keep = sorted(first.values())
    w, b = lasso(r[:, keep], y, penalty)
    return [(rules[i], float(v)) for i, v in zip(keep, w, strict=True) if v != 0], float(b)


def compiled(rules: list[tuple[Rule, float]], intercept: float, stats: Column) -> Column:
    """The ensemble's score as one column expression over a struct of STATISTICS."""
    logit = F.lit(intercept)
    for rule, weight in rules:
        cond = F.lit(True)
        for f, greater, bound in rule:
            s = stats.getField(STATISTICS[f])
            cond = cond & ((s > bound) if greater else (s <= bound))
        logit = logit + F.when(cond, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-logit))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, folds: int = 5) -> tuple[list[tuple[Rule, float]], float]:
    """Fit on the labelled rows whose crc32(doc_id) mod folds is not 0; docs: doc_id, text; labels: doc_id, quality."""
    known = labels.where("quality is not null and doc_id is not null").where(common.fold(F.col("doc_id"), folds) != 0).groupBy("doc_id").agg(F.min("quality").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # Texts are measured where they are; only statistics come together.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.xxhash64("text").alias("hash"), "y", features(F.col("text")).alias("s"))
    got = rows.dropDuplicates(["doc_id", "hash"]).orderBy("doc_id", "hash").limit(max_rows).select("s.*", F.col("y").cast("double").alias("y")).toPandas()
    return fit(got[list(STATISTICS)].to_numpy(dtype=np.float64), got["y"].to_numpy(dtype=np.float64))


def scored(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, name: str = "quality_score") -> DataFrame:
    """docs with all their columns and a score of that name (with `_` after it if it is taken); learn_from: texts of the labelled rows (docs by default)."""
    rules, intercept = train(docs if learn_from is None else learn_from, labels)
    # The struct is cut off by a nondeterministic UDF, so that statistics are made once a row.
    stats = common.free_name("statistics", docs.columns)
    with_stats = docs.withColumn(stats, features(F.col("text")))
    return with_stats.withColumn(common.free_name(name, docs.columns), compiled(rules, intercept, F.col(f"`{stats}`"))).drop(stats)


def op3_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    s = scored(docs, common.table(spark, sf_dir, "labels"))
    held = common.fold(F.col("doc_id"), 5) == 0
    return s.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
