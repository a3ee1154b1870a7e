"""Connected components of a link table: links are contracted inside tasks, then large-star and small-star steps follow.

Each task first turns the links it holds, a bounded number at a time, into stars by union-find in memory, so that the steps
see a forest's worth of links. A step shuffles links by their ends, takes the least neighbour with partial aggregation, and
writes the new links to the shared folder; nothing but counts and checksums reaches the driver. Steps grow with the logarithm
of the longest chain. A node with very many links is met in salted parts of about SALT_ROWS links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Links that a task contracts at once; bounds its memory.
CONTRACTED = 1_000_000
#: Links of a node that meet in one task, about; results do not depend on it.
SALT_ROWS = 4096


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable) over links a - b, for all nodes that are not the least themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        hooked = label.copy()
        np.minimum.at(hooked, label[x], low)
        np.minimum.at(hooked, label[y], low)
        while (jumped := hooked[hooked]).tobytes() != hooked.tobytes():
            hooked = jumped
        if (hooked == label).all():
            break
        label = hooked
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def contracted(links: DataFrame) -> DataFrame:
    """Links (u, v), u > v, that connect the same nodes as links (u, v) do; fewer of them."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            u, v = stars(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in range(2)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= CONTRACTED:
                yield out()
                held = []
        if held:
            yield out()

    return links.mapInArrow(contract, "u long, v long")


def with_least(pairs: DataFrame, salts: int) -> DataFrame:
    """pairs (u, v) with m, the least v of each u."""
    salted = pairs.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(salts)))
    least = salted.groupBy("u", "s").agg(F.min("v").alias("m")).groupBy("u").agg(F.min("m").alias("m"), F.collect_list("s").alias("s"))
    return common.meet(salted, least.select("u", "m", F.explode("s").alias("s")), ["u", "s"]).select("u", "v", "m")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link between two different nodes; root is the smallest node reachable.

    Links between equal nodes and null ends are ignored; repeated links count once; no links give no rows.
    """
    given = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges, before = common.materialize_with_sums(contracted(given).distinct(), "links")
    spark = edges.sparkSession
    while before[0]:
        salts = -(-before[0] // SALT_ROWS)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, salts).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # Small star: every link points from the larger node; its smaller neighbours and itself go to the least of them.
        low = with_least(large, salts)
        small = low.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v")
        after, sums = common.materialize_with_sums(small.distinct(), "links")
        common.remove(spark, edges)
        edges = after
        if sums == before:
            break
        before = sums
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
