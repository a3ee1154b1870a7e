"""Groups of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

A SimHash of 64 bits finds only a part of such pairs: at a similarity of 0.8 about 9 bits differ, and an index that
guarantees so many is the whole table. So candidates come from two sources: the SimHash index (4 bits), and bands of
minimum hashes. Every candidate pair is verified on the whole texts before it links.

Bands: 126 minimum hashes in 21 bands of 6; a pair at 0.8 shares a band with probability 0.998, at 0.9 almost surely.
The texts of a SimHash component (links of 4 bits or fewer) are a bucket too, so each such pair meets in one.

All pairs of a bucket count. First each text is verified against the first document of the bucket and the one before it,
which joins up most groups in linear work. Then every bucket that still holds texts of two groups or more is verified
whole: all its pairs that are not in one group yet, in pairs of blocks of about BLOCK texts, and only links that passed
the verification join groups. So work is quadratic only in buckets that really mix groups. A bucket of very many texts is
met in salted parts: a part's first text is verified against the first of the bucket and of the part before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, simhash
from .components import connected_components

BANDS, ROWS = 21, 6
WORDS, SIMILARITY = 5, 0.8
#: Texts in a block of a bucket; a task holds the shingles of two blocks. Results do not depend on it.
BLOCK = 512
#: Rows of a key that meet in one task of a join or a ranking, about.
SALT_ROWS = 4096


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    n = BANDS * ROWS
    return rng.integers(1, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def sketch(text: Column, words: int = WORDS) -> Column:
    """struct(fp long, keys array<long>): SimHash, and a key for each band."""
    import xxhash

    a, b = _coefficients()

    def of(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            votes = simhash.shingle_hashes(t.as_py(), words)
            low = np.unique((votes ^ (votes >> np.uint64(32))).astype(np.uint32))
            least = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
            for lo in range(0, len(low), 2048):
                x = low[lo : lo + 2048, None] * a + b
                least = np.minimum(least, (x ^ (x >> np.uint32(15))).min(axis=0))
            bands = least.reshape(BANDS, ROWS)
            out.append({"fp": simhash.fingerprint_of(votes), "keys": [int.from_bytes(xxhash.xxh64_digest(bands[i].tobytes(), i)[:8], "little", signed=True) for i in range(BANDS)] if len(low) else []})
        return pa.array(out, pa.struct([("fp", pa.int64()), ("keys", pa.list_(pa.int64()))]))

    of.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(of, "struct<fp:long,keys:array<long>>").asNondeterministic()(text.cast("binary"))


def similar(a: Column, b: Column, words: int = WORDS, least: float = SIMILARITY) -> Column:
    """True where the shingle sets of two texts have at least that Jaccard similarity."""

    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        out, before, kept = [], None, np.empty(0)
        for x, y in zip(left, right, strict=True):
            raw = x.as_py() or b""
            if raw != before:
                before, kept = raw, np.unique(simhash.shingle_hashes(raw, words))
            other = np.unique(simhash.shingle_hashes(y.as_py() or b"", words))
            both = len(np.intersect1d(kept, other, assume_unique=True))
            out.append(both >= least * (len(kept) + len(other) - both))
        return pa.array(out, pa.bool_())

    of.__annotations__ = {"left": pa.Array, "right": pa.Array, "return": pa.Array}
    return F.arrow_udf(of, "boolean").asNondeterministic()(a.cast("binary"), b.cast("binary"))


def keep_one_of_each_group(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs less near copies: of each group the row with the smallest doc_id stays, once.

    A text without a word equals any other such text, null included. Null doc_ids come after all others. Of repeated rows one
    stays; of rows with equal doc_id and text, but other columns apart, any one. All columns are returned, whatever their
    names. Texts of any length are hashed and verified whole. An empty table gives no rows. Texts are told apart by a 64-bit
    hash: among n texts about n * n / 2**65 pairs share one and count as equal.
    """
    spark = docs.sparkSession
    # A node is a text, by its 64-bit hash. Only ids, hashes and keys are written; texts stay where docs has them.
    sketched = docs.select("doc_id", _node(F.col("text")).alias("node"), sketch(F.col("text"), words).alias("s")).select("doc_id", "node", "s.*")
    rows = common.materialize(sketched, "sketches")
    nodes, (n, *_) = common.materialize_with_sums(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys")).select("node", "first", "fp", "keys"), "nodes")
    common.remove(spark, rows)
    salts = 1 + n // SALT_ROWS
    buckets = common.materialize(_buckets(nodes, salts), "buckets")
    pairs = common.materialize(_candidates(buckets), "pairs")
    # One text for each node that has a candidate, found by (doc_id, node): no copies of a frequent text meet in a task.
    wanted = common.meet(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes.select("node", "first"), "node")
    texts = common.materialize(_at(docs, wanted).select(F.col("_node").alias("node"), F.col("_row.text").cast("string").alias("text")), "texts")
    left, right = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    # The first text of a bucket may be in very many pairs, on either side.
    both = common.attach(common.attach(pairs, left, "a", F.col("b"), salts), right, "b", F.col("a"), salts)
    checked = both.select("a", "b", similar(F.col("text_a"), F.col("text_b"), words, least).alias("ok")).where("ok")
    checked = common.materialize(checked.select("a", "b"), "checked")
    roots = connected_components(checked)
    rest = common.materialize(_rest(buckets, roots, texts, words, least, salts), "rest")
    common.remove(spark, roots)
    roots = connected_components(checked.unionByName(rest))
    rooted = common.meet(nodes, roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), F.col("first"), F.col("node"))).alias("k")).select("k.first", "k.node")
    kept = common.materialize(kept, "kept")
    for done in (nodes, buckets, pairs, texts, checked, rest, roots):
        common.remove(spark, done)
    return _at(docs, kept).select("_row.*")


def _node(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _at(docs: DataFrame, places: DataFrame) -> DataFrame:
    """_id, _node and _row: one row of docs for each (first, node) of places, with that doc_id (null is a value) and text.

    Join and removal of repeated rows share one exchange of docs.
    """
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("_id")
    given = docs.select(as_text("doc_id"), _node(F.col("text")).alias("_node"), F.struct("*").alias("_row"))
    places = places.select(as_text("first"), F.col("node").alias("_node"))
    return common.meet(given, places, ["_id", "_node"], "left_semi").dropDuplicates(["_id", "_node"])


def _buckets(nodes: DataFrame, salts: int) -> DataFrame:
    """(key, node, first, size) of all buckets of two nodes or more: bands, and components of SimHash links."""
    fps = nodes.select("fp").distinct()
    # Written first: a task that links and contracts at once holds two Python workers.
    links = common.materialize(simhash.linked(fps, salts), "linked")
    roots = connected_components(links).withColumnRenamed("node", "fp")
    common.remove(fps.sparkSession, links)
    # Texts of one fingerprint may be many: they find their root in salted parts.
    by_root = common.attach(nodes.select("fp", "node", "first"), common.meet(fps, roots, "fp", "left"), "fp", F.col("node"), salts)
    by_fp = by_root.select(F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("key"), "node", "first")
    members = nodes.select(F.explode("keys").alias("key"), "node", "first").unionByName(by_fp)
    crowded = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return common.attach(members, crowded, "key", F.col("node"), salts).select("key", "node", "first", "size")


def _candidates(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes to verify first: each with the first of its bucket's part and with the one before it.

    The first of a part is paired with the bucket's first and with the first of the part before.
    """
    order = F.col("first").asc_nulls_last(), F.col("node")
    salted = buckets.withColumn("_salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / SALT_ROWS)))
    part, bucket = Window.partitionBy("key", "_salt").orderBy(*order), Window.partitionBy("key").orderBy(*order)
    met = lambda w: F.array(F.first("node").over(w), F.lag("node").over(w)).alias("others")
    parts = salted.select("key", "node", "first", "size", F.row_number().over(part).alias("at"), met(part))
    heads = parts.where(f"at = 1 and size > {SALT_ROWS}").select("node", met(bucket))
    pairs = parts.select("node", "others").unionByName(heads).select("node", F.explode("others").alias("other")).where("other is not null and node <> other")
    return pairs.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()


def _rest(buckets: DataFrame, roots: DataFrame, texts: DataFrame, words: int, least: float, salts: int) -> DataFrame:
    """Links (a, b) that connect the nodes of each bucket, given their roots, as all its similar pairs would."""
    members = common.meet(buckets.select("key", "node"), roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    same = [F.count("*").alias("size"), *(F.bit_xor(F.xxhash64(F.lit(i), F.col("node"))).alias(f"x{i}") for i in range(2))]
    mixed = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), *same).where("lo <> hi")
    # Buckets of the same nodes, told by size and two hashes, are verified once.
    mixed = mixed.groupBy("size", "x0", "x1").agg(F.min("key").alias("key")).withColumn("n", F.ceil(F.col("size") / BLOCK)).select("key", "n")
    # As in simhash.linked: every pair of blocks is a group, so any two nodes of the bucket meet in one.
    placed = common.attach(members, mixed, "key", F.col("node"), salts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    block = F.least("own", "other") * F.col("n") + F.greatest("own", "other")
    placed = common.meet(placed.select("key", block.alias("block"), "own", "node", "root"), texts, "node")

    def links(group: pa.Table) -> pa.Table:
        own, node, root = (group.column(c).to_numpy() for c in ("own", "node", "root"))
        found = _forest([np.unique(simhash.shingle_hashes((t.as_py() or "").encode(), words)) for t in group.column("text")], root, own, least)
        return pa.table({"a": pa.array([node[i] for i, _ in found], pa.int64()), "b": pa.array([node[j] for _, j in found], pa.int64())})

    links.__annotations__ = {"group": pa.Table, "return": pa.Table}
    return placed.groupBy("key", "block").applyInArrow(links, "a long, b long")


def _forest(sets: list[np.ndarray], root: np.ndarray, own: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the similar pairs over the groups told by root.

    Two blocks (own): only pairs across them; pairs inside a block are those of its own group.
    """
    label, across = root.copy(), len(set(own.tolist())) > 1
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    out = []
    for i in range(len(sets)):
        open_ = label != label[i]
        if across:
            open_ &= own != own[i]
        open_[: i + 1] = False
        if not open_.any():
            continue
        mark = np.zeros(len(kinds), dtype=bool)
        mark[flat[ends[i] - sizes[i] : ends[i]]] = True
        sums = np.concatenate([[0], np.cumsum(mark[flat])])
        both = sums[ends] - sums[ends - sizes]
        for j in np.flatnonzero(open_ & (both >= least * (sizes + sizes[i] - both))).tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out
