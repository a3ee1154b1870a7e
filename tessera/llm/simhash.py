"""Near-duplicate detection by SimHash, and groups of similar texts.

A text is lower-cased (A-Z), cut into words at `[\\x20\\x09-\\x0D]` and into shingles of `words` words (fewer words: the
whole sequence). Each shingle, repeats included, votes with its XXH64; a bit of the fingerprint is set if more than half
of the votes are. No word, or null text: fingerprint zero.

Fingerprints that differ in at most 4 bits share at least 4 of their 8 bytes, in place. The index holds each distinct
fingerprint under 20 triples of positional bytes, chosen so that any 4 positions hold one of the triples whole (a Turan
system): so every pair with 4 shared bytes meets in some posting list. A list's pairs are tallied by shared positional
bytes, those with 4 or more are verified by the bits that differ, and only a spanning forest of each list's links is
kept. A list of over BLOCK fingerprints is cut into blocks, and each pair of blocks is a task's group of its own, so no
group grows with the data and no link is lost. Joins by list, fingerprint or component meet in salted parts.

Equal fingerprints are one entry of the index, so groups of exact copies cost one row. Rows with a null doc_id take
part; component_id is the smallest non-null doc_id reachable (null if there is none). Repeated rows give repeated rows. Texts
of any length are hashed whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected_components

BITS = 4
SEED = 42
BLOCK = 1024
#: Rows of a key that meet in one task of a join, about; results do not depend on it.
SALT_ROWS = 4096


def triples() -> list[tuple[int, int, int]]:
    """20 of the 56 triples of 8 positions: any 4 positions contain one. Three classes on a ring; a triple inside a class, or two of a class with one of the next."""
    ring = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [t for c in ring for t in combinations(c, 3)]
    return out + [(*two, one) for c, after in zip(ring, ring[1:] + ring[:1], strict=True) for two in combinations(c, 2) for one in after]


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of a UTF-8 text, repeats included."""
    w = text.lower().split() if text else []
    if not w:
        return np.empty(0, dtype="<u8")
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(b" ".join(w), SEED)], dtype="<u8")
    line = b" ".join(w)
    sizes = np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1
    ends = np.cumsum(sizes)
    return np.array([digest(line[i:j], SEED) for i, j in zip((ends - sizes)[: len(w) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)], dtype="<u8")


def fingerprint_of(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint of shingle hashes."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        votes += np.unpackbits(hashes[lo : lo + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, words: int = 4) -> Column:
    """SimHash fingerprint of whole texts, as a signed long."""

    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(shingle_hashes(t.as_py(), words)) for t in texts], pa.int64())

    of.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(of, "long").asNondeterministic()(text.cast("binary"))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def forest(fps: np.ndarray, own: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints (distinct, uint64) that share 4 positional bytes and differ in at most BITS bits.

    own: each one's block; then only pairs of two blocks are tried.
    """
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    by = fps.view(np.uint8).reshape(-1, 8)
    for i in range(len(fps) - 1):
        shared = (by[i + 1 :] == by[i]).sum(axis=1)
        near = np.flatnonzero(shared >= 8 - BITS)
        near = near[np.bitwise_count(fps[i + 1 :][near] ^ fps[i]) <= BITS] + i + 1
        if own is not None:
            near = near[own[near] != own[i]]
        for j in near.tolist():
            if (x := root(i)) != (y := root(j)):
                parent[y] = x
                out.append((i, j))
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest links of each run of equal (key, block) in sorted batches of (key, block, own, fp); own: -1 in a group of one block."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    last: tuple[int, int] | None = None
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def batch_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    def big(fps: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        found = np.array(forest(fps, None if own[0] < 0 else own), dtype=np.int64).reshape(-1, 2)
        return batch_of(fps[found[:, 0]], fps[found[:, 1]])

    def flush() -> Iterator[pa.RecordBatch]:
        if sum(len(x) for x, _ in held) > 1:
            yield big(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))

    for batch in batches:
        key, block, own, fp = (batch.column(i).to_numpy() for i in range(4))
        fp = np.ascontiguousarray(fp).view(np.uint64)
        if len(key) == 0:
            continue
        begins = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
        ends = np.append(begins[1:], len(key))
        if last is not None and (int(key[0]), int(block[0])) == last:
            held.append((fp[: ends[0]], own[: ends[0]]))
            begins, ends = begins[1:], ends[1:]
        if len(begins):
            yield from flush()
            last, held = (int(key[begins[-1]]), int(block[begins[-1]])), [(fp[begins[-1] :], own[begins[-1] :])]
            begins, ends = begins[:-1], ends[:-1]
            two = begins[(ends - begins == 2) & (own[begins] < 0)]
            a, b = fp[two], fp[two + 1]
            ok = ((a.view(np.uint8).reshape(-1, 8) == b.view(np.uint8).reshape(-1, 8)).sum(axis=1) >= 8 - BITS) & (np.bitwise_count(a ^ b) <= BITS)
            yield batch_of(a[ok], b[ok])
            more = (ends - begins > 2) | ((ends - begins == 2) & (own[begins] >= 0))
            for i, j in zip(begins[more].tolist(), ends[more].tolist(), strict=True):
                yield big(fp[i:j], own[i:j])
    yield from flush()


def linked(fps: DataFrame, salts: int = 1) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints (column fp) as all pairs of at most BITS differing bits would.

    salts: parts in which the fingerprints of a posting list are counted and met before they are dealt to blocks.
    """
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255).cast("long"))
    keys = [F.lit(n << 24).cast("long") + byte(i) * 65536 + byte(j) * 256 + byte(k) for n, (i, j, k) in enumerate(triples())]
    index = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = index.groupBy("key").count().where("count > 1")
    index = common.attach(index, sizes, "key", F.col("fp"), salts).withColumn("n", F.ceil(F.col("count") / BLOCK))
    own = F.pmod(F.xxhash64("fp"), F.col("n"))
    # One block: (0, 0). More: every pair of blocks, so that any two fingerprints of the list meet in one.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    index = index.select("key", "fp", "n", own.alias("own"), other.alias("other"))
    block = F.least("own", "other") * F.col("n") + F.greatest("own", "other")
    # A block by itself tries all its pairs; two blocks only those of one with the other.
    apart = F.when(F.col("own") == F.col("other"), F.lit(-1).cast("long")).otherwise(F.col("own"))
    index = index.select("key", block.alias("block"), apart.alias("own"), "fp")
    return index.repartition("key", "block").sortWithinPartitions("key", "block", "fp").mapInArrow(_links, "a long, b long")


def components_by_fingerprint(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp, component_id of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    rows, (n_rows, *_) = common.materialize_with_sums(docs.select("doc_id", fingerprint(F.col("text"), words).alias("fp")), "fingerprints")
    nodes, (n_nodes, *_) = common.materialize_with_sums(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = connected_components(linked(nodes.select("fp"), 1 + n_nodes // SALT_ROWS))
    rooted = common.materialize(common.meet(nodes, roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    common.remove(spark, nodes)
    common.remove(spark, roots)
    labels = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labelled = common.attach(rooted, labels, "root", F.col("fp"), 1 + n_nodes // SALT_ROWS).select("fp", "component_id")
    return common.attach(rows, labelled, "fp", F.col("doc_id"), 1 + n_rows // SALT_ROWS).select("doc_id", "fp", "component_id")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components_by_fingerprint(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
