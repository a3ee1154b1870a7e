"""Packing of documents into sequences of a fixed number of tokens, best fit decreasing.

A document longer than a sequence is first cut into full windows, which are sequences by themselves; the rest of it
and all shorter documents are pieces. Pieces go, longest first, into the open window that they fill best. A segment
tree over the remaining capacities 0..window finds that window: its leaf holds the open windows of one capacity, and
the search is for the first leaf at or after the piece's length.

Packing works in blocks of about BLOCK_TOKENS tokens inside a task, so memory is bounded and no shuffle is needed; a
sequence never crosses a block. Null text: empty, so only the end id. A null doc_id is kept. Repeated rows are packed
each by itself. A text of any length is cut into windows; its block is as long as it needs. Pieces of one length keep
their order. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import Encoder, portions, tokenizer_path

WINDOW = 2048
BLOCK_TOKENS = 4_000_000
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Open windows by remaining capacity; `take` gives the tightest one with room."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        at = capacity + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, window) of the smallest capacity >= least; the window is no longer in the tree."""
        count, at = self.count, least + self.size
        while not count[at]:
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.size:
            at *= 2
            if not count[at]:
                at += 1
        capacity = at - self.size
        window = self.open[capacity].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return capacity, window


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Window number and offset of each piece (all 1..window), and the number of windows. Ties keep their order."""
    tree, n = CapacityTree(window), 0
    place, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        found = tree.take(size)
        if found is None:
            found, n = (window, n), n + 1
        capacity, w = found
        place[i], offset[i] = w, window - capacity
        if capacity > size:
            tree.add(capacity - size, w)
    return place, offset, n


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, window: int = WINDOW, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of all documents (doc_id, text): doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset."""
    tokenizer = tokenizer or tokenizer_path()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = Encoder.load(tokenizer)
        base = TaskContext.get().partitionId() << 32
        # What waits for a block: doc_ids, ids, and each document's number of ids, by run of documents.
        waiting: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal base, held
            docs, ids, sizes = pa.concat_arrays([d for d, _, _ in waiting]), np.concatenate([x for _, x, _ in waiting]), np.concatenate([n for _, _, n in waiting])
            waiting.clear()
            held, begin = 0, np.cumsum(sizes) - sizes
            full, rest = sizes // window, sizes % window
            tail = np.flatnonzero(rest)
            place, at, n = best_fit_decreasing(rest[tail], window)
            owner = np.concatenate([np.repeat(np.arange(len(sizes)), full), tail])
            first = np.cumsum(full) - full
            start = np.concatenate([(np.arange(full.sum()) - np.repeat(first, full)) * window, full[tail] * window])
            length = np.concatenate([np.full(full.sum(), window), rest[tail]])
            sequence = base + np.concatenate([n + np.arange(full.sum()), place])
            offset = np.concatenate([np.zeros(full.sum(), dtype=np.int64), at])
            base += n + int(full.sum())
            order = np.lexsort((offset, sequence))
            for lo in range(0, len(order), 2000):
                o = order[lo : lo + 2000]
                yield pa.RecordBatch.from_arrays(
                    [docs.take(pa.array(owner[o])), pa.array(start[o]), pa.array(length[o]), pa.array([ids[i : i + m].tobytes() for i, m in zip((begin[owner[o]] + start[o]).tolist(), length[o].tolist(), strict=True)], pa.binary()), pa.array(sizes[owner[o]]), pa.array(sequence[o]), pa.array(offset[o])],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

        for whole in batches:
            for batch in portions(whole, 1):
                ids, sizes = encoder.encode(batch.column(1), end_id)
                waiting.append((batch.column(0), ids, sizes))
                held += len(ids)
                if held >= block_tokens:
                    yield from rows()
        if waiting:
            yield from rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(packed, PIECES)


def op10_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(common.table(spark, sf_dir, "documents")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
