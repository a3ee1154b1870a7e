"""Token-ID output, compressed by Re-Pair grammars.

Documents are put in ascending doc_id order, encoded, and cut into shards of about SHARD_TOKENS ids. Each shard
has its own grammar: frequent pairs of symbols are replaced by nonterminals again and again, until no pair stands in LEAST
places any more. A round replaces all pairs at or above its threshold at once, left to right and without overlap; thresholds
fall from FIRST_SHARE of the shard to LEAST. A shard is a row of a Parquet table:

    part, shard       place in the order of documents
    part_start        ids of the part's earlier shards
    doc_ids           doc_id of each document, in order (null stays null)
    doc_tokens        ids of each document, its end id included
    base              the first nonterminal; smaller symbols are ids
    rules             pairs of symbols, unsigned 32-bit little-endian; rule r defines base + r
    rule_tokens       expansion length of each rule, unsigned 32-bit
    symbols           the shard's ids in symbols, unsigned 32-bit

The expansion lengths let a reader find any span of ids without expanding what stands before it (`decode_span`).
Null text: no ids but the end id. Null doc_ids come first; rows with equal doc_id stay side by side, ordered by a hash of
the text and the text, and may lie in several parts, so that one id in very many rows is no single task's work. An empty
table gives no shards and no rows. A text of any length is one document; its shard is as long as it needs. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import Encoder, gather, portions, tokenizer_path

SHARD_TOKENS = 1 << 20
#: A pair is replaced while it stands in at least so many places of a shard: a rule costs three numbers.
LEAST = 16
#: Threshold of the first round as a share of the shard's ids, and what it falls by from round to round.
FIRST_SHARE, FALL = 1 / 400, 1 / 50
#: Buckets of pairs are 2**BUCKET_BITS; they only rule pairs out before any is sorted.
BUCKET_BITS = 17
SHARDS = "part int, shard int, part_start long, doc_ids array<long>, doc_tokens array<long>, base long, rules binary, rule_tokens binary, symbols binary"


def _bucket(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA6B))) >> np.uint32(32 - BUCKET_BITS)


def _frequent(seq: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (64-bit keys) in at least `threshold` places: the places, the pair at each (its index), and the pairs.

    Of two pairs in one bucket only the more frequent is given; the other's turn comes once that one is replaced.
    """
    bucket = _bucket(seq[:-1], seq[1:])
    at = np.flatnonzero((np.bincount(bucket, minlength=1 << BUCKET_BITS) >= threshold)[bucket])
    keys = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
    line = np.sort(keys)
    begins = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else at
    times = np.diff(begins, append=len(line))
    enough = times >= threshold
    pairs = line[begins[enough]][np.argsort(times[enough], kind="stable")]
    table = np.full(1 << BUCKET_BITS, -1, dtype=np.int32)
    table[_bucket((pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32))] = np.arange(len(pairs), dtype=np.int32)
    which = table[bucket[at]]
    hold = np.flatnonzero(which >= 0)
    hold = hold[pairs[which[hold]] == keys[hold]]
    return at[hold], which[hold], pairs


def compress(ids: np.ndarray, least: int = LEAST) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(base, rules [n, 2], expansion lengths [n], symbols) of one shard."""
    seq = ids.astype("<u4")
    base = int(seq.max()) + 1 if len(seq) else 0
    rules: list[np.ndarray] = []
    lengths = np.ones(0, dtype=np.int64)
    threshold = max(least, int(len(seq) * FIRST_SHARE))
    while len(seq) > 1:
        at, which, pairs = _frequent(seq, threshold)
        # Of places that follow one another, every second: no place is in two pairs.
        rank = np.arange(len(at))
        first = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, rank, 0))
        free = (rank - first) % 2 == 0
        at, which = at[free], which[free]
        used = np.bincount(which, minlength=len(pairs)) >= max(2, threshold // 2)
        at, which = at[used[which]], which[used[which]]
        if len(at):
            new = np.stack([pairs[used] >> np.uint64(32), pairs[used] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.int64)
            seq[at] = base + len(lengths) + (np.cumsum(used) - 1)[which]
            keep = np.ones(len(seq), dtype=bool)
            keep[at + 1] = False
            seq = seq[keep]
            lengths = np.concatenate([lengths, _widths(new, base, lengths).sum(axis=1)])
            rules.append(new)
        elif threshold == least:
            break
        threshold = max(least, int(threshold * FALL))
    table = np.concatenate(rules) if rules else np.empty((0, 2), dtype=np.int64)
    return base, table.astype("<u4"), lengths.astype("<u4"), seq.astype("<u4")


def _widths(symbols: np.ndarray, base: int, lengths: np.ndarray) -> np.ndarray:
    """Ids that each symbol stands for, given the rules' expansion lengths."""
    return np.concatenate([lengths, [1]])[np.where(symbols < base, len(lengths), symbols - base)]


def _unfold(symbols: np.ndarray, base: int, rules: np.ndarray) -> np.ndarray:
    """All ids that symbols stand for; one pass for each level of the grammar."""
    seq = symbols.astype(np.int64)
    while (inner := seq >= base).any() and len(rules):
        at = np.cumsum(1 + inner) - 1 - inner
        rule = rules[seq[inner] - base]
        out = np.empty(len(seq) + int(inner.sum()), dtype=np.int64)
        out[at] = seq
        out[at[inner]], out[at[inner] + 1] = rule[:, 0], rule[:, 1]
        seq = out
    return seq.astype("<u4")


def expand(symbols: np.ndarray, base: int, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All ids that symbols stand for: the rules are expanded once, then gathered."""
    rules, lengths, symbols = rules.astype(np.int64), lengths.astype(np.int64), symbols.astype(np.int64)
    if not len(rules):
        return symbols.astype("<u4")
    # Word 0 stands for any single id; those are put in afterwards.
    plain, size = symbols < base, np.concatenate([[1], lengths])
    flat = np.concatenate([np.zeros(1, dtype="<u4"), _unfold(base + np.arange(len(rules)), base, rules)])
    out, stops = gather(flat, np.cumsum(size) - size, size, np.where(plain, 0, symbols - base + 1))
    out[stops[plain] - 1] = symbols[plain]
    return out


def decode_span(shard: dict, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of a shard (a row of the table), expanding only the symbols that hold them."""
    base, rules = shard["base"], np.frombuffer(shard["rules"], dtype="<u4").reshape(-1, 2).astype(np.int64)
    symbols, sizes = np.frombuffer(shard["symbols"], dtype="<u4").astype(np.int64), np.frombuffer(shard["rule_tokens"], dtype="<u4").astype(np.int64)
    ends = np.cumsum(_widths(symbols, base, sizes))
    lo, hi = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left")
    skipped = int(ends[lo - 1]) if lo else 0
    return _unfold(symbols[lo : hi + 1], base, rules)[start - skipped : stop - skipped]


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode documents (doc_id, text) in ascending doc_id order and write their shards to path."""
    tokenizer = tokenizer or tokenizer_path()
    kinds = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("part_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("base", pa.int64()), ("rules", pa.binary()), ("rule_tokens", pa.binary()), ("symbols", pa.binary())])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, done, n = Encoder.load(tokenizer), TaskContext.get().partitionId(), 0, 0
        # What waits for a shard: ids, doc_ids and their numbers of ids, by run of documents.
        waiting: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        held = 0

        def row() -> pa.RecordBatch:
            nonlocal done, n, held
            base, rules, sizes, symbols = compress(np.concatenate([x for x, _, _ in waiting]))
            docs, tokens = pa.concat_arrays([d for _, d, _ in waiting]).to_pylist(), np.concatenate([t for _, _, t in waiting]).tolist()
            out = {"part": part, "shard": n, "part_start": done, "doc_ids": docs, "doc_tokens": tokens, "base": base, "rules": rules.tobytes(), "rule_tokens": sizes.tobytes(), "symbols": symbols.tobytes()}
            done, n, held = done + held, n + 1, 0
            waiting.clear()
            return pa.RecordBatch.from_pylist([out], schema=kinds)

        for whole in batches:
            for batch in portions(whole, 1):
                ids, size = encoder.encode(batch.column(1), end_id)
                stops, lo, given = np.cumsum(size), 0, 0
                while lo < len(size):
                    # Documents up to the one that fills the shard.
                    hi = min(len(size), int(np.searchsorted(stops, given + shard_tokens - held)) + 1)
                    waiting.append((ids[given : stops[hi - 1]], batch.column(0)[lo:hi], size[lo:hi]))
                    held += int(stops[hi - 1]) - given
                    lo, given = hi, int(stops[hi - 1])
                    if held >= shard_tokens:
                        yield row()
        if waiting:
            yield row()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ("doc_id", F.xxhash64("text"))
    ordered.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(shards, SHARDS).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the shards at path: doc_id, start, n_tokens, ids (binary, unsigned 32-bit little-endian)."""
    shards = spark.read.schema(SHARDS).parquet(path)
    # One row a write task: bounded by the number of partitions.
    totals = sorted(shards.groupBy("part").agg(F.max(F.col("part_start") + F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect())
    begins, total = {}, 0
    for part, n in totals:
        begins[part], total = total, total + n

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = {name: batch.column(name)[i] for name in batch.schema.names}
                number = lambda name, s=shard: np.frombuffer(s[name].as_buffer(), dtype="<u4")
                ids = expand(number("symbols"), shard["base"].as_py(), number("rules").reshape(-1, 2), number("rule_tokens"))
                sizes, doc_ids = shard["doc_tokens"].values.to_numpy(), shard["doc_ids"].values
                ends = np.cumsum(sizes)
                starts = begins[shard["part"].as_py()] + shard["part_start"].as_py() + ends - sizes
                for lo in range(0, len(sizes), 1000):
                    cut = slice(lo, lo + 1000)
                    yield pa.RecordBatch.from_arrays([doc_ids[cut], pa.array(starts[cut]), pa.array(sizes[cut]), pa.array([ids[e - s : e].tobytes() for s, e in zip(sizes[cut], ends[cut], strict=True)], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return shards.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def op1_repair_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.fresh_path(spark, "repair")
    write_shards(common.table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
