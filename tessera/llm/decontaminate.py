"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised: lower case, words `\\w+`, one space between. An item of m characters may differ by
k = floor(m * ERROR_RATE) edits. It is cut into k + 1 pieces of like length; k edits leave one piece whole, so an occurrence
always holds an exact piece. An Aho-Corasick automaton finds the pieces of all items in one pass over each whole text;
around each hit Myers' bit-parallel algorithm computes the least edit distance of the item to a part of the text.

Items of fewer than MIN_CHARS normalised characters have no errors to spend: they match where the text holds them whole, word
for word. Items without a word (empty and null ones too) match nothing. Equal items each match. Null and empty texts match
nothing; repeated rows match each; a null doc_id is kept; texts of any length are searched whole. Of equally good places the
first is given. Empty tables give no matches. Other columns are ignored by `matches` and kept by `clean`, whatever their names.

Items are dealt to blocks of about BLOCK_CHARS characters (a longer item is a block's). Documents are scanned once: each batch
meets one block's automaton after another, so a worker holds one automaton, however large the benchmark.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ERROR_RATE = 0.06
MIN_CHARS = 24
BLOCK_CHARS = 4_000_000
WORD = re.compile(r"\w+")
MATCH = "item_id long, begin int, stop int, distance int"


def normal(text: str | None) -> str:
    return " ".join(WORD.findall(text.lower())) if text else ""


def pieces(item: str, rate: float = ERROR_RATE) -> list[tuple[int, str]]:
    """(offset, piece) of an item: one more than the edits it may differ by."""
    k = int(len(item) * rate)
    cuts = [round(i * len(item) / (k + 1)) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(mask: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern (its masks and length) to a part of text, and where that part first ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = mask.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE, min_chars: int = MIN_CHARS) -> None:
        self.given, self.rate, self.min_chars = items, rate, min_chars

    def ready(self) -> None:
        if hasattr(self, "automaton"):
            return
        import ahocorasick

        # A short item's one piece has spaces about it, so it is found at word borders alone.
        self.items = [(i, s) for i, t in self.given if (s := normal(t))]
        self.budget = [int(len(s) * self.rate) if len(s) >= self.min_chars else 0 for _, s in self.items]
        self.masks = [masks(s) if k else {} for (_, s), k in zip(self.items, self.budget, strict=True)]
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (_, s) in enumerate(self.items):
            for offset, piece in pieces(s, self.rate) if len(s) >= self.min_chars else [(0, f" {s} ")]:
                at.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()
        self.any = bool(at)

    def forget(self) -> None:
        """Free what ready() made."""
        for name in ("automaton", "items", "budget", "masks"):
            self.__dict__.pop(name, None)

    def __getstate__(self) -> dict:
        return {"given": self.given, "rate": self.rate, "min_chars": self.min_chars}

    def find(self, s: str) -> list[tuple[int, int, int, int]]:
        """(item_id, begin, stop, distance) for each item that a normalised text holds; the place is that of the window's best end in it."""
        if not self.any or not s:
            return []
        windows: dict[int, list[list[int]]] = {}
        # With a space on either side; places are those in s.
        for end, (size, places) in self.automaton.iter(f" {s} "):
            for n, offset in places:
                k, m = self.budget[n], len(self.items[n][1])
                if m < self.min_chars:
                    windows.setdefault(n, [[end + 1 - size, end - 1]])
                    continue
                lo, hi = max(0, end - size - offset - k), min(len(s), end - size - offset + m + k)
                spans = windows.setdefault(n, [])
                # Hits come by their ends; windows that overlap the last one are one search.
                if spans and lo <= spans[-1][1]:
                    spans[-1][0], spans[-1][1] = min(lo, spans[-1][0]), max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
        out = []
        for n, spans in sorted(windows.items()):
            item_id, item = self.items[n]
            if len(item) < self.min_chars:
                out.append((item_id, spans[0][0], spans[0][1], 0))
                continue
            exact = s.find(item)
            if exact >= 0:
                out.append((item_id, exact, exact + len(item), 0))
                continue
            if not self.budget[n]:
                continue
            best = min((myers(self.masks[n], len(item), s[lo:hi]) + (lo,) for lo, hi in spans), key=lambda x: (x[0], x[2] + x[1]))
            if best[0] <= self.budget[n]:
                stop = best[2] + best[1]
                out.append((item_id, max(0, stop - len(item) - best[0]), stop, best[0]))
        return out


def matchers(benchmark: DataFrame, block_chars: int | None = None) -> list:
    """Broadcast matchers of all items, block by block; the driver holds one block at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n, out = max(1, -(-chars // (block_chars or BLOCK_CHARS))), []
    for block in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).orderBy("item_id", "text").collect()
        if rows or not out:
            out.append(spark.sparkContext.broadcast(Matcher([(r[0], r[1]) for r in rows])))
    return out


def found(text: Column, blocks: list) -> Column:
    """array<struct<MATCH>> of the items of all blocks in whole texts, block by block."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("begin", pa.int32()), ("stop", pa.int32()), ("distance", pa.int32())]))
    names = tuple(kind.value_type.field(i).name for i in range(4))

    def of(texts: pa.Array) -> pa.Array:
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        clean = [normal(t.as_py()) for t in texts]
        for block in blocks:
            m = block.value
            m.ready()
            for i, s in enumerate(clean):
                out[i] += [dict(zip(names, x, strict=True)) for x in m.find(s)]
            if len(blocks) > 1:
                m.forget()
        return pa.array(out, kind)

    of.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(of, f"array<struct<{MATCH.replace(' ', ':').replace(',:', ',')}>>").asNondeterministic()(text.cast("string"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, begin, stop, distance): every item that a text of docs (doc_id, text) holds."""
    return docs.select("doc_id", F.explode(found(F.col("text"), matchers(benchmark))).alias("m")).select("doc_id", "m.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no item; all columns."""
    return docs.where(F.size(found(F.col("text"), matchers(benchmark))) == 0)


def op6_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def plain_distance(item: str, text: str) -> int:
    """The least edit distance of item to a part of text by the textbook recurrence, for tests."""
    before = np.zeros(len(text) + 1, dtype=np.int64)
    for i, c in enumerate(item, 1):
        now = np.empty_like(before)
        now[0] = i
        for j, d in enumerate(text, 1):
            now[j] = min(before[j - 1] + (c != d), before[j] + 1, now[j - 1] + 1)
        before = now
    return int(before.min())
