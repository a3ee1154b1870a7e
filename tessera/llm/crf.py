"""Language identification by a linear-chain conditional random field over words.

Each word of a text (a run of letters, lower-cased; a run of over LONGEST letters is cut into several) gets a language;
features are its affixes, all its character n-grams and the lexicons that hold it, hashed into BUCKETS weights, and
transitions between the languages of neighbouring words are learned with them. Posteriors come from forward-backward over the
whole text; the text's language has the largest mean posterior, which is the score.

Training sees a bounded sample: of each language PER_LANGUAGE documents (first by a hash of doc_id), and of each of those up to
SPANS_PER_DOC spans of 4 to 15 words, drawn uniformly over its whole text in the executors. Spans of different languages are
put in one sequence, so transitions are learned from code-switched text. Scoring covers every word of every text.

Null texts and texts without a letter are `und` with score 0; so is every text when no language could be learned. A null
doc_id counts as held out and is never learned from. Repeated rows are sampled once and scored each. Texts of any length
are scored whole. Of languages with equal posteriors the first in order is taken. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .sequences import Layout, backward, batches, forward, pairs
from .tokens import gather, portions

#: Documents of a language, and spans of a document, that training sees at most.
PER_LANGUAGE, SPANS_PER_DOC = 300, 20
#: Parts of a language that are ranked apart, step by step, before the whole.
SALTS = (64, 8)
UNKNOWN = "und"
#: Letters of a word at most; a longer run of letters is several words.
LONGEST = 64
BUCKETS = 1 << 16
#: Words a worker keeps emissions of; bounds memory only.
CACHE_WORDS = 600_000
#: Words that one batch of the recursions holds at most, unless a single text has more.
BATCH_WORDS = 300_000


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words of texts, the number of each word in the texts, and each text's number of words; null: none."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    split = pc.split_pattern_regex(low, r"[^\p{L}]+")
    if (pc.max(pc.utf8_length(split.flatten())).as_py() or 0) > LONGEST:
        split = pc.split_pattern_regex(pc.replace_substring_regex(low, rf"(\p{{L}}{{{LONGEST}}})", r"\1 "), r"[^\p{L}]+")
    numbered = split.flatten().dictionary_encode()
    at = numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    count = split.value_lengths().to_numpy(zero_copy_only=False)
    empty = pc.index(numbered.dictionary, "").as_py()
    if empty < 0:
        return numbered.dictionary, at, count
    # What stands before the first letter and after the last is no word.
    real = at != empty
    owner = np.repeat(np.arange(len(count)), count)[real]
    return numbered.dictionary, at[real], np.bincount(owner, minlength=len(count))


def _mixed(codes: list[np.ndarray], seed: int) -> np.ndarray:
    h = np.full(len(codes[0]), seed * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
    for c in codes:
        h = (h ^ c) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return (h >> np.uint32(16)).astype(np.int64) & (BUCKETS - 1)


def features(words: list[str], lexicon: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' features, one word after another, and each word's number of them (at least 1)."""
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    begin = np.cumsum(size + 2) - size - 2
    owner = np.repeat(np.arange(len(words)), size + 2)
    place = np.arange(len(codes)) - begin[owner]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for n in (2, 3):
        at = np.flatnonzero(place <= size[owner] + 2 - n)
        found.append((owner[at], _mixed([codes[at + i] for i in range(n)], n)))
    for n in (1, 2, 3, 4):
        some = np.flatnonzero(size >= n)
        for side, start in ((0, begin[some] + 1), (1, begin[some] + 1 + size[some] - n)):
            found.append((some, _mixed([codes[start + i] for i in range(n)], 10 + 2 * n + side)))
    listed = [(i, x) for i, w in enumerate(words) for x in lexicon.get(w, (zlib.crc32(b"=") % BUCKETS,))]
    found.append((np.array([i for i, _ in listed], dtype=np.int64), np.array([x for _, x in listed], dtype=np.int64)))
    of, bucket = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    return bucket[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))


class Tagger:
    """Weights of a trained field. lexicon: the buckets of a listed word's own feature and of the lexicons that hold it."""

    def __init__(self, languages: list[str], lexicon: dict[str, tuple[int, ...]], weights: np.ndarray, moves: np.ndarray) -> None:
        self.languages, self.lexicon, self.weights, self.moves = languages, lexicon, weights, moves
        self.rows: dict[str, int] = {}
        self.table = np.empty((0, len(languages)), dtype=np.float32)

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "lexicon": self.lexicon, "weights": self.weights.astype(np.float32), "moves": self.moves}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Each word's emission by language, the largest being 1."""
        bucket, count = features(words, self.lexicon)
        score = np.add.reduceat(self.weights[bucket], np.cumsum(count) - count, axis=0, dtype=np.float64)
        return np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -30.0)).astype(np.float32)

    def places(self, words: list[str]) -> np.ndarray:
        """Rows of different words in self.table."""
        if len(self.rows) > CACHE_WORDS:
            self.rows, self.table = {}, self.table[:0]
        at = np.fromiter((self.rows.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        new = np.flatnonzero(at < 0)
        for lo in range(0, len(new), 50_000):
            some = new[lo : lo + 50_000]
            at[some] = np.arange(len(self.table), len(self.table) + len(some))
            made = [words[i] for i in some.tolist()]
            self.rows.update(zip(made, at[some].tolist(), strict=True))
            self.table = np.concatenate([self.table, self.emissions(made)])
        return at

    def predict(self, texts: pa.Array) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return out
        words, at, count = words_of(texts)
        items = self.places(words.to_numpy(zero_copy_only=False).tolist())[at] if len(at) else at
        begin = np.cumsum(count) - count
        move = np.exp(self.moves - self.moves.max())
        start = np.full(len(self.languages), 1.0)
        some = np.flatnonzero(count)
        for group in batches(count[some].tolist(), BATCH_WORDS):
            texts_of = some[group]
            layout = Layout(count[texts_of])
            item = np.empty(len(layout.place), dtype=np.int64)
            item[layout.place] = gather(items, begin, count, texts_of)[0]
            emit = np.ascontiguousarray(self.table[item].T)
            alpha, scale = forward(layout, start, move, emit)
            posterior = alpha * backward(layout, move, emit, scale)
            owner = np.empty_like(item)
            owner[layout.place] = layout.owner
            mean = np.stack([np.bincount(owner, weights=p, minlength=len(texts_of)) for p in posterior], axis=1)
            mean /= mean.sum(axis=1, keepdims=True)
            for i, m in zip(texts_of.tolist(), mean, strict=True):
                k = int(m.argmax())
                out[i] = self.languages[k], float(m[k])
        return out


def train(spans: list[tuple[str, list[str]]], epochs: int = 3, seed: int = 1, rate: float = 0.15) -> Tagger:
    """Fit on spans (language, words) by stochastic gradients of the conditional likelihood (AdaGrad).

    An epoch sees as many spans as there are, drawn so that each language is as frequent as any other.
    """
    languages = sorted({x for x, words in spans if words})
    k = len(languages)
    if not k:
        return Tagger([], {}, np.zeros((BUCKETS, 0)), np.zeros((0, 0)))
    rng = np.random.default_rng(seed)
    place: dict[str, int] = {}
    by_language: list[list[np.ndarray]] = [[] for _ in range(k)]
    for x, words in spans:
        if words:
            by_language[languages.index(x)].append(np.array([place.setdefault(w, len(place)) for w in words]))
    seen = np.stack([np.bincount(np.concatenate(s), minlength=len(place)) for s in by_language], axis=1)
    # Lexicons: words seen at least 5 times whose share in a language is 5 times their share elsewhere.
    share = seen / seen.sum(axis=0)
    typical = share > 5 * (share.sum(axis=1, keepdims=True) - share)
    words = list(place)
    lexicon = {words[i]: tuple(zlib.crc32(x.encode()) % BUCKETS for x in (f"={words[i]}", *(f"L{y}" for y in np.flatnonzero(typical[i])))) for i in np.flatnonzero(seen.sum(axis=1) >= 5).tolist()}
    buckets, count = features(words, lexicon)
    first = np.cumsum(count) - count
    weights, moves = np.zeros((BUCKETS, k)), np.zeros((k, k))
    square, move_square = np.full((BUCKETS, k), 1e-6), np.full((k, k), 1e-6)
    n_spans = sum(map(len, by_language))
    for _ in range(epochs):
        # Sequences of three spans, each from a language drawn anew.
        drawn = [(y, by_language[y][int(rng.integers(len(by_language[y])))]) for y in rng.integers(0, k, -(-n_spans // 3) * 3).tolist()]
        for lo in range(0, len(drawn), 240):
            chunk = drawn[lo : lo + 240]
            sizes = np.array([len(w) for _, w in chunk])
            gold = np.repeat([y for y, _ in chunk], sizes)
            layout = Layout(sizes.reshape(-1, 3).sum(axis=1))
            at = np.concatenate([w for _, w in chunk])
            flat, stops = gather(buckets, first, count, at)
            owner = np.repeat(np.arange(len(at)), count[at])
            score = np.add.reduceat(weights[flat], stops - count[at], axis=0)
            emit = np.empty((k, len(at)))
            emit[:, layout.place] = np.exp(np.clip(score - score.max(axis=1, keepdims=True), -30, 0)).T
            move = np.exp(moves - moves.max())
            alpha, scale = forward(layout, np.ones(k), move, emit)
            beta = backward(layout, move, emit, scale)
            expected = (alpha * beta)[:, layout.place].T
            expected /= expected.sum(axis=1, keepdims=True)
            g = np.eye(k)[gold] - expected
            hit, which = np.unique(flat, return_inverse=True)
            step = np.stack([np.bincount(which, weights=g[owner, y], minlength=len(hit)) for y in range(k)], axis=1) / (len(chunk) // 3)
            square[hit] += step**2
            weights[hit] += rate * step / np.sqrt(square[hit])
            same = layout.owner[1:] == layout.owner[:-1]
            true = np.zeros((k, k))
            np.add.at(true, (gold[:-1][same], gold[1:][same]), 1)
            gm = (true - pairs(layout, move, emit, alpha, beta, scale)) / (len(chunk) // 3) - 1e-3 * moves
            move_square += gm**2
            moves += rate * gm / np.sqrt(move_square)
    return Tagger(languages, lexicon, weights, moves)


def draw(words: list[str], rng: np.random.Generator, most: int) -> list[list[str]]:
    """At most `most` spans of 4 to 15 words, drawn uniformly over those that cut the whole text one after another."""
    cuts = np.cumsum(rng.integers(4, 16, len(words) // 4 + 1))
    begins = np.concatenate([[0], cuts])[: int(np.searchsorted(cuts, len(words))) + 1]
    picked = np.sort(rng.permutation(len(begins))[:most]) if words else []
    return [words[begins[i] : cuts[i]] for i in picked]


def sample(docs: DataFrame, folds: int = 5, per_language: int = PER_LANGUAGE, per_doc: int = SPANS_PER_DOC) -> list[tuple[str, list[str]]]:
    """Spans (lang, words) of at most per_language documents of each language, none whose crc32(doc_id) mod folds is 0."""
    # Ranked inside salted parts of a language first, so a rank reads SALTS[-1] * per_language rows of a language at most.
    known = docs.select(F.col("lang").cast("string").alias("lang"), "doc_id", F.col("text").cast("string").alias("text")).where("lang is not null and text is not null").where(common.fold(F.col("doc_id"), folds) != 0)
    hashed = F.xxhash64("text").alias("text_hash")
    ids, order = known.select("lang", "doc_id", hashed), (F.xxhash64("doc_id"), "doc_id", "text_hash")
    for n in (*SALTS, 1):
        salt = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(n)) if n > 1 else F.lit(0)
        w = Window.partitionBy("lang", "salt").orderBy(*order)
        ids = ids.withColumn("salt", salt).withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_language).drop("n", "salt")
    rows = known.withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(ids.distinct()), ["lang", "doc_id", "text_hash"], "left_semi")

    def spans(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            langs, drawn = [], []
            for lang, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words, at, _ = words_of(pa.array([text.as_py()]))
                got = draw(words.take(pa.array(at)).to_pylist(), np.random.default_rng(zlib.crc32(doc.encode())), per_doc)
                langs += [lang] * len(got)
                drawn += got
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(drawn, pa.list_(pa.string()))], names=["lang", "words"])

    # At most per_language * per_doc spans of 15 words of LONGEST letters a language.
    rows = rows.dropDuplicates(["lang", "doc_id", "text_hash"]).select("lang", F.col("doc_id").cast("string").alias("doc_id"), "text")
    got = rows.mapInArrow(spans, "lang string, words array<string>").toArrow()
    return sorted(zip(got["lang"].to_pylist(), got["words"].to_pylist(), strict=True))


def language(text: Column, tagger) -> Column:
    """struct(lang_pred, score) of whole texts; tagger: a broadcast Tagger."""

    def of(texts: pa.Array) -> pa.Array:
        got = [x for part in portions(pa.record_batch([texts.cast(pa.string())], names=["text"]), 0) for x in tagger.value.predict(part.column(0))]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["lang_pred", "score"])

    of.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(of, "struct<lang_pred:string,score:double>").asNondeterministic()(text.cast("string"))


def op4_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    tagger = spark.sparkContext.broadcast(train(sample(docs)))
    held = common.fold(F.col("doc_id"), 5) == 0
    return docs.select("doc_id", held.alias("held_out"), language(F.col("text"), tagger).alias("l")).select("doc_id", "held_out", "l.lang_pred", "l.score")
