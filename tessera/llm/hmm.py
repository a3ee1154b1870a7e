"""Language-model scoring by a hidden Markov model over words.

Tokens: the words of a text (A-Z lower-cased, cut at `[\\x20\\x09-\\x0D]`), then one end. Null text: the end alone.

Counts of all training tokens are made by Spark. The SYMBOLS most frequent words are symbols of the model by themselves;
every other word, seen or not, belongs to one of CLASSES classes by the crc32 of its last three bytes, and its emissions are tied:
a state emits the class, and within the class a word of count c has the share (c + 0.1) / (N + 0.1 * (V + 1)), with the class's
training tokens N and kinds V. As in the base, all unseen words of a class are one kind: the model is a distribution over
texts in which each unseen word stands as its class's unknown word. A text's score is the sum of the class shares' logarithms
and the exact likelihood of its symbols by the scaled forward recursion.

Baum-Welch: expected counts of states, moves and symbols are made for all training texts in each partition, added up by
Spark, and normalised on the driver (STATES x (SYMBOLS + CLASSES + 1) numbers). Rounds over all training texts go on until one
gains under TOLERANCE (log10 a token), MOST_ROUNDS at most. The start of the first round is a model fitted to at most
SEED_DOCS texts of at most SEED_WORDS tokens, first by a hash of doc_id.

Texts are read once: their symbols and sums go to a table that the rounds and the scoring read. Counts of the LISTED most
frequent words of at most LISTED_BYTES go to every worker, a bounded list; for the other words a text's distinct words are
joined with the table of counts, in as many partitions as the rows need. Rows are told apart by a number of their own, so
repeated rows are scored each. A null doc_id counts as held out and is never learned from. Texts of any length are scored
whole. An empty table gives no rows; without training texts every word is unseen. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .sequences import Layout, backward, batches, forward, pairs
from .tokens import portions

STATES, SYMBOLS, CLASSES, LISTED, LISTED_BYTES = 8, 20_000, 512, 250_000, 64
SEED_DOCS, SEED_WORDS, SEED_ROUNDS = 1200, 20_000, 15
TOLERANCE, MOST_ROUNDS = 0.002, 8
SMOOTH = 0.1
BATCH_WORDS = 150_000
#: Bytes of text that are read at once.
PORTION = 2 << 20
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
#: Rows of the join of rare words in a partition, about.
JOINED = 1_000_000
FACTS = "held_out boolean, n_tokens long, known long, base double, share double, symbols array<int>, words array<binary>, times array<int>"


def held_out(doc_id: Column) -> Column:
    return common.fold(doc_id, 10) == 0


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words of texts (binary), the number of each word in the texts, and each text's number of words; null: none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    numbered = split.flatten().dictionary_encode()
    at = numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    count = split.value_lengths().to_numpy(zero_copy_only=False)
    empty = pc.index(numbered.dictionary, "").as_py()
    if empty < 0:
        return numbered.dictionary.cast(pa.binary()), at, count
    # White space at a text's ends leaves an empty string, which is no word.
    real = at != empty
    owner = np.repeat(np.arange(len(count)), count)[real]
    return numbered.dictionary.cast(pa.binary()), at[real], np.bincount(owner, minlength=len(count))


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, n) over whole texts of docs."""

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            total = pa.concat_tables(waiting).group_by("word").aggregate([("n", "sum")])
            waiting.clear()
            return pa.RecordBatch.from_arrays([total["word"].combine_chunks(), total["n_sum"].combine_chunks()], names=["word", "n"])

        waiting: list[pa.Table] = []
        for whole in found:
            for batch in portions(whole, 0, PORTION):
                words, at, _ = cut(batch.column(0))
                n = np.bincount(at, minlength=len(words))
                some = np.flatnonzero(n)
                waiting.append(pa.table({"word": words.take(pa.array(some)), "n": n[some]}))
                if sum(map(len, waiting)) > COUNTED:
                    yield out()
        if waiting:
            yield out()

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


class Model:
    """What a worker needs to score: listed words and counts, class totals, and the chain's parameters."""

    def __init__(self, words: list[bytes], counts: np.ndarray, class_n: np.ndarray, class_v: np.ndarray) -> None:
        self.words, self.counts, self.class_n, self.class_v = words, counts, class_n, class_v
        self.symbols = min(SYMBOLS, len(words))
        self.size = self.symbols + CLASSES + 1
        self.start = np.full(STATES, 1 / STATES)
        self.move = np.full((STATES, STATES), 1 / STATES)
        self.emit = np.full((STATES, self.size), 1 / self.size)

    def ready(self) -> None:
        """Tables by rank; made once a worker."""
        if hasattr(self, "rank"):
            return
        self.rank = {w: i for i, w in enumerate(self.words)}
        classes = np.array([class_of(w) for w in self.words[self.symbols :]], dtype=np.int64)
        self.symbol = np.concatenate([np.arange(self.symbols), self.symbols + classes])
        self.log_count = np.log10(self.counts + SMOOTH)
        self.class_log = np.log10(self.class_n + SMOOTH * (self.class_v + 1))
        self.share = np.concatenate([np.zeros(self.symbols), self.log_count[self.symbols :] - self.class_log[classes]])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("rank", "symbol", "log_count", "class_log", "share")}

    def read(self, texts: pa.Array) -> dict[str, pa.Array]:
        """Per text: n_tokens and symbols with the end, known (tokens on the list), base and share (sums of log10(c + 0.1) and of class shares over them), words and times of the words off the list."""
        words, at, count = cut(texts)
        owner = np.repeat(np.arange(len(count)), count)
        kinds = words.to_numpy(zero_copy_only=False).tolist()
        rank = np.fromiter((self.rank.get(w, -1) for w in kinds), dtype=np.int64, count=len(kinds))
        off = np.flatnonzero(rank < 0)
        symbol = np.concatenate([self.symbol, [self.size - 1]])[rank]
        symbol[off] = [self.symbols + class_of(kinds[i]) for i in off.tolist()]
        known, ends = rank[at] >= 0, np.cumsum(count + 1)
        line = np.full(ends[-1] if len(ends) else 0, self.size - 1, dtype=np.int32)
        line[np.arange(len(at)) + owner] = symbol[at]
        add = lambda x: np.bincount(owner[known], weights=x[rank[at[known]]], minlength=len(count))
        # Different words off the list of each text, in the order of their numbers.
        keys, times = np.unique(owner[~known] * len(kinds) + at[~known], return_counts=True)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(keys // max(len(kinds), 1), minlength=len(count)))]).astype(np.int32)
        rare = words.take(pa.array(keys % max(len(kinds), 1)))
        return {
            "n_tokens": pa.array(count.astype(np.int64) + 1),
            "known": pa.array(np.bincount(owner[known], minlength=len(count))),
            "base": pa.array(add(self.log_count), pa.float64()),
            "share": pa.array(add(self.share), pa.float64()),
            "symbols": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(line)),
            "words": pa.ListArray.from_arrays(pa.array(bounds), rare),
            "times": pa.ListArray.from_arrays(pa.array(bounds), pa.array(times.astype(np.int32))),
        }

    def run(self, sequences: list[np.ndarray], kind: type = np.float64) -> Iterator[tuple[list[int], Layout, np.ndarray, np.ndarray]]:
        """By batch: places in the list, layout, symbols by place, emissions."""
        table = np.ascontiguousarray(self.emit.T, dtype=kind)
        for at in batches([len(x) for x in sequences], BATCH_WORDS):
            layout = Layout(np.array([len(sequences[i]) for i in at]))
            items = np.empty(len(layout.place), dtype=np.int64)
            items[layout.place] = np.concatenate([sequences[i] for i in at])
            yield at, layout, items, np.ascontiguousarray(table[items].T)

    def expect(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves and emissions (Baum-Welch) over sequences, and their log10 likelihood. Single precision inside a batch."""
        first, moves, emitted, likelihood = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, self.size)), 0.0
        for _, layout, items, emit in self.run(sequences, np.float32):
            alpha, scale = forward(layout, self.start, self.move, emit)
            beta = backward(layout, self.move, emit, scale)
            posterior = alpha * beta
            first += posterior[:, : layout.running[0]].sum(axis=1)
            moves += pairs(layout, self.move, emit, alpha, beta, scale)
            for k in range(STATES):
                emitted[k] += np.bincount(items, weights=posterior[k], minlength=self.size)
            likelihood += float(np.log10(scale, dtype=np.float64).sum())
        return first, moves, emitted, likelihood

    def update(self, first: np.ndarray, moves: np.ndarray, emitted: np.ndarray) -> None:
        """New parameters from expected counts; a little of the mean over states keeps all of them positive."""
        mean = (emitted.sum(axis=0) + 0.01) / (emitted.sum() + 0.01 * self.size)
        self.start = (first + 0.01) / (first.sum() + 0.01 * STATES)
        self.move = (moves + 0.01) / (moves + 0.01).sum(axis=1, keepdims=True)
        # One pseudo token for every 20 symbols, shared as the mean: rare symbols keep a place in each state.
        prior = self.size / 20
        self.emit = (emitted + prior * mean) / (emitted.sum(axis=1, keepdims=True) + prior)

    def seed(self, sequences: list[np.ndarray], rounds: int = SEED_ROUNDS, seed: int = 3) -> None:
        """Start parameters from a bounded sample: first each text leans to a state, then Baum-Welch."""
        if not sequences:
            return
        rng = np.random.default_rng(seed)
        emitted = np.zeros((STATES, self.size))
        for x in sequences:
            emitted += rng.dirichlet(np.full(STATES, 0.2))[:, None] * np.bincount(x, minlength=self.size)
        self.update(np.ones(STATES), np.eye(STATES) * 20 + 1, emitted)
        for _ in range(rounds):
            self.update(*self.expect(sequences)[:3])

    def chain(self) -> Model:
        """A copy that scores and learns but does not read texts."""
        out = Model.__new__(Model)
        out.__dict__.update({k: v for k, v in self.__getstate__().items() if k not in ("words", "counts")})
        return out

    def score(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 likelihood of each sequence by the scaled forward recursion."""
        out = np.zeros(len(sequences))
        for at, layout, _, emit in self.run(sequences):
            _, scale = forward(layout, self.start, self.move, emit)
            owner = np.empty(len(layout.place), dtype=np.int64)
            owner[layout.place] = layout.owner
            out[at] = np.bincount(owner, weights=np.log10(scale), minlength=len(at))
        return out


def sequences_of(lists: pa.Array) -> list[np.ndarray]:
    """The arrays of a list column."""
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(lists.flatten().to_numpy(zero_copy_only=False), ends[:-1]) if len(ends) else []


def baum_welch(facts: DataFrame, model: Model) -> float:
    """One round over all rows of facts (symbols): counts per partition, added up by Spark, applied to model.

    Gives the mean log10 likelihood of a token before the round.
    """
    given = facts.sparkSession.sparkContext.broadcast(model.chain())

    def expect(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        total, waiting, size = None, [], 0

        def add() -> None:
            nonlocal total
            got = m.expect(waiting)
            total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))

        for batch in found:
            for x in sequences_of(batch.column(0)):
                waiting.append(x)
                size += len(x)
                if size >= 4 * BATCH_WORDS:
                    add()
                    waiting, size = [], 0
        if waiting:
            add()
        if total is not None:
            rows = np.concatenate([total[0][:, None], total[1], total[2], np.full((STATES, 1), total[3])], axis=1).T
            keep = np.flatnonzero(rows.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(keep), *(pa.array(rows[keep, k]) for k in range(STATES))], names=["i", *(f"s{k}" for k in range(STATES))])

    schema = "i long, " + ", ".join(f"s{k} double" for k in range(STATES))
    sums = facts.select("symbols").mapInArrow(expect, schema).groupBy("i").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(STATES))).toArrow()
    rows = np.zeros((2 + STATES + model.size, STATES))
    rows[sums["i"].to_numpy()] = np.stack([sums[f"s{k}"].to_numpy() for k in range(STATES)], axis=1)
    model.update(rows[0], rows[1 : 1 + STATES].T.copy(), rows[1 + STATES : -1].T.copy())
    given.unpersist()
    return rows[-1, 0] / max(rows[1 + STATES : -1].sum(), 1.0)


def vocabulary(counts: DataFrame) -> Model:
    """A model with the listed words of counts and the classes' totals, not trained yet."""
    listed = counts.where(F.octet_length("word") <= LISTED_BYTES).orderBy(F.desc("n"), "word").limit(LISTED).toArrow()
    words, n = listed["word"].to_pylist(), listed["n"].to_numpy().astype(np.float64)
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    words, n = [words[i] for i in order], n[order] if len(order) else n
    tail = F.expr("substring(word, -3, 3)")
    by_class = counts.groupBy(F.pmod(F.crc32(tail), F.lit(CLASSES)).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, total, kinds in by_class:
        class_n[k], class_v[k] = total, kinds
    for w, c in zip(words[:SYMBOLS], n[:SYMBOLS], strict=False):
        class_n[class_of(w)] -= c
        class_v[class_of(w)] -= 1
    return Model(words, n, class_n, class_v)


def train(model: Model, facts: DataFrame, most_rounds: int | None = None) -> list[float]:
    """Baum-Welch over facts (doc_id, symbols) until a round gains little; gives the likelihoods before the rounds."""
    small = facts.where(F.size("symbols") <= SEED_WORDS).where("doc_id is not null")
    first = small.select("doc_id", "symbols").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("symbols")).limit(SEED_DOCS).select("symbols").toArrow()
    model.seed([x for part in first["symbols"].chunks for x in sequences_of(part)])
    seen: list[float] = []
    for _ in range(MOST_ROUNDS if most_rounds is None else most_rounds):
        seen.append(baum_welch(facts, model))
        if len(seen) > 1 and seen[-1] - seen[-2] < TOLERANCE:
            break
    return seen


def scored(docs: DataFrame, train_on: DataFrame | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    train_on: texts to learn from, none of them held out; by default those of docs that are not held out.
    """
    spark = docs.sparkSession
    only = lambda df, held: df.select("doc_id", F.col("text").cast("string").alias("text"), held.alias("held_out"))
    docs = only(docs, held_out(F.col("doc_id")))
    training = docs.where("not held_out") if train_on is None else only(train_on, F.lit(False))
    counts = common.materialize(count_words(training), "words")
    texts = training.count()
    n_words, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, kinds = n_words + texts, kinds + (texts > 0)
    per_token = float(np.log10(total + SMOOTH * (kinds + 1)))
    end_log = float(np.log10(texts + SMOOTH))
    model = vocabulary(counts)
    model.ready()
    given = spark.sparkContext.broadcast(model)

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        m.ready()
        for whole in found:
            for batch in portions(whole, 2, PORTION):
                facts = m.read(batch.column(2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *facts.values()], names=["doc_id", "held_out", *facts])

    key = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    facts_of = lambda df: common.materialize(df.select("doc_id", "held_out", "text").mapInArrow(read, f"{key}, {FACTS}").withColumn("row", F.monotonically_increasing_id()), "facts")
    facts = facts_of(docs)
    learned = facts.where("not held_out") if train_on is None else facts_of(training)
    train(model, learned)
    if train_on is not None:
        common.remove(spark, learned)
    trained = spark.sparkContext.broadcast(model.chain())

    def score(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = trained.value
        for whole in found:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                chain = m.score(sequences_of(batch.column("symbols")))
                yield batch.drop_columns(["symbols"]).append_column("chain", pa.array(chain, pa.float64()))

    kept = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "share"]
    rows = facts.select(*kept, "symbols").mapInArrow(score, f"row long, {key}, " + ", ".join(f for f in FACTS.split(", ") if f.split()[0] in kept) + ", chain double")
    off = facts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    # Counts of listed words are with the workers already; the others are long, or at most as frequent as the last of the list.
    rest = counts.where((F.octet_length("word") > LISTED_BYTES) | (F.col("n") <= (float(model.counts[-1]) if len(model.counts) == LISTED else 0.0)))
    log = F.log10(F.coalesce("n", F.lit(0)) + SMOOTH) * F.col("times")
    # A class's logarithm by the word's class, from an array literal of CLASSES numbers.
    class_log = F.element_at(F.array(*map(F.lit, model.class_log.tolist())), (F.pmod(F.crc32(F.expr("substring(word, -3, 3)")), F.lit(CLASSES)) + 1).cast("int"))
    pairs_n = facts.agg(F.coalesce(F.sum(F.size("words").cast("long")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs_n // JOINED))
    sums = off.repartition(parts, "word").join(rest, "word", "left").groupBy("row").agg(F.sum(log).alias("log"), F.sum(class_log * F.col("times")).alias("class_log"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known_off"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return rows.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known_off", F.lit(0)) + int(texts > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + end_log + zero(F.col("log")) - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("chain") + F.col("share") + zero(F.col("log")) - zero(F.col("class_log"))).alias("score"),
    )


def op5_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(common.table(spark, sf_dir, "documents"))
