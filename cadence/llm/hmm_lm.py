"""Hidden Markov language model.

Tokens are the white-space words of a text, A-Z in lower case, and one end.
A token's class is itself if it is one of the most frequent training words,
else a hash bucket; the HMM emits classes, and a class emits its words by
their add-one counts, unknown words sharing one extra count in each bucket
that holds none of the frequent words. So a text has an exact probability
over an open vocabulary.

Training: words are counted over all training documents. Baum-Welch then runs
over all of them, cut into segments of bounded length; every task returns its
expected counts by class, which are summed before they meet on the driver
(classes and states are bounded). Scoring is the scaled forward recursion over
the whole text.

Counts: the most frequent words (bounded) go to the tasks; the other words of
each document are joined with the table of counts by word, after each document
has counted its own, so no word is hot and no vocabulary is broadcast.

Defined cases: a null or empty text is its end alone; a null doc_id counts as
the empty text for the fold and is carried; repeated rows are scored
separately; without training documents every count is zero and the model is
uniform; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialise, slices, text_or_empty

FOLDS, HELD_OUT_FOLD = 7, 2
#: The end of a text, as a token; no word is empty.
END = b""
#: Words whose counts the tasks hold; those that are their own class; hash buckets for the others.
HEAD, FREQUENT, BUCKETS = 150_000, 24_000, 2_048
STATES, ROUNDS = 8, 4
#: Tokens of a training segment, and of the rows that are worked on at once.
SEGMENT, AT_ONCE = 512, 800_000
#: Distinct words that a task counts before it sends them on.
COUNTED_WORDS = 300_000
#: Expected counts that every class has in every state beforehand, as a share of its frequency.
PRIOR = 0.5


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def held_out():
    return (F.crc32(id_text().cast("binary")) % FOLDS) == HELD_OUT_FOLD


def word_counts(texts: DataFrame) -> DataFrame:
    """Rows (word, c) over the column ``text``; the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def send():
            words, n = list(found.keys()), list(found.values())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

        for batch in batches:
            for a, b in slices(batch.num_rows, 1000):
                for text in batch.column(0).slice(a, b - a).to_pylist():
                    found.update(tokens(text))
                    if len(found) > COUNTED_WORDS:
                        yield send()
            found[END] += batch.num_rows
        yield send()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """The most frequent words: their classes and the logarithms of their counts. All others have a bucket's class."""

    place: dict[bytes, int]
    classes: np.ndarray
    logs: np.ndarray
    frequent: int
    buckets: int

    @classmethod
    def of(cls, words: list[bytes], counts: list[int], frequent: int, buckets: int) -> Vocabulary:
        frequent = min(frequent, len(words))
        classes = [i if i < frequent else frequent + bucket(w, buckets) for i, w in enumerate(words)]
        return cls({w: i for i, w in enumerate(words)}, np.array(classes, dtype=np.int64), np.log10(np.array(counts, dtype=np.float64) + 1), frequent, buckets)

    @property
    def size(self) -> int:
        return self.frequent + self.buckets


def bucket(word: bytes, buckets: int) -> int:
    """Spark's ``pmod(xxhash64(word), buckets)`` for a power of two."""
    return xxhash.xxh64_intdigest(word, 42) & (buckets - 1)


def _coded(vocabulary):
    """Rows of ``CODED``: class numbers of the tokens, sums over the vocabulary's words, and the other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        within = np.where(v.classes >= v.frequent, v.logs, 0.0)
        row = TaskContext.get().partitionId() << 32
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
        for batch in batches:
            for a, b in slices(batch.num_rows, 1000):
                part = batch.slice(a, b - a)
                out: list[list] = [[] for _ in kinds]
                for text in part.column(2).to_pylist():
                    words = [*tokens(text), END]
                    place = np.array([v.place.get(w, -1) for w in words], dtype=np.int64)
                    known = place >= 0
                    rest: Counter = Counter()
                    classes = v.classes[place] if v.classes.size else place.copy()
                    if not known.all():
                        other = [words[i] for i in np.flatnonzero(~known)]
                        rest.update(other)
                        classes[~known] = [v.frequent + bucket(w, v.buckets) for w in other]
                    mine = place[known]
                    for column, value in zip(out, (
                        len(words), classes.astype("<u2").tobytes(), int(mine.size), float(v.logs[mine].sum()), float(within[mine].sum()), list(rest.keys()), list(rest.values())
                    )):
                        column.append(value)
                rows = pa.array(range(row, row + part.num_rows), pa.int64())
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([rows, part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(out, kinds))], CODED_NAMES)

    return run


CODED = "row long, doc_id long, held_out boolean, n_tokens long, classes binary, known long, log_known double, log_within double, rest array<binary>, rest_n array<long>"
CODED_NAMES = [x.split()[0] for x in CODED.split(", ")]


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # (class, state)

    @classmethod
    def first(cls, frequency: np.ndarray, states: int) -> Hmm:
        """Emissions near the classes' frequencies, moved apart by a fixed draw; states tend to stay."""
        draw = np.random.default_rng(7).gamma(0.6, size=(frequency.size, states)) + 0.05
        emit = frequency[:, None] * draw
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    def next(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, frequency: np.ndarray) -> Hmm:
        """The model of expected counts, each with a small prior."""
        emit = emit + PRIOR * frequency[:, None] * frequency.size
        move, start = move + 0.1, start + 0.1
        return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _by_length(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences, longest first, as one padded-free table: all first tokens, all second ones, ..."""
    sizes = np.array([s.size for s in sequences])
    flat = np.concatenate(sequences)
    begin = np.cumsum(sizes) - sizes
    live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # sequences with more than t tokens
    step = np.repeat(np.arange(sizes[0]), live)
    which = np.arange(step.size) - np.repeat(np.cumsum(live) - live, live)
    return flat[begin[which] + step], live


def forward(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each sequence, by the scaled forward recursion."""
    order = sorted(range(len(sequences)), key=lambda i: -sequences[i].size)
    table, live = _by_length([sequences[i] for i in order])
    total = np.zeros(len(sequences))
    alpha, a = None, 0
    for n in live.tolist():
        emit = model.emit[table[a : a + n]]
        alpha = (model.start if alpha is None else alpha[:n] @ model.move) * emit
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:n] += np.log10(scale)
        a += n
    out = np.empty(len(sequences))
    out[order] = total
    return out


def expected_counts(model: Hmm, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts (start, move, emit) of sequences."""
    table, live = _by_length(sorted(sequences, key=lambda s: -s.size))
    ends = np.cumsum(live).tolist()
    begins = [0, *ends[:-1]]
    emit = model.emit[table]
    alpha, beta, scale = np.empty_like(emit), np.ones_like(emit), np.empty((table.size, 1), dtype=emit.dtype)
    for t, (a, b) in enumerate(zip(begins, ends)):
        now = (alpha[begins[t - 1] : begins[t - 1] + b - a] @ model.move if t else model.start) * emit[a:b]
        now.sum(axis=1, keepdims=True, out=scale[a:b])
        np.divide(now, scale[a:b], out=alpha[a:b])
    move = np.zeros_like(model.move)
    turned = model.move.T.copy()
    for t in range(len(ends) - 1, 0, -1):
        a, b, p = begins[t], ends[t], begins[t - 1]
        back = emit[a:b] * beta[a:b] / scale[a:b]
        move += alpha[p : p + b - a].T @ back
        beta[p : p + b - a] = back @ turned
    share = alpha * beta
    found = np.stack([np.bincount(table, share[:, k], minlength=model.emit.shape[0]) for k in range(model.start.size)], axis=1)
    return share[: live[0]].sum(axis=0, dtype=np.float64), move * model.move, found


def _gathered(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[tuple[list[np.ndarray], pa.Table]]:
    """Class sequences of rows, together of about ``at_once`` tokens, and their rows."""
    held, rows, n = [], [], 0
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("classes")).to_pylist()
        a = 0
        for i, data in enumerate(column):
            held.append(np.frombuffer(data, "<u2"))
            n += held[-1].size
            if n >= at_once:
                yield held, pa.Table.from_batches([*rows, batch.slice(a, i + 1 - a)])
                held, rows, n, a = [], [], 0, i + 1
        rows.append(batch.slice(a))
    if held:
        yield held, pa.Table.from_batches(rows)


def _expected(model, segment: int, at_once: int):
    """Rows (k, s0, s1, ...): expected counts of class k by state; after the classes, the start, then the moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Hmm = model.value
        m = Hmm(*(x.astype(np.float32) for x in (m.start, m.move, m.emit)))
        size, states = m.emit.shape
        total = np.zeros((size + 1 + states, states))
        for held, _ in _gathered(batches, at_once):
            start, move, emit = expected_counts(m, [s[a:b] for s in held for a, b in slices(s.size, segment)])
            total[:size] += emit
            total[size] += start
            total[size + 1 :] += move
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, k]) for k in range(states))], ["k", *(f"s{k}" for k in range(states))])

    return run


def baum_welch(coded: DataFrame, frequency: np.ndarray, states: int = STATES, rounds: int = ROUNDS, segment: int = SEGMENT, at_once: int = AT_ONCE) -> Hmm:
    """Train on the column ``classes`` of all rows; ``frequency`` is the share of each class."""
    spark, model, size = coded.sparkSession, Hmm.first(frequency, states), frequency.size
    schema = "k long, " + ", ".join(f"s{k} double" for k in range(states))
    for _ in range(rounds):
        shipped = spark.sparkContext.broadcast(model)
        summed = coded.select("classes").mapInArrow(_expected(shipped, segment, at_once), schema).groupBy("k").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(states)))
        found = summed.toPandas()  # a row for each class and state
        total = np.zeros((size + 1 + states, states))
        total[found["k"].to_numpy()] = found.drop(columns="k").to_numpy()
        model = model.next(total[size], total[size + 1 :], total[:size], frequency)
    return model


def _scored(model, log_size, at_once: int):
    keep = [c for c in CODED_NAMES if c not in ("classes", "rest", "rest_n")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, rows in _gathered(batches, at_once):
            logs = forward(model.value, held) - [log_size.value[s].sum() for s in held]
            yield from rows.select(keep).append_column("log_hmm", pa.array(logs, pa.float64())).combine_chunks().to_batches()

    return run


def _head(counts: DataFrame, most: int) -> list:
    """The most frequent words, as many classes of like counts as hold at most ``most`` words; by falling count."""
    like = F.floor(4 * F.log2("c"))  # at most 256 classes
    sizes, n, least = counts.groupBy(like.alias("b")).agg(F.count("*").alias("n")).collect(), 0, None
    for r in sorted(sizes, key=lambda r: -r.b):
        n += r.n
        if n > most:
            break
        least = r.b
    found = counts.where(like >= least).collect() if least is not None else []
    return sorted(found, key=lambda r: (-r.c, bytes(r.word)))


def hmm_scores(
    docs: DataFrame, learn=None, head: int = HEAD, frequent: int = FREQUENT, buckets: int = BUCKETS, states: int = STATES, rounds: int = ROUNDS, at_once: int = AT_ONCE
) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of ``docs``.

    ``learn`` (a column) marks the rows that are learned from; by default all that are not held out.
    """
    if buckets & (buckets - 1) or frequent + buckets > 1 << 16 or head < frequent:
        raise ValueError("buckets must be a power of two, classes fit 16 bits, and head hold the frequent words")
    spark = docs.sparkSession
    held = held_out() if learn is None else ~learn
    rows = docs.select("doc_id", held.alias("held_out"), text_or_empty().alias("text"))
    counts = materialise(word_counts(rows.where("not held_out").select("text")), "hmm-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = _head(counts, head)
    vocabulary = Vocabulary.of([bytes(r.word) for r in top], [r.c for r in top], frequent, buckets)
    own = spark.createDataFrame([(bytes(r.word),) for r in top[:frequent]], "word binary")
    # What each bucket's words have together, and one for the unknown.
    held_words = counts.join(F.broadcast(own), "word", "left_anti").groupBy(F.pmod(F.xxhash64("word"), F.lit(buckets)).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("n"))
    size = np.ones(buckets)
    frequency = np.ones(vocabulary.size)
    frequency[: vocabulary.frequent] += [r.c for r in top[:frequent]]
    for r in held_words.collect():
        size[r.b] += r.c + r.n
        frequency[vocabulary.frequent + r.b] += r.c
    log_size = np.r_[np.zeros(vocabulary.frequent), np.log10(size)]
    coded = materialise(rows.mapInArrow(_coded(spark.sparkContext.broadcast(vocabulary)), CODED), "hmm-coded")
    model = baum_welch(coded.where("not held_out"), frequency / frequency.sum(), states, rounds, at_once=at_once)
    send = spark.sparkContext.broadcast
    scored = coded.mapInArrow(_scored(send(model), send(log_size), 2 * at_once), "row long, doc_id long, held_out boolean, n_tokens long, known long, log_known double, log_within double, log_hmm double")
    rest = coded.select("row", F.explode(F.arrays_zip(F.col("rest").alias("word"), F.col("rest_n").alias("n"))).alias("x")).select("row", "x.word", "x.n")
    met = rest.join(counts, "word").groupBy("row").agg(F.sum("n").alias("known_rest"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log_rest"))
    unit = float(np.log10(n + v + 1))
    zero = F.lit(0.0)
    return scored.join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("known_rest", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_known") + F.coalesce("log_rest", zero) - F.col("n_tokens") * unit).alias("base_score"),
        (F.col("log_hmm") + F.col("log_within") + F.coalesce("log_rest", zero)).alias("score"),
    )
