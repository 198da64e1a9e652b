"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

The kernel of two words counts the gapped triples of characters that they
share, each weighted by a decay to the power of its span, so insults with
inserted or left-out characters stay close to their plain form. A word with
marks inside is also read in its parts and without its marks, one with a filler
between all letters without it, a run of letters without spaces by its pairs and
triples where the script has none, and a long word by the insults that stand in
it: windows as wide as the landmark that they are compared with, and letters in
order with few others between them. Words are
described by their kernel with landmark words through a Nystroem map, and a
sentence is as toxic as its worst word. A linear SVM is trained on labelled
text: a clean one says that all its words are clean, a toxic one that its
worst word is toxic. A document scores by its two worst words, through a
logistic fitted on the training documents.

The model is fitted on a bounded sample of labelled rows (``sample_docs`` of
each class, none over ``sample_chars``); every document is scored whole.

Defined cases: a null or empty text has no words and scores as a text
without any match; a null doc_id counts as the empty text for the fold; rows
without a label are not learned from; without labels of both classes every
score is the share of toxic labels (0 without labels); repeated rows get equal
scores; an empty table gives an empty result; ``doc_id`` and ``text`` alone
are read, and ``keep_rows`` carries every other column.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices, text_or_empty

FOLDS, HELD_OUT_FOLD = 5, 0
#: Labelled rows of each class that the model is fitted on, at most, and code points of such a row.
SAMPLE_DOCS, SAMPLE_CHARS = 1_500, 20_000
LANDMARKS, CLEAN_LANDMARKS = 96, 24
#: Span of a gapped triple, decay for each character of its span, least kernel that counts, and its power.
SPAN, DECAY, FLOOR, POWER = 6, 0.8, 0.4, 2
#: Longer words are read in windows of so many characters, half overlapping.
WORD_CHARS = 32
#: Words from so many characters are searched for landmarks of at least so many.
LONG_WORD, INNER_LANDMARK = 9, 4
#: Characters that may be put into a landmark, between its first and last letter.
PUT_IN = 3
#: Scripts without spaces between words.
UNSPACED = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]{2,}")
CACHED_WORDS = 400_000
#: Cost of a spoiled insult that the SVM misses; a document's worst sentence costs 10.
SPOILED_COST = 5.0
#: Toxic documents of a word times the logarithm of its odds, at least, for a toxic landmark.
LEAST_GAIN = 6.0
#: Times that a toxic landmark is likelier in a toxic document than in a clean one, at least.
LEAST_ODDS = 4.0
#: Four or more single characters in a row are read as one word as well.
SPELLED = re.compile(r"(?<!\S)(?:\S[ \t]){3,}\S(?!\S)")
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
PATTERNS = [(a, b) for a, b in combinations(range(1, SPAN), 2)]


def words_of(text: str) -> list[str]:
    words = text.lower().split()
    if list(map(len, words)).count(1) > 3:
        words += [re.sub(r"\s", "", m.group().lower()) for m in SPELLED.finditer(text)]
    return words


@dataclass
class Insults:
    """The toxic landmarks as they may stand in longer words, whole or with characters put in."""

    words: list[str]
    ends: dict[str, list[str]] = field(init=False, default_factory=dict)
    _finder: ahocorasick.Automaton | None = field(init=False, default=None, repr=False)

    def __post_init__(self):
        self.words = [w for w in self.words if len(w) >= INNER_LANDMARK]
        for w in self.words:
            self.ends.setdefault(w[0] + w[-1], []).append(w)

    def __getstate__(self):
        return {**self.__dict__, "_finder": None}

    def of(self, word: str) -> list[str]:
        found = sorted(self._within(word)) if len(word) >= LONG_WORD else []
        for w in self.ends.get(word[:1] + word[-1:], ()):
            if 0 < len(word) - len(w) <= PUT_IN:
                rest = iter(word)
                if all(c in rest for c in w):
                    found.append(w)
        return found

    def _within(self, word: str) -> set[str]:
        if not self.words:
            return set()
        if self._finder is None:
            self._finder = ahocorasick.Automaton()
            for w in self.words:
                self._finder.add_word(w, w)
            self._finder.make_automaton()
        return {w for _, w in self._finder.iter(word)}

    def plain(self, word: str) -> bool:
        """Whether a word without marks, of ASCII, can have no reading but itself."""
        n = len(word)
        return n < LONG_WORD and word[0] + word[-1] not in self.ends and (n < 7 or word[1] != word[3])


def readings(word: str, insults: Insults | None = None) -> list[str]:
    """The ways to read a word, itself first; of ``insults`` those that stand in it."""
    word = word.strip(EDGE) or word
    if insults is not None and word.isascii() and word.isalnum() and insults.plain(word):
        return [word]
    found = [word]
    if not word.isalnum():
        parts = [x for x in re.split(r"[\W_]+", word) if x]
        if len(parts) > 1:
            found += [*dict.fromkeys(x for x in parts if len(x) > 1), "".join(parts)]
    long = found[-1]
    if len(long) >= 7 and len(set(long[1::2])) == 1 and len(set(long[::2])) > 2:
        found.append(long[::2])
    if insults is not None:
        found += [x for y in {word, long} for x in insults.of(y)]
    if not word.isascii():
        for run in UNSPACED.findall(word):
            found += sorted({run[i : i + n] for n in (2, 3) for i in range(len(run) - n + 1)})
    return found


def _triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, code, weight) of the gapped triples of words, edges marked."""
    marked = ["\x02" + w + "\x03" for w in words]
    width = max(len(w) for w in marked)
    chars = np.frombuffer("".join(w.ljust(width, "\0") for w in marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), width).astype(np.uint64)
    rows, codes, weights = [], [], []
    for a, b in PATTERNS:
        if width <= b:
            continue
        x, y, z = chars[:, : width - b], chars[:, a : width - b + a], chars[:, b:]
        row, at = np.nonzero(z)
        codes.append((x[row, at] << np.uint64(42)) | (y[row, at] << np.uint64(21)) | z[row, at])
        rows.append(row)
        weights.append(np.full(row.size, DECAY ** (b + 1)))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0)
    row, code, weight = np.concatenate(rows), np.concatenate(codes), np.concatenate(weights)
    order = np.lexsort((code, row))
    row, code, weight = row[order], code[order], weight[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])])
    return row[first], code[first], np.add.reduceat(weight, first)


@dataclass
class Kernel:
    """Normalised kernel of words with the landmark words."""

    landmarks: list[str]
    inner: Insults = field(default_factory=lambda: Insults([]))
    codes: np.ndarray = field(init=False)
    table: np.ndarray = field(init=False)
    letters: np.ndarray = field(init=False)
    place: np.ndarray = field(init=False)
    most: np.ndarray = field(init=False)
    size: int = field(init=False)

    def __post_init__(self):
        row, code, weight = _triples(self.landmarks)
        norm = np.sqrt(np.bincount(row, weight**2, minlength=len(self.landmarks)))
        self.codes = np.unique(code)
        self.table = np.zeros((self.codes.size, len(self.landmarks)), dtype=np.float32)
        self.table[np.searchsorted(self.codes, code), row] = weight / norm[row]
        # Place of a triple in the table, by the letters of the landmarks; none: the empty last row.
        used = sorted({ord(c) for w in self.landmarks for c in w} | {2, 3})
        self.letters = np.zeros(max(used) + 2, dtype=np.int32)
        self.letters[used] = np.arange(1, len(used) + 1)
        n = self.size = len(used) + 1
        x, y, z = (self.letters[(self.codes >> np.uint64(k)).astype(np.int64) & 0x1FFFFF] for k in (42, 21, 0))
        self.place = np.full(n**3, self.codes.size, dtype=np.int32)
        self.place[(x * n + y) * n + z] = np.arange(self.codes.size)
        self.table = np.r_[self.table, np.zeros((1, len(self.landmarks)), dtype=np.float32)]
        self.most = self.table.max(axis=1)

    def _near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words whose kernel with a landmark may reach ``FLOOR``, and their products before division by the norm.

        A triple that a word has twice only makes its norm greater, so the
        norm of the triples taken apart gives a bound.
        """
        marked = ["\x02" + w + "\x03" for w in words]
        width, n = max(len(w) for w in marked), self.size
        chars = np.frombuffer("".join([w.ljust(width, "\0") for w in marked]).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), width)
        at = self.letters[np.minimum(chars, self.letters.size - 1)].T.copy()
        sizes = np.array([len(w) for w in marked])
        total, norm, places = np.zeros(len(words), dtype=np.float32), np.zeros(len(words)), []
        for a, b in PATTERNS:
            if width <= b:
                continue
            weight = DECAY ** (b + 1)
            places.append((weight, self.place[(at[: width - b] * n + at[a : width - b + a]) * n + at[b:]]))
            total += weight * self.most[places[-1][1]].sum(axis=0)
            norm += weight**2 * np.maximum(sizes - b, 0)
        norm = np.sqrt(np.maximum(norm, 1e-9))
        near = np.flatnonzero(total >= FLOOR * norm)
        found = np.zeros((near.size, len(self.landmarks)), dtype=np.float32)
        for weight, place in places:
            for row in place[:, near]:
                hit = np.flatnonzero(row < self.codes.size)
                found[hit] += weight * self.table[row[hit]]
        keep = found.max(axis=1, initial=0) >= FLOOR * norm[near]
        return near[keep], found[keep]

    def _short(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of words of bounded length, those that match a landmark, and their kernels."""
        near, found = self._near(words)
        if near.size:
            row, _, weight = _triples([words[i] for i in near])
            found /= np.sqrt(np.bincount(row, weight**2, minlength=near.size))[:, None]
        keep = found.max(axis=1, initial=0) >= FLOOR
        return near[keep], found[keep]

    def matches(self, words: list[str]) -> dict[int, np.ndarray]:
        """By word's place, its matches to the landmarks, to the power ``POWER``; a kernel under ``FLOOR`` counts as none."""
        pieces, owner = [], []
        for i, word in enumerate(words):
            word = word.strip(EDGE) or word
            for a in range(0, max(1, len(word) - WORD_CHARS // 2), WORD_CHARS // 2):
                pieces.append(word[a : a + WORD_CHARS])
                owner.append(i)
        out: dict[int, np.ndarray] = {}
        for a, b in slices(len(pieces), 4096):
            for r, kernel in zip(*self._short(pieces[a:b])):
                match, i = np.where(kernel >= FLOOR, kernel, 0) ** POWER, owner[a + r]
                out[i] = np.maximum(out[i], match) if i in out else match
        return out

    def gram(self) -> np.ndarray:
        found = self.matches(self.landmarks)
        return np.array([found[i] for i in range(len(self.landmarks))], dtype=np.float64)


@dataclass
class Model:
    kernel: Kernel | None
    weights: np.ndarray  # of a word's matches; Nystroem map and SVM in one
    bias: float
    logit: np.ndarray  # of the worst and second worst word, and a constant

    def probability(self, worst: tuple[float, float]) -> float:
        if self.kernel is None:
            return float(self.logit[2])
        return float(1 / (1 + np.exp(-np.clip(self.logit @ (*worst, 1.0), -30, 30))))


class Scorer:
    """Scores texts; remembers the margins of words that match a landmark, and which match none."""

    def __init__(self, model: Model):
        self.model, self.seen, self.margins = model, {}, {}

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.seen]
        if len(self.seen) + len(fresh) > CACHED_WORDS:
            self.seen.clear()
            self.margins.clear()
            fresh = words
        insults, margins = self.model.kernel.inner, self.margins
        read = {w: readings(w, insults) for w in fresh}
        new = sorted({x for found in read.values() for x in found if x not in margins}, key=len)
        for a, b in slices(len(new), 8192):
            margins.update(dict.fromkeys(new[a:b]))
            for i, match in self.model.kernel.matches(new[a:b]).items():
                margins[new[a + i]] = float(match @ self.model.weights)
        for w, found in read.items():
            self.seen[w] = margins[found[0]] if len(found) == 1 else max((m for x in found if (m := margins[x]) is not None), default=None)

    def worst(self, texts: list[str]) -> list[tuple[float, float]]:
        """Of each text the margins of its worst and second worst word."""
        seen, bias, out = self.seen, self.model.bias, []
        if self.model.kernel is None:
            return [(0.0, 0.0)] * len(texts)
        self.learn(set().union(*(t.lower().split() for t in texts)))
        for words in map(words_of, texts):
            try:
                hits = [x for w in words if (x := seen[w]) is not None]
            except KeyError:  # a word spelled apart, or forgotten since
                self.learn(set(words))
                hits = [x for w in words if (x := seen[w]) is not None]
            hits = sorted(hits)[-2:]
            hits = [max(x, 0.0) for x in [0.0, 0.0, *hits][-2:]]
            out.append((hits[1] + bias, hits[0] + bias))
        return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Primal L2 squared-hinge SVM by Newton steps; the last column of x is the bias."""
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa, ca = x[active], cost[active]
        new = np.linalg.solve(ridge + (xa * ca[:, None]).T @ xa, xa.T @ (ca * y[active]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = 0.5 * w + 0.5 * new if _ > 10 else new
    return w


def choose_landmarks(texts: list[str], labels: list[int], n: int, n_clean: int) -> tuple[list[str], list[str], list[float]]:
    """Words whose documents speak most for toxic, unlike each other; frequent clean words; the logarithms of the first ones' odds."""
    toxic, clean = Counter(), Counter()
    for text, label in zip(texts, labels):
        (toxic if label else clean).update({x[:WORD_CHARS] for w in words_of(text) for x in readings(w)} - {""})
    n_toxic, n_other = max(1, sum(labels)), max(1, len(labels) - sum(labels))

    def odds(w: str) -> float:
        return (toxic[w] + 0.5) / (n_toxic + 1) * (n_other + 1) / (clean[w] + 0.5)

    def gain(w: str) -> float:
        return toxic[w] * np.log(odds(w)) if odds(w) >= LEAST_ODDS else 0.0

    ranked = sorted((w for w, a in toxic.items() if a >= 2 and (len(w) >= 3 or UNSPACED.fullmatch(w))), key=lambda w: (-gain(w), w))[: 12 * n]
    picked: list[str] = []
    like = np.zeros(0)
    if ranked:
        row, code, weight = _triples(ranked)
        norm = np.sqrt(np.bincount(row, weight**2, minlength=len(ranked)))
        vectors = {}
        for r, c, v in zip(row.tolist(), code.tolist(), (weight / norm[row]).tolist()):
            vectors.setdefault(r, {})[c] = v
        for i, word in enumerate(ranked):
            if gain(word) <= LEAST_GAIN:
                break
            mine = vectors.get(i, {})
            like = [sum(v * o.get(c, 0) for c, v in mine.items()) for o in (vectors[j] for j in picked)]
            if max(like, default=0) < 0.8:
                picked.append(i)
            if len(picked) == n:
                break
    plain = [w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0])) if len(w) >= 3 and toxic[w] * n_other < 2 * clean[w] * n_toxic]
    return [ranked[i] for i in picked], plain[:n_clean], [np.log(odds(ranked[i])) for i in picked]


def fit(texts: list[str], labels: list[int], landmarks: int = LANDMARKS, clean_landmarks: int = CLEAN_LANDMARKS, rounds: int = 5) -> Model:
    """The model from labelled texts, in a defined order."""
    share = float(np.mean(labels)) if labels else 0.0
    insults, plain, odds = choose_landmarks(texts, labels, landmarks, clean_landmarks) if 0 < share < 1 else ([], [], [])
    if not insults:
        return Model(None, np.zeros(0), 0.0, np.array([0.0, 0.0, share]))
    # Those that stand in longer words of clean texts are parts of words, not insults put into them.
    inner = Insults(insults)
    fair = {x for text, y in zip(texts, labels) if not y for w in set(words_of(text)) for x in readings(w, inner)[1:]}
    kernel, label = Kernel(insults + plain, Insults([w for w in insults if w not in fair])), np.asarray(labels)
    read: dict[str, list[str]] = {}
    spoken = [set(words_of(text)) for text in texts]
    for words in spoken:
        read.update((w, readings(w, kernel.inner)) for w in words if w not in read)
    vocabulary = sorted({x for found in read.values() for x in found})
    found = kernel.matches(vocabulary)
    place = {vocabulary[i]: k for k, i in enumerate(found)}
    x = np.array(list(found.values()), dtype=np.float64)
    # Nystroem: matches times the inverse root of the landmarks' kernel.
    gram = kernel.gram()
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = (vector / np.sqrt(np.maximum(value, 0.05))) @ vector.T
    z = np.c_[x @ root, np.ones(len(x))]
    # The toxic landmarks with one character put in count as insults too.
    changed = [w[:k] + c + w[k:] for w in insults for k, c in ((len(w) // 2, "x"), (len(w) // 2, "-"), (2, "."), (len(w) - 1, "*"))]
    spoiled = kernel.matches(changed)
    extra = np.array([spoiled[i] for i in sorted(spoiled)]) @ root
    extra = np.c_[extra, np.ones(len(extra))]
    docs = [sorted({place[x] for w in words for x in read[w] if x in place}) for words in spoken]
    clean = np.unique([k for rows, y in zip(docs, label) if y == 0 for k in rows]).astype(np.int64)
    margin = (x[:, : len(insults)] * odds).max(axis=1)
    nothing = np.r_[np.zeros(len(root)), 1.0]
    for _ in range(rounds):
        # A clean document's words are all clean; a toxic one's worst word is toxic.
        worst = [max(rows, key=margin.__getitem__) for rows, y in zip(docs, label) if y == 1 and rows]
        bad, times = np.unique(np.array(worst, dtype=np.int64), return_counts=True)
        w = _svm(
            np.r_[z[bad], extra, z[clean], [nothing]],
            np.r_[np.ones(len(bad) + len(extra)), -np.ones(len(clean) + 1)],
            np.r_[10.0 * np.sqrt(times), np.full(len(extra), SPOILED_COST), np.full(len(clean) + 1, 10.0)],
        )
        margin = z @ w
    model = Model(kernel, root @ w[:-1], float(w[-1]), np.zeros(3))
    scorer = Scorer(model)
    model.logit = _logistic(np.array(scorer.worst(texts)), label)
    return model


def _logistic(margins: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights of the toxic probability, with a mild pull to a plain reading of the margins."""
    prior = np.array([3.0, 1.0, 0.0])
    x, w, pull = np.c_[margins, np.ones(len(margins))], prior.copy(), np.diag([0.05, 0.05, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(pull + (x * (p * (1 - p) + 1e-9)[:, None]).T @ x, x.T @ (label - p) - pull @ (w - prior))
        w = w + np.clip(step, -2, 2)
    return w


def held_out():
    return (F.crc32(id_text().cast("binary")) % FOLDS) == HELD_OUT_FOLD


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Two to four times the sample, picked by a hash, for rows without a text
    # here or with a longer one; bounded, so it may be broadcast.
    sizes = {r.toxic: r.n for r in known.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    picked = []
    for label in (True, False):
        share = max(1, sizes.get(label, 0) // (2 * sample_docs))
        picked.append(known.where(((F.col("toxic") == 1) == F.lit(label)) & (F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)))
    text = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= sample_chars))
    rows = [text.join(F.broadcast(p), "doc_id").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect() for p in picked]
    return fit([r.text for part in rows for r in part], [int(r.toxic == 1) for part in rows for r in part])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, margin, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in batches:
            for a, b in slices(batch.num_rows, 500):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                worst = scorer.worst(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([m for m, _ in worst], pa.float64()), pa.array(map(scorer.model.probability, worst), pa.float64())],
                    ["doc_id", "margin", "score"],
                )

    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, margin double, score double")


def keep_rows(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``."""
    model = train(docs, labels)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in batches:
            for a, b in slices(batch.num_rows, 500):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                passed = [scorer.model.probability(m) < threshold for m in scorer.worst(texts)]
                yield part.filter(pa.array(passed, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
