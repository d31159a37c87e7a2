"""Toxicity by a support vector machine over a gap-weighted subsequence kernel, with Nyström landmarks.

A sentence is compared with another by the subsequences of letters that their
words share, in order but not necessarily side by side; gaps cost a factor per
letter, so an insult with letters inserted or left out is still near itself.
Landmark words turn the kernel into a vector per sentence (Nyström's
approximation), on which a linear support vector machine is trained. Because the
kernel of sentences is a sum over their words, the machine's value of a word is
computed once and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retinue.llm.words import small_batches
from retinue.session import materialise

#: Labelled documents that sentences are taken from and the score is calibrated on, at most.
TRAINING_DOCS = 20_000
#: Sentences of each label that the machine is trained on, at most.
TRAINING_SENTENCES = 15_000
#: Landmarks that tell the labels apart, and landmarks among the frequent words.
TELLING, FREQUENT = 56, 8
#: Two telling landmarks are less similar than this.
ALIKE = 0.7
#: A telling landmark's share of sentences differs by label by this many standard deviations at least.
LEAST_TEST = 3.0
#: Telling words are looked for among this many of the highest test value.
CANDIDATES = 400
#: Letters of a shared subsequence, the letters it may span, and the factor for each letter spanned.
LENGTH, SPAN, DECAY = 3, 8, 0.7
#: Power of the normalised kernel of two words; letters shared by chance count for little.
POWER = 4
#: Words of one sentence; a longer one is cut.
SENTENCE = 64
#: Letters of one word; a longer one is as toxic as the worst of its overlapping windows.
WINDOW = 32
#: Subsequences of words looked up at once.
CELLS = 1 << 17
#: Words whose kernels are held at once.
WORDS = 1 << 15
#: Letters of texts after which a batch is gone on with in a new group.
LETTERS = 1 << 23
#: Words a worker remembers before it begins anew; results do not depend on it.
REMEMBERED = 700_000
#: Fits of the machine, each without the sentences of toxic documents that the one before found clean.
REFITS = 4
#: Regularisation of the machine.
RIDGE = 1.0

#: Letters written one by one, with or without signs between them, are one word.
_SPELLED = re.compile(r"(?<!\S)(?:\w[^\w\s]?\s+){2,}\w(?!\w)")
#: Found in the joined tokens of every text with such letters, and in few others; it is searched for from space to space.
_MAY_BE_SPELLED = re.compile(r" \w[^\w\s]?(?: \.)* \w[^\w\s]?(?: \.)* \w(?!\w)")
_SIGNS = re.compile(r"[\W_]+")


def tokens(text: str | None) -> list[str]:
    """Tokens of a text in lower case. A line end is a token of its own, ``.``."""
    text = (text or "").lower()
    found = text.replace("\n", " . ").split()
    if _MAY_BE_SPELLED.search(" " + " ".join(found)):
        text = _SPELLED.sub(lambda letters: _SIGNS.sub("", letters[0]), text)
        found = text.replace("\n", " . ").split()
    return found


def windows(token: str) -> list[str]:
    """The letters and digits of a token after a mark for its begin, cut into overlapping windows if it is long."""
    word = token if token.isalnum() else _SIGNS.sub("", token)
    if not word:
        return []
    word = "^" + word
    if len(word) <= WINDOW:
        return [word]
    return [word[at : at + WINDOW] for at in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def ends_sentence(token: str) -> bool:
    return token.rstrip("\"')]»”’")[-1:] in (".", "!", "?")


def sentence_starts(ends: np.ndarray) -> np.ndarray:
    """Where sentences begin, given for each token whether a sentence ends with it."""
    n = len(ends)
    starts = np.r_[0, np.flatnonzero(ends[:-1]) + 1] if n else np.empty(0, np.int64)
    pieces = -(-np.diff(np.r_[starts, n]) // SENTENCE)
    # A sentence of several pieces begins anew after every SENTENCE tokens.
    piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(starts, pieces) + SENTENCE * piece


@cache
def _triples(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of all subsequences of three letters of a word that span at most SPAN, and their weights."""
    found = [(i, j, k) for i in range(length) for j in range(i + 1, length) for k in range(j + 1, min(i + SPAN, length))]
    i, j, k = np.array(found, np.int64).reshape(len(found), 3).T
    return i, j, k, (DECAY ** (k - i + 1)).astype(np.float32)


@cache
def _norm(length: int) -> float:
    """Root of the kernel of a word with itself if none of its subsequences repeats; infinite if it has none."""
    weight = _triples(length)[3]
    return float(np.sqrt((weight * weight).sum())) if len(weight) else np.inf


@dataclass(frozen=True)
class Basis:
    """Landmarks, and the weight of each of their subsequences in each of them.

    A subsequence is numbered by the places of its letters in ``letters``;
    ``rows`` gives its row in the weights, the first of which is empty. A row
    has few landmarks: those ``columns`` and ``values`` from its place in
    ``begins`` up to that of the next row.
    """

    landmarks: list[str]
    letters: np.ndarray
    rows: np.ndarray
    begins: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(landmarks: list[str]) -> Basis:
        letters = np.unique(np.array([ord(c) for word in landmarks for c in word], np.int32))
        numbers, columns, values = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.float32)]
        base = len(letters) + 1
        for n, word in enumerate(landmarks):
            place = np.searchsorted(letters, np.array([ord(c) for c in word], np.int32)) + 1
            i, j, k, weight = _triples(len(word))
            numbers.append((place[i] * base + place[j]) * base + place[k])
            columns.append(np.full(len(i), n))
            values.append(weight / _norm(len(word)))
        used, row = np.unique(np.concatenate(numbers), return_inverse=True)
        weights = np.zeros((len(used) + 1, len(landmarks)), np.float32)
        np.add.at(weights, (row + 1, np.concatenate(columns)), np.concatenate(values))
        rows = np.zeros(base**3, np.int32)
        rows[used] = np.arange(1, len(used) + 1)
        filled, column = np.nonzero(weights)
        begins = np.searchsorted(filled, np.arange(len(weights) + 1))
        return Basis(landmarks, letters, rows, begins, column, weights[filled, column])

    def kernel(self, words: list[str]) -> np.ndarray:
        """Normalised gap-weighted kernel of ``words`` and all landmarks.

        The kernel sums over shared subsequences of three letters, each weighted
        by DECAY to the power of the letters spanned in both words, and is
        divided by the norms of words of these lengths.
        """
        found = np.zeros((len(words), len(self.landmarks)), np.float32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        base = len(self.letters) + 1
        number = np.int32 if base**3 < 1 << 31 else np.int64
        for length in np.unique(lengths):
            i, j, k, weight = _triples(int(length))
            if not len(i) or not len(self.letters):
                continue
            same = np.flatnonzero(lengths == length)
            step = max(1, CELLS // len(i))
            for at in range(0, len(same), step):
                part = same[at : at + step]
                text = "".join([words[n] for n in part])
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32).reshape(len(part), length)
                place = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
                place = np.where(self.letters[place] == codes, place + 1, 0).T.astype(number, order="C")
                # One row for every triple of places, so that letters are copied and numbered side by side.
                row = self.rows[(place[i] * base + place[j]) * base + place[k]].ravel()
                at_row = np.flatnonzero(row)
                row = row[at_row]
                triple, word = np.divmod(at_row, len(part))
                begin = self.begins[row]
                size = self.begins[row + 1] - begin
                entry = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
                cell = np.repeat(word * len(self.landmarks), size) + self.columns[entry]
                shared = np.repeat(weight[triple] / _norm(int(length)), size) * self.values[entry]
                sums = np.bincount(cell, shared, len(part) * len(self.landmarks))
                found[part] = sums.reshape(len(part), len(self.landmarks))
        return found

    def similarities(self, words: list[str]) -> np.ndarray:
        """Powers of the normalised kernel; a word too short for any subsequence is near nothing."""
        return self.kernel(words) ** POWER


def telling_words(ones: dict[str, int], zeros: dict[str, int], n_ones: int, n_zeros: int) -> list[str]:
    """Landmarks: words whose share of sentences differs most by label, no two nearly alike, and frequent words."""
    words = [w for w in sorted(ones.keys() | zeros.keys()) if len(w) > LENGTH]
    if not words:
        return []
    a = np.array([ones.get(w, 0) for w in words], float)
    b = np.array([zeros.get(w, 0) for w in words], float)
    share = (a + b + 1) / (n_ones + n_zeros + 2)
    test = (a / max(n_ones, 1) - b / max(n_zeros, 1)) / np.sqrt(share * (1 - share) * (1 / max(n_ones, 1) + 1 / max(n_zeros, 1)))
    candidates = [words[n] for n in np.argsort(-test, kind="stable")[:CANDIDATES] if test[n] >= LEAST_TEST]
    near = Basis.of(candidates).similarities(candidates)
    chosen: list[int] = []
    for n in range(len(candidates)):
        if len(chosen) < TELLING and (not chosen or near[n, chosen].max() < ALIKE):
            chosen.append(n)
    frequent = [words[n] for n in np.argsort(-(a + b), kind="stable")]
    landmarks = [candidates[n] for n in chosen]
    return landmarks + [w for w in frequent if w not in landmarks][:FREQUENT]


def fit_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss by Newton steps; returns direction and offset."""
    full = np.c_[x, np.ones(len(x))]
    penalty = np.full(full.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(full.shape[1])
    active = np.ones(len(x), bool)
    for _ in range(rounds):
        rows = full[active] * weight[active, None]
        w = np.linalg.solve(rows.T @ full[active] + np.diag(penalty), rows.T @ y[active])
        inside = y * (full @ w) < 1
        if (inside == active).all():
            break
        active = inside
    return w[:-1], float(w[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps on columns of unit spread; returns direction and offset."""
    spread = np.maximum(x.std(axis=0), 1e-9)
    full = np.c_[x / spread, np.ones(len(x))]
    penalty = np.full(full.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(full.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        slope = full.T @ (p - y) + penalty * w
        curve = (full * (p * (1 - p) + 1e-9)[:, None]).T @ full + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1] / spread, float(w[-1])


@dataclass(frozen=True)
class Machine:
    """Landmarks with their coefficients: the value of a sentence is ``offset`` plus those of its words."""

    basis: Basis
    coefficients: np.ndarray
    offset: float

    def values(self, words: list[str]) -> np.ndarray:
        parts = [words[at : at + WORDS] for at in range(0, len(words), WORDS)]
        return np.concatenate([np.empty(0), *(self.basis.similarities(part) @ self.coefficients for part in parts)])

    def same(self, other: Machine) -> bool:
        alike = self.basis.landmarks == other.basis.landmarks and self.offset == other.offset
        return alike and np.array_equal(self.coefficients, other.coefficients)


#: What the calibration sees of a document: the share of its sentences with a word that makes them toxic by
#: itself, how many such words there are, how many different ones, and their share of all words.
EVIDENCE = ("toxic_sentences", "toxic_words", "different", "share")


@dataclass(frozen=True)
class Model:
    machine: Machine
    direction: np.ndarray
    offset: float

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(evidence @ self.direction + self.offset, -40, 40)))


class _Numbers(dict):
    """token -> its number, in the order in which tokens are first asked for."""

    def __missing__(self, token: str) -> int:
        number = self[token] = len(self)
        return number

    def of(self, tokens: Iterable[str], n: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int64, n)


class _Values:
    """Per token whether the machine finds it toxic by itself, and whether a sentence ends with it, once learned."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.forget()

    def forget(self) -> None:
        self.numbers, self.letters = _Numbers(), 0
        self.toxic, self.ends = np.empty(0, bool), np.empty(0, bool)

    def learn(self, tokens: list[str]) -> np.ndarray:
        """Numbers of different tokens; what is to be known of new ones is found. What is remembered stays bounded in number and letters."""
        known = len(self.ends)
        # More numbers than known tokens are left by a task that was stopped between the two.
        if known >= REMEMBERED or self.letters >= 16 * REMEMBERED or known != len(self.numbers):
            self.forget()
            known = 0
        numbers = self.numbers.of(tokens, len(tokens))
        new = [tokens[n] for n in np.flatnonzero(numbers >= known)]
        if new:
            parts = [windows(token) for token in new]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            found = self.machine.values(list(chain.from_iterable(parts)))
            values = np.zeros(len(new))
            if len(found):
                values[sizes > 0] = np.maximum.reduceat(found, (np.cumsum(sizes) - sizes)[sizes > 0])
            self.letters += sum(map(len, new))
            self.toxic = np.r_[self.toxic, values + self.machine.offset > 0]
            self.ends = np.r_[self.ends, [ends_sentence(token) for token in new]]
        return numbers

    def evidence(self, texts: list[list[str]]) -> np.ndarray:
        """One row for each text, with a column for each of EVIDENCE; of a text without tokens, zeros."""
        found = np.zeros((len(texts), len(EVIDENCE)))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        # A text's tokens are first numbered among those of these texts, which are few enough to be at hand.
        here = _Numbers()
        tokens = here.of(chain.from_iterable(texts), int(sizes.sum()))
        numbers = self.learn(list(here))
        filled, sizes = np.flatnonzero(sizes), sizes[sizes > 0]
        if not len(filled):
            return found
        text = np.repeat(np.arange(len(filled)), sizes)
        ends = self.ends[numbers][tokens]
        ends[np.cumsum(sizes) - 1] = True
        toxic = self.toxic[numbers][tokens]
        starts = sentence_starts(ends)
        sentences = np.add.reduceat(toxic, starts, dtype=np.int64) > 0

        def count(of: np.ndarray) -> np.ndarray:
            return np.bincount(of, minlength=len(filled))

        words = count(text[toxic])
        different = np.unique(text[toxic] * len(here) + tokens[toxic]) // len(here)
        found[filled, 0] = count(text[starts[sentences]]) / count(text[starts])
        found[filled, 1], found[filled, 2] = np.log1p(words), np.log1p(count(different))
        found[filled, 3] = words / (sizes + 20)
        return found


#: Values that this worker has learned, of the machine it used last.
_LEARNED: list[_Values] = []


def _values_of(machine: Machine) -> _Values:
    """What the worker knows of this machine from its earlier tasks."""
    if not (_LEARNED and _LEARNED[0].machine.same(machine)):
        _LEARNED[:] = [_Values(machine)]
    return _LEARNED[0]


def _evidence(batch: pa.RecordBatch, known: _Values) -> np.ndarray:
    found, texts, letters = [], [], 0
    for text in batch.column("text").to_pylist():
        texts.append(tokens(text))
        letters += len(text or "")
        if letters >= LETTERS:
            found.append(known.evidence(texts))
            texts, letters = [], 0
    return np.concatenate([*found, known.evidence(texts)])


def labelled(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_DOCS) -> DataFrame:
    """``<doc_id, text, toxic>`` of at most ``rows`` labelled documents besides the held-out ones.

    They are spread over all labelled documents by a hash of ``doc_id``.
    """
    usable = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")


def held_out(doc_id: Column) -> Column:
    """Whether the label of a document must not be learned."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def _sentences(batches):
    """Sentences with a word, as the windows of their words joined by spaces."""
    for batch in batches:
        labels, found = [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            parts = tokens(text)
            starts = sentence_starts(np.array([ends_sentence(token) for token in parts], bool)).tolist()
            for start, end in zip(starts, [*starts[1:], len(parts)]):
                words = [word for token in parts[start:end] for word in windows(token)]
                # A long token has many windows; a row of the sample stays short.
                for at in range(0, len(words), SENTENCE):
                    labels.append(label)
                    found.append(" ".join(words[at : at + SENTENCE]))
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(found, pa.string())], ["toxic", "words"])


def fit(ones: list[list[str]], zeros: list[list[str]]) -> Machine:
    """The machine that tells sentences of the two labels apart; each label weighs the same."""
    counts: list[dict[str, int]] = [{}, {}]
    for own, group in zip(counts, (ones, zeros)):
        for words in group:
            for word in set(words):
                own[word] = own.get(word, 0) + 1
    landmarks = telling_words(*counts, len(ones), len(zeros)) if ones and zeros else []
    if not landmarks:
        return Machine(Basis.of([]), np.empty(0), 0.0)
    basis = Basis.of(landmarks)
    # Nystroem: the square root of the landmarks' inverse kernel makes dot products of the vectors approximate the kernel.
    size, turn = np.linalg.eigh(basis.similarities(landmarks).astype(np.float64))
    keep = size > 1e-5 * size.max()
    whiten = turn[:, keep] / np.sqrt(size[keep])
    distinct = sorted(counts[0].keys() | counts[1].keys())
    number = {word: n for n, word in enumerate(distinct)}
    vectors = basis.similarities(distinct)
    x = np.stack([vectors[[number[word] for word in words]].sum(axis=0, dtype=np.float64) for words in (*ones, *zeros)]) @ whiten
    y = np.r_[np.ones(len(ones)), -np.ones(len(zeros))]
    # Labels are those of documents. Sentences of toxic ones that look clean are left out of the next fit.
    used = np.ones(len(y), bool)
    for _ in range(REFITS):
        n_ones = int((used & (y > 0)).sum())
        weight = np.where(y > 0, len(y) / (2 * n_ones), len(y) / (2 * len(zeros)))
        direction, offset = fit_machine(x[used], y[used], weight[used])
        toxic = (y > 0) & (x @ direction + offset > 0)
        if not toxic.any():
            break
        used = (y < 0) | toxic
    return Machine(basis, whiten @ direction, offset)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_DOCS, sentences: int = TRAINING_SENTENCES) -> Model:
    """Machine and calibration from ``labels`` ``<doc_id, toxic>`` of documents that are not held out.

    Half of the sampled documents give the sentences of the machine, the other
    half calibrates the score. Without documents of both labels every score is
    the smoothed share of label 1.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample = materialise(labelled(docs, labels, rows), "toxic-sample")
    fits = F.xxhash64("doc_id", F.lit("half")) % 2 == 0
    cut = sample.filter(fits).select("text", "toxic").mapInArrow(_sentences, "toxic int, words string")
    cut = materialise(cut.distinct(), "toxic-sentences")
    groups = []
    for label in (1, 0):
        drawn = cut.filter(F.col("toxic") == label).orderBy(F.xxhash64("words"), "words").limit(sentences)
        groups.append([row["words"].split() for row in drawn.select("words").collect()])
    machine = fit(*groups)

    def measure(batches):
        known = _values_of(machine)
        for batch in batches:
            found = _evidence(batch, known)
            columns = [batch.column("toxic"), *(pa.array(np.ascontiguousarray(c)) for c in found.T)]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", *EVIDENCE])

    schema = "toxic int, " + ", ".join(f"{name} double" for name in EVIDENCE)
    measured = sample.filter(~fits).select("text", "toxic").mapInArrow(measure, schema)
    # Rows that repeat a doc_id could exceed the bound, so it is kept here too.
    found = measured.orderBy(*EVIDENCE, "toxic").limit(rows).toPandas()
    x, y = found[list(EVIDENCE)].to_numpy(np.float64), found["toxic"].to_numpy(np.float64)
    if len(set(y)) < 2:
        return Model(machine, np.zeros(len(EVIDENCE)), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    return Model(machine, *fit_logistic(x, y))


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``<doc_id, held_out, score, predicted>``, one row for every row of ``docs``; only ``doc_id`` and ``text`` are read.

    ``score`` is the probability of label 1, ``predicted`` 1 from ``threshold`` on.

    * Null and empty texts have no sentence and get the score of that evidence.
    * A null ``doc_id`` is held out of nothing: ``held_out`` is false. Repeated rows are rows like others.
    * An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def score(batches):
        known = _values_of(model.machine)
        for batch in batches:
            found = model.scores(_evidence(batch, known))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return found.select("doc_id", out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
