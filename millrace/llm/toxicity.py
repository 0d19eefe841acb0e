"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

Units are words (runs of letters and digits in lower case), pairs of neighbouring words of a sentence, tokens with
their inner punctuation taken out ("i.d-i_o*t") and runs of single characters drawn together ("i d i o t"). Two units are
compared by the gapped subsequence kernel of order 3: common subsequences of three characters (word border
included) count with ``DECAY`` to the power of the characters they span, so inserted and left-out characters only
weaken a match. Each unit is normalised by the norm that its length gives it when no subsequence comes twice.

Fitting (driver, bounded labelled sample): documents are read as sentences. Sentences of clean documents are clean;
of a toxic document, the sentences that stand out are toxic and the others are left open, to be judged again
between rounds (multiple-instance learning). The units that stand out in toxic sentences are positive examples,
units of clean ones negative. Landmarks are picked among both; Nyström features are the kernel values against
them, whitened by their own kernel matrix, and a linear SVM is trained on them by stochastic subgradient steps. A
logistic curve turns a text's largest margins into its score.

Scoring: a margin is a weighted sum of kernel values against fixed landmarks, hence linear in the subsequence
counts of a unit. The weights are folded into one table over character triples; running sums over the characters
of a chunk of texts then give the margin of every unit, without a loop over units or landmarks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import tokens
from millrace.llm.common import arrow_map, table
from millrace.llm.features import held_out, lowered, sample_per_class

DECAY = 0.6
#: Characters that a counted subsequence may span at most.
SPAN = 6
#: Units longer than this are read in overlapping windows of this length.
LONGEST = 24
#: Bounds of the training sample: documents of each label; of them, units of each kind (the positive ones, the most
#: frequent words, drawn pairs, and twice as many drawn words and hard ones) and landmarks of each kind.
PER_LABEL = 800
UNITS = 1500
LANDMARKS = 96
#: Margins below are raised to this; so many of a text's largest margins are averaged.
FLOOR = -1.0
TOP = 4
THRESHOLD = 0.3
#: Weight of a sentence beside a document when the score's curve is fitted.
SENTENCE = 0.1

# Character codes: 1 word border, letters, digits, and the low bits of bytes of longer characters; their lead bytes have none.
_CODES = 2 + 26 + 10 + 64
_CODE = np.ones(256, np.int16)
_CODE[97:123] = np.arange(2, 28)
_CODE[48:58] = np.arange(28, 38)
_CODE[128:192] = 38 + np.arange(64)
_CODE[192:] = -1
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_IS_STOP = np.zeros(256, bool)
_IS_STOP[[33, 46, 63]] = True
_STEPS = [(d1, d2) for d2 in range(2, SPAN) for d1 in range(1, d2)]
_NORMS = np.sqrt(np.maximum([sum((d2 - 1) * max(0, n - d2) * DECAY ** (2 * (d2 + 1)) for d2 in range(2, SPAN)) for n in range(3 * LONGEST)], 1e-6))
WORD, PAIR = 0, 1


@dataclass
class Units:
    """Units of a chunk of texts as stretches first..last of a string of codes, borders included."""

    codes: np.ndarray
    first: np.ndarray
    last: np.ndarray
    text: np.ndarray
    sentence: np.ndarray
    kind: np.ndarray
    words: np.ndarray  # words of each text


def _windows(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches, the longer ones cut into overlapping windows: first, last, number of the stretch."""
    size, step = last - first + 1, LONGEST // 2
    count = np.where(size > LONGEST + 2, -(-(size - LONGEST) // step) + 1, 1)
    own = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    cut = count[own] > 1
    begin = np.where(cut, np.minimum(first[own] + nth * step, last[own] - LONGEST + 1), first[own])
    return begin, np.where(cut, begin + LONGEST - 1, last[own]), own


def _runs(same: np.ndarray, n: int) -> np.ndarray:
    """Number of the run that each of ``n`` things is in; ``same`` tells whether one goes on from the one before."""
    return np.concatenate((np.zeros(min(n, 1), np.int64), np.cumsum(~same)))


def read(data: np.ndarray, offsets: np.ndarray) -> Units:
    """Units of lower-case texts in one chunk of bytes."""
    texts, sizes = len(offsets) - 1, np.diff(offsets)
    # a border before each text and one at the end
    inside = np.ones(len(data) + texts + 1, bool)
    inside[offsets[:-1] + np.arange(texts)] = False
    inside[-1] = False
    raw = np.full(len(inside), 10, np.uint8)
    raw[inside] = data
    owner = np.append(np.repeat(np.arange(texts), sizes + 1), texts)
    space = _IS_SPACE[raw]
    sentence = np.cumsum((raw == 10) | (_IS_STOP[raw] & np.append(space[1:], True)))
    token = np.cumsum(space)
    # the string of codes: lead bytes closed up, one border between words
    at = np.flatnonzero(_CODE[raw] >= 0)
    codes = _CODE[raw[at]]
    once = np.append(True, (codes[1:] != 1) | (codes[:-1] != 1))
    at, codes = at[once], codes[once]
    border = np.flatnonzero(codes == 1)
    first, last = border[:-1], border[1:]
    head = at[first + 1]
    text, sentence, token, n = owner[head], sentence[head], token[head], len(first)
    begin, end, own = _windows(first, last)
    parts = [(begin, end, text[own], sentence[own], np.full(len(own), WORD))]
    short = last - first + 1 <= LONGEST
    pair = np.flatnonzero((sentence[1:] == sentence[:-1]) & short[1:] & short[:-1])
    parts.append((first[pair], last[pair + 1], text[pair], sentence[pair], np.full(len(pair), PAIR)))
    # words that one token holds, and three or more single characters in a row of a sentence, are drawn together
    grouped = [np.zeros(0, np.int64)]
    group_of = [np.zeros(0, np.int64)]
    if n:
        single = last - first == 2
        for run, good, least in ((_runs(token[1:] == token[:-1], n), np.ones(n, bool), 2), (_runs((sentence[1:] == sentence[:-1]) & single[1:] & single[:-1], n), single, 3)):
            long = good & (np.bincount(run)[run] >= least)
            grouped.append(np.flatnonzero(long))
            group_of.append(run[long] + sum(int(g.max(initial=-1)) + 1 for g in group_of))
    grouped, group_of = np.concatenate(grouped), np.concatenate(group_of)
    if len(grouped):
        length = (last - first - 1)[grouped]
        place = np.repeat(first[grouped] + 1, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        group = np.repeat(group_of, length)
        new = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        more = np.append(np.insert(codes[place], new, 1), 1)
        edge = np.flatnonzero(more == 1) + len(codes)
        lead = grouped[np.flatnonzero(np.append(True, group_of[1:] != group_of[:-1]))]
        begin, end, own = _windows(edge[:-1], edge[1:])
        parts.append((begin, end, text[lead][own], sentence[lead][own], np.full(len(own), WORD)))
        codes = np.concatenate((codes, more))
    return Units(codes.astype(np.int32), *(np.concatenate(p) for p in zip(*parts, strict=True)), np.bincount(text, minlength=texts))


def sums(units: Units, lookup: np.ndarray) -> np.ndarray:
    """Normalised inner product of each unit's subsequence counts with a table over triples."""
    c, n = units.codes, len(units.codes)
    high, middle = c * _CODES**2, c * _CODES
    total = np.zeros(len(units.first))
    for d2 in range(2, min(SPAN, n)):
        value = np.zeros(n - d2)
        for d1 in range(1, d2):
            value += lookup[high[: n - d2] + middle[d1 : n - d2 + d1] + c[d2:]]
        upto = np.concatenate(([0.0], np.cumsum(value)))
        begin = np.minimum(units.first, n - d2)
        total += DECAY ** (d2 + 1) * (upto[np.maximum(units.last - d2 + 1, begin)] - upto[begin])
    return total / _NORMS[units.last - units.first + 1]


def subsequences(unit: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Explicit features of one unit (its codes as bytes): triples and normalised weights."""
    c = np.frombuffer(unit, np.uint8).astype(np.int64)
    number = [(c[: len(c) - d2] * _CODES + c[d1 : len(c) - d2 + d1]) * _CODES + c[d2:] for d1, d2 in _STEPS if d2 < len(c)]
    weight = [np.full(max(0, len(c) - d2), DECAY ** (d2 + 1)) for _, d2 in _STEPS if d2 < len(c)]
    if not number:
        return np.zeros(0, np.int64), np.zeros(0)
    spots, back = np.unique(np.concatenate(number), return_inverse=True)
    return spots, np.bincount(back, np.concatenate(weight), len(spots)) / _NORMS[len(c)]


def encode(word: str) -> bytes:
    """A word as a unit."""
    codes = _CODE[np.frombuffer(f"\n{word}\n".encode(), np.uint8)]
    return codes[codes >= 0].astype(np.uint8).tobytes()


class Landmarks:
    """Nyström features against fixed units."""

    def __init__(self, units: list[bytes]):
        self.rows = [subsequences(u) for u in units]
        # kernel values come from one small matrix: the triples that any landmark has x landmarks; row 0 is for all others
        used = np.unique(np.concatenate([spots for spots, _ in self.rows]))
        self.place = np.zeros(_CODES**3, np.int32)
        self.place[used] = np.arange(1, len(used) + 1)
        self.matrix = np.zeros((len(used) + 1, len(units)), np.float32)
        for j, (spots, values) in enumerate(self.rows):
            self.matrix[self.place[spots], j] = values
        gram = self.kernel(units)
        value, vector = np.linalg.eigh((gram + gram.T) / 2 + 1e-3 * np.eye(len(units)))
        self.whiten = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T

    def kernel(self, units: list[bytes]) -> np.ndarray:
        """(units x landmarks) kernel values."""
        return np.array([values @ self.matrix[self.place[spots]] for spots, values in map(subsequences, units)]).reshape(len(units), self.matrix.shape[1])

    def features(self, units: list[bytes]) -> np.ndarray:
        return self.kernel(units) @ self.whiten

    def table(self, weights: np.ndarray) -> np.ndarray:
        """The weights of the features as a table over all triples."""
        out = np.zeros(_CODES**3, np.float32)
        for (spots, values), w in zip(self.rows, self.whiten @ weights, strict=True):
            out[spots] += (w * values).astype(np.float32)
        return out


@dataclass
class ToxicityModel:
    lookup: np.ndarray
    bias: float
    #: Logistic curve over a text's features (see ``text_features``): mean and scale of each, weights with the constant last.
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    #: Score of every text, if the sample had one label only.
    constant: float | None = None

    def features(self, column: pa.Array) -> np.ndarray:
        """Features of each text of a lower-case column."""
        parts = []
        for _, data, offsets in tokens.chunks(column):
            units = read(data, offsets)
            parts.append(text_features(sums(units, self.lookup) + self.bias, units))
        return np.concatenate(parts) if parts else np.zeros((0, FEATURES))

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        x = self.features(column)
        z = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return np.where(x[:, -1] > 0, 1 / (1 + np.exp(-np.clip(z, -60, 60))), 0.0)


FEATURES = 5


def text_features(margins: np.ndarray, units: Units) -> np.ndarray:
    """Of each text: the largest margin of its words, the second largest, the mean of the ``TOP`` largest, the largest of its pairs, and the log of its number of words.

    Texts with fewer units are filled up with the lowest margin, to which all lower ones are raised.
    """
    texts = len(units.words)
    best, pairs = np.full((texts, TOP), FLOOR), np.full(texts, FLOOR)
    np.maximum.at(pairs, units.text[units.kind == PAIR], margins[units.kind == PAIR])
    high = np.flatnonzero((margins > FLOOR) & (units.kind == WORD))
    order = high[np.lexsort((-margins[high], units.text[high]))]
    owner = units.text[order]
    nth = np.arange(len(order)) - np.searchsorted(owner, owner)
    first = nth < TOP
    best[owner[first], nth[first]] = margins[order[first]]
    return np.column_stack((best[:, 0], best[:, 1], best.mean(1), pairs, np.log1p(units.words)))


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int, epochs: int = 40, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear SVM (hinge loss, labels +1 and -1, weighted) by stochastic subgradient steps, scaled per coordinate."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(x.shape[1]), 0.0
    seen_w, seen_b = np.full(x.shape[1], 1e-2), 1e-2
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            active = at[y[at] * (x[at] @ w + b) < 1]
            pull = weight[active] * y[active] / len(at)
            step_w, step_b = ridge * w - pull @ x[active], -pull.sum()
            seen_w += step_w**2
            seen_b += step_b**2
            w -= 0.5 * step_w / np.sqrt(seen_w)
            b -= 0.5 * step_b / np.sqrt(seen_b)
    return w, float(b)


@dataclass
class Document:
    """One document of the sample: its codes, and of each of its units the place, the sentence and the number."""

    codes: np.ndarray
    first: np.ndarray
    last: np.ndarray
    sentence: np.ndarray
    unit: np.ndarray

    def sentences(self) -> list[np.ndarray]:
        """Numbers of the units of each sentence."""
        order = np.argsort(self.sentence, kind="stable")
        return [np.unique(u) for u in np.split(self.unit[order], np.flatnonzero(np.diff(self.sentence[order])) + 1) if len(u)]


@dataclass
class Sample:
    """Documents, and the kind of each distinct unit and where it stands first (document and place in it)."""

    documents: list[Document]
    kind: np.ndarray
    where: np.ndarray
    place: np.ndarray
    #: Hashes of the first 4 to 9 characters of each word, 0 where there are none (units x 6).
    stems: np.ndarray

    def units(self, numbers) -> list[bytes]:
        out = []
        for u in numbers:
            doc = self.documents[self.where[u]]
            out.append(doc.codes[doc.first[self.place[u]] : doc.last[self.place[u]] + 1].tobytes())
        return out

    def margins(self, model: ToxicityModel) -> np.ndarray:
        out = np.full(len(self.kind), FLOOR)
        for d in self.documents:
            if len(d.unit):
                none = np.zeros(0, np.int64)
                out[d.unit] = sums(Units(d.codes.astype(np.int32), d.first, d.last, none, none, none, none), model.lookup) + model.bias
        return out


STEMS = range(4, 10)


def collect(texts: list[str]) -> Sample:
    documents, hashes, kinds, stems = [], [], [], []
    for text in lowered(pa.array(texts, pa.string())):
        data = np.frombuffer(text.as_py().encode(), np.uint8)
        found = read(data, np.array([0, len(data)]))
        codes = found.codes.astype(np.uint8)
        documents.append(Document(codes, found.first.astype(np.int32), found.last.astype(np.int32), found.sentence, np.zeros(0, np.int64)))
        of = lambda first, end, c=codes: tokens.range_hashes(c, first, end)
        hashes.append(of(found.first, found.last + 1))
        kinds.append(found.kind.astype(np.int8))
        # a word's own last border is no part of a stem
        stems.append(np.stack([np.where((found.kind == WORD) & (found.first + k < found.last), of(found.first, np.minimum(found.first + k, found.last)), np.uint64(0)) for k in STEMS], 1))
    doc = np.repeat(np.arange(len(documents)), [len(h) for h in hashes])
    at = np.concatenate([np.arange(len(h)) for h in hashes])
    _, index, number = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    for d, part in zip(documents, np.split(number, np.cumsum([len(h) for h in hashes])[:-1]), strict=True):
        d.unit = part
    return Sample(documents, np.concatenate(kinds)[index], doc[index], at[index], np.concatenate(stems)[index])


def first_guess(sample: Sample, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In how many toxic and clean documents each unit is, and how strongly it, or the words that begin like it, lean to toxic ones."""
    n_units = len(sample.kind)
    own = [np.unique(d.unit) for d in sample.documents]
    bad = np.repeat(labels.astype(bool), [len(u) for u in own])
    doc = np.repeat(np.arange(len(own)), [len(u) for u in own])
    unit = np.concatenate(own)
    toxic, clean = np.bincount(unit[bad], minlength=n_units), np.bincount(unit[~bad], minlength=n_units)
    n, m = int(labels.sum()) + 1, int((1 - labels).sum()) + 1
    lean = lambda a, b: a * np.maximum(0.0, np.log((a + 0.5) / n * m / (b + 0.5)) - 1)
    guess = np.where(toxic > 0, lean(toxic, clean), 0.0)
    guess[(sample.kind == PAIR) & (toxic < 2)] = 0.0  # a pair that is there once tells nothing
    for k in range(sample.stems.shape[1]):
        some = sample.stems[unit, k] != 0
        values, number = np.unique(sample.stems[unit[some], k], return_inverse=True)
        once = np.unique(number * len(own) + doc[some])  # a stem counts once for each document
        of = labels[once % len(own)].astype(bool)
        t, c = np.bincount((once // len(own))[of], minlength=len(values)), np.bincount((once // len(own))[~of], minlength=len(values))
        held = np.flatnonzero((toxic > 0) & (sample.stems[:, k] != 0))
        spot = np.searchsorted(values, sample.stems[held, k])
        guess[held] = np.maximum(guess[held], 0.8 * lean(t[spot], c[spot]))
    return toxic, clean, guess


def witnesses(doc: list[np.ndarray], suspicion: np.ndarray) -> list[int]:
    """Of a toxic document the most suspicious unit of each sentence that stands out: the sentences that are labelled toxic."""
    tops = [(suspicion[s].max(), int(s[suspicion[s].argmax()])) for s in doc if len(s)]
    best = max((v for v, _ in tops), default=0.0)
    return [u for v, u in sorted(tops, reverse=True)[:3] if v >= 0.3 * best and v > 0]


def train(texts: list[str], labels: np.ndarray, rounds: int = 5, seed: int = 11) -> ToxicityModel:
    """Fit on documents and their labels (0 or 1). With one label only, every score is that label."""
    blank = np.zeros(_CODES**3, np.float32)
    if len(set(labels.tolist())) < 2:
        return ToxicityModel(blank, 0.0, constant=float(labels[0]) if len(labels) else 0.0)
    rng = np.random.default_rng(seed)
    sample = collect(texts)
    toxic, clean, prior = first_guess(sample, labels)
    suspicion, hard = prior.copy(), np.zeros(0, np.int64)
    words, pairs = (np.flatnonzero((clean > 0) & (sample.kind == k)) for k in (WORD, PAIR))
    frequent = words[np.argsort(-clean[words], kind="stable")[:UNITS]]
    n_toxic, n_clean = labels.sum(), len(labels) - labels.sum()
    sentences = [d.sentences() for d in sample.documents]
    at = sample.units
    model = None
    for r in range(rounds):
        votes = np.zeros(len(sample.kind), np.int64)
        for doc, bad in zip(sentences, labels, strict=True):
            if bad:
                np.add.at(votes, witnesses(doc, suspicion), 1)
        positive = np.flatnonzero((votes > 0) & (clean * n_toxic <= 0.5 * toxic * n_clean))
        positive = positive[np.argsort(-votes[positive], kind="stable")][:UNITS]
        drawn = np.concatenate([rng.choice(own, min(len(own), n), replace=False) if len(own) else own for own, n in ((words, 2 * UNITS), (pairs, UNITS))])
        chosen = set(positive.tolist())
        negative = np.array([j for j in dict.fromkeys([*hard.tolist(), *frequent.tolist(), *drawn.tolist()]) if j not in chosen], np.int64)
        if not len(positive) or not len(negative):
            break
        near = Landmarks(at(dict.fromkeys([*positive[:LANDMARKS], *hard[: LANDMARKS // 2], *frequent[: LANDMARKS // 2], *drawn[: LANDMARKS // 4]])))
        x = near.features(at([*positive, *negative]))
        y = np.concatenate((np.ones(len(positive)), -np.ones(len(negative))))
        gain, loss = np.sqrt(votes[positive]), np.sqrt(np.maximum(clean[negative], 1))
        weight = np.concatenate((gain * loss.sum() / gain.sum() / 2, loss))
        w, bias = train_svm(x, y, weight / weight.mean(), seed + r)
        model = ToxicityModel(near.table(w), bias)
        margin = sample.margins(model)
        top = {int(j) for doc, bad in zip(sample.documents, labels, strict=True) if not bad for own in [np.unique(doc.unit)] for j in own[np.argsort(-margin[own], kind="stable")[:3]]}
        hard = np.array(sorted(top | set(hard.tolist()), key=lambda j: (-margin[j], j))[: 2 * UNITS], np.int64)
        suspicion = np.maximum(margin + 1, 0) * (1 + prior / max(prior.max(), 1e-9))
    if model is None:
        return ToxicityModel(blank, 0.0, constant=float(n_toxic / len(labels)))
    # the curve is fitted to the documents and to the sentence of each that stands out most
    worst = [max(doc, key=lambda own: margin[own].max()) for doc in sentences if doc]
    of_worst = labels[[bool(doc) for doc in sentences]]
    spots = np.concatenate(worst)
    owner = np.repeat(np.arange(len(worst)), [len(w) for w in worst])
    kind = sample.kind[spots]
    none = np.zeros(0, np.int64)
    alone = text_features(margin[spots], Units(none, none, none, owner, none, kind, np.bincount(owner[kind == WORD], minlength=len(worst))))
    x = np.concatenate((model.features(lowered(pa.array(texts, pa.string()))), alone))
    return calibrate(model, x, np.concatenate((labels, of_worst)), np.repeat([1.0, SENTENCE], [len(texts), len(worst)]))


def calibrate(model: ToxicityModel, features: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> ToxicityModel:
    """Logistic curve over the features of the sample's texts, weighted, by Newton steps with a small ridge; a higher margin never lowers the score."""
    mean, scale = features.mean(0), features.std(0) + 1e-6
    x = np.column_stack(((features - mean) / scale, np.ones(len(features))))
    use = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        own = x[:, use]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(own @ w[use], -60, 60)))
            ridge = 0.1 * np.eye(own.shape[1])
            w[use] += np.linalg.solve((own * (weight * np.maximum(p * (1 - p), 1e-5))[:, None]).T @ own + ridge, own.T @ (weight * (labels - p)) - ridge @ w[use])
        margins = w[: FEATURES - 1]
        if margins.min() >= 0:
            break
        use[int(margins.argmin())] = False
    model.mean, model.scale, model.weights = mean, scale, w
    return model


def _score(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(lowered(batch.column(1))))], ["doc_id", "score"])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> ToxicityModel:
    """Model from labelled documents outside the held-out fold, at most ``per_label`` of each label, picked by a hash of their ids.

    Their whole texts come to the driver. Null ids, labels and texts are left out; of several labels of a document the
    highest counts; rows of ``docs`` that repeat an id are learned from each. Without any labelled row every score is 0.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    picked = sample_per_class(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic", per_label).select("doc_id", "toxic")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    rows = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return train(rows["text"].to_pylist(), np.array(rows["toxic"].to_pylist(), dtype=int))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), predicted (1 if score >= 0.3).

    Only the text decides, all of it, however long. Null and empty texts and texts without a letter or digit score
    0. Repeated rows get the same score each; null ids stay null; other columns are not read. An empty table gives
    an empty result. The work is one map over rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = arrow_map(texts, lambda it: _score(it, shared.value), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
