"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

A text is the average of the embeddings of its hashed byte n-grams (inside words, borders marked). Embeddings
and softmax are trained together by stochastic gradient descent in numpy on the driver, on a bounded sample
(whole documents and short pieces of them).

One document in five of the sample is kept apart to set the temperature of the softmax and two limits. A text
is rejected when its largest probability is below that of nearly all calibration pieces, or when it is foreign
to all languages: the n-grams of ``SEEN_ORDER`` bytes of the sample are kept as a bit map, and the evidence of a text
is the log likelihood ratio of its seen and unseen n-grams between known and foreign texts (calibration pieces of one
language held against what all others have, and pieces with shuffled letters), on average over its n-grams and
``PRIOR`` more that tell nothing. So short texts have little evidence either way, a foreign part doesn't outweigh the
rest of a long text, and a text that mixes known languages is known.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, table
from millrace.llm.features import dense_chunks, held_out, lowered, sample_per_class, subword_counts, subwords

ORDERS = (2, 3, 4)
BUCKETS = 1 << 13
DIM = 16
#: n-grams whose presence in the sample is kept: bytes, and bits of their hashes.
SEEN_ORDER, SEEN_BITS = 4, 18
PRIOR = 20
#: Bounds of the training sample: documents of a language, documents of all languages together, and documents
#: that every language has at least, however many languages there are.
PER_CLASS, SAMPLE, LEAST = 200, 6000, 20
#: Share of calibration pieces that may fall below each of the two limits.
REJECT = 0.001
#: Letters of the pieces of a document (from its middle and elsewhere) that are learned and calibrated on beside the whole.
PIECES = (80, 25, 9)
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    embedding: np.ndarray  # BUCKETS x DIM
    weights: np.ndarray  # DIM x languages
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    seen: np.ndarray | None = None  # 2 ** SEEN_BITS
    #: Evidence that a seen and an unseen n-gram give, and the least average of it that is accepted.
    evidence: tuple[float, float] = (0.0, 0.0)
    least_evidence: float = -np.inf

    def scores(self, counts: np.ndarray) -> np.ndarray:
        hidden = (counts / np.maximum(counts.sum(1, keepdims=True), 1)) @ self.embedding
        return _softmax((hidden @ self.weights + self.bias) / self.temperature)

    def familiar(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Evidence that each text is in a known language."""
        spot, text = subwords(data, offsets, SEEN_ORDER, SEEN_BITS)
        number = np.bincount(text, minlength=len(offsets) - 1)
        hits = np.bincount(text, self.seen[spot], len(offsets) - 1)
        return (hits * self.evidence[0] + (number - hits) * self.evidence[1]) / (number + PRIOR)


@dataclass
class Sparse:
    """Rows of averaged counts; only the rows of one batch are ever unfolded."""

    begin: np.ndarray
    spots: np.ndarray
    values: np.ndarray

    def rows(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), BUCKETS), np.float32)
        for i, r in enumerate(at):
            own = slice(self.begin[r], self.begin[r + 1])
            out[i, self.spots[own]] = self.values[own] / max(float(self.values[own].sum()), 1.0)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(x: Sparse, y: np.ndarray, languages: list[str], aside: np.ndarray, epochs: int = 12, seed: int = 7) -> LanguageModel:
    """Fit on averaged counts and classes ``y``; rows ``aside`` only set the temperature and the limit of the softmax."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    model = LanguageModel(languages, rng.normal(0, 1, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.3, (DIM, k)).astype(np.float32), np.zeros(k, np.float32))
    learn = np.flatnonzero(~aside)
    target = np.eye(k, dtype=np.float32)
    for epoch in range(epochs):
        rate = 20.0 * (1 - epoch / epochs) + 0.5
        for at in np.array_split(rng.permutation(learn), max(1, len(learn) // 32)):
            xb = x.rows(at)
            hidden = xb @ model.embedding
            error = (_softmax(hidden @ model.weights + model.bias) - target[y[at]]) / len(at)
            back = error @ model.weights.T
            model.weights -= 0.05 * rate * hidden.T @ error
            model.bias -= 0.05 * rate * error.sum(0)
            model.embedding -= rate * xb.T @ back
    check = np.flatnonzero(aside) if aside.any() else learn
    logits = np.concatenate([x.rows(at) @ model.embedding @ model.weights + model.bias for at in np.array_split(check, -(-len(check) // 64))])
    losses = {t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(check)), y[check]], 1e-9)).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0)}
    model.temperature = min(losses, key=losses.get)
    model.reject_below = float(np.quantile(_softmax(logits / model.temperature).max(1), REJECT))
    return model


def calibrate(model: LanguageModel, own: np.ndarray, other: np.ndarray) -> None:
    """Set what n-grams tell, and the limit: ``own`` and ``other`` are rows of (n-grams, seen ones) of accepted and of foreign texts."""
    rate = lambda a: float(np.clip((a[:, 1].sum() + 1) / (a[:, 0].sum() + 2), 1e-3, 1 - 1e-3))
    known, foreign = rate(own), rate(other)
    if foreign >= known:  # nothing tells them apart
        return
    model.evidence = float(np.log(known / foreign)), float(np.log((1 - known) / (1 - foreign)))
    tell = lambda a: (a[:, 1] * model.evidence[0] + (a[:, 0] - a[:, 1]) * model.evidence[1]) / (a[:, 0] + PRIOR)
    model.least_evidence = float(np.quantile(tell(own), REJECT))


def _pieces(text: str) -> list[str]:
    """A text and short pieces of it, so that short texts are learned too."""
    at = len(text) // 2
    return [text, *(text[at // (i + 1) : at // (i + 1) + n] for i, n in enumerate(PIECES))]


def _shuffled(data: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The bytes of a text in another order, spaces where they were."""
    out = data.copy()
    letters = np.flatnonzero(data != 32)
    out[letters] = data[rng.permutation(letters)]
    return out


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, lang, text) to sparse counts of the text and its pieces, and n-grams of each and of its letters shuffled."""
    lists = lambda rows, kind: pa.array(rows, pa.list_(kind))
    for batch in batches:
        for i in range(batch.num_rows):
            pieces = lowered(pa.array(_pieces(batch.column(2)[i].as_py() or "")))
            counts = [row for _, data, offsets in dense_chunks(pieces) for row in subword_counts(data, offsets, ORDERS, BUCKETS)]
            spots = [np.flatnonzero(c).astype(np.int32) for c in counts]
            seen, mixed = [], []
            rng = np.random.default_rng(len(pieces[0].as_py()))
            for piece in pieces:
                data = np.frombuffer(piece.as_py().encode(), np.uint8)
                for into, bytes_ in ((seen, data), (mixed, _shuffled(data, rng))):
                    into.append(np.unique(subwords(bytes_, np.array([0, len(bytes_)]), SEEN_ORDER, SEEN_BITS)[0], return_counts=True))
            n = len(pieces)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(0)[i].as_py()] * n), pa.array([batch.column(1)[i].as_py()] * n), pa.array(np.arange(n, dtype=np.int32)), lists(spots, pa.int32()), lists([c[s] for c, s in zip(counts, spots, strict=True)], pa.float32()),
                 lists([g for g, _ in seen], pa.int32()), lists([t.astype(np.int32) for _, t in seen], pa.int32()), lists([g for g, _ in mixed], pa.int32()), lists([t.astype(np.int32) for _, t in mixed], pa.int32())],
                ["doc_id", "lang", "piece", "spots", "counts", "seen", "times", "mixed", "mixed_times"],
            )


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = PER_CLASS, sample: int = SAMPLE) -> LanguageModel | None:
    """Model from labelled rows outside the held-out fold; None if there are none.

    Of every language at most ``per_class`` documents are used, and no more than its share of ``sample`` (but
    ``LEAST``), picked by a hash of their ids. Null ids, null languages and texts without a letter are not
    learned from; repeated rows count as often as they are there. With one language only, every text is taken
    for it unless it is rejected.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    per_class = max(LEAST, min(per_class, sample // max(1, rows.select("lang").distinct().count())))
    ids = sample_per_class(rows.select("doc_id", "lang"), "lang", per_class).select("doc_id", "lang").distinct()
    picked = rows.join(F.broadcast(ids), ["doc_id", "lang"]).select("doc_id", "lang", "text")
    got = arrow_map(picked, _sample_counts, "doc_id long, lang string, piece int, spots array<int>, counts array<float>, seen array<int>, times array<int>, mixed array<int>, mixed_times array<int>").toArrow().sort_by([("doc_id", "ascending"), ("piece", "ascending")]).combine_chunks()
    got = got.filter(pc.greater(pc.list_value_length(got["spots"]), 0)).combine_chunks()
    if not got.num_rows:
        return None
    languages = sorted(set(got["lang"].to_pylist()))
    y = np.searchsorted(languages, got["lang"].to_pylist())
    flat = lambda name: (got[name].combine_chunks().offsets.to_numpy(), got[name].combine_chunks().flatten().to_numpy())
    (begin, spots), (_, counts) = flat("spots"), flat("counts")
    group = np.unique(got["doc_id"].to_numpy(), return_inverse=True)[1]
    aside = group % 5 == 4
    if aside.all():
        aside[:] = False
    model = train(Sparse(begin - begin[0], spots, counts), y, languages, aside)

    # in how many languages each n-gram is; then what calibration pieces look like to all of them, and to all others
    (begin, seen), (_, times) = flat("seen"), flat("times")
    row = np.repeat(np.arange(len(y)), np.diff(begin))
    learned = ~aside[row]
    own = [np.unique(seen[learned & (y[row] == k)]) for k in range(len(languages))]
    held = np.bincount(np.concatenate(own), minlength=1 << SEEN_BITS)
    model.seen = held > 0
    check = np.flatnonzero(aside) if aside.any() else np.arange(len(y))

    def told(name: str, others: bool = False) -> np.ndarray:
        """(n-grams, seen ones) of the calibration rows; with ``others``, seen in other languages than their own."""
        (start, grams), (_, often) = flat(name), flat("times" if name == "seen" else "mixed_times")
        out = np.zeros((len(check), 2))
        for j, r in enumerate(check):
            mine = grams[start[r] : start[r + 1]]
            hit = held[mine] - np.isin(mine, own[y[r]]) > 0 if others else model.seen[mine]
            number = often[start[r] : start[r + 1]]
            out[j] = number.sum(), number[hit].sum()
        return out

    foreign = [told("mixed")] + ([told("seen", others=True)] if len(languages) > 1 else [])
    calibrate(model, told("seen"), np.concatenate(foreign))
    return model


def _predict(batches: Iterator[pa.RecordBatch], model: LanguageModel | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        best, score, evidence = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        text = lowered(batch.column(1))
        known = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
        if model is None:
            known = np.zeros(n, bool)
        else:
            for at, data, offsets in dense_chunks(text):
                p = model.scores(subword_counts(data, offsets, ORDERS, BUCKETS))
                to = at + len(p)
                best[at:to], score[at:to] = p.argmax(1), p.max(1)
                evidence[at:to] = model.familiar(data, offsets)
        lang = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        score = np.where(known, np.clip(score, 0, 1), 0.0)
        rejected = ~known | (score < model.reject_below) | (evidence < model.least_evidence) if model else ~known
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, rejected.

    Only the text decides, all of it, however long. Null texts and texts without a letter are ``und`` with score
    0 and rejected; so is everything if there is no model (no labelled rows). Other ``rejected`` texts carry the
    language that is nearest to them. Equal scores: the language first in order wins. Repeated rows get the same
    answer each; null ids stay null; other columns are not read. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return arrow_map(texts, lambda it: _predict(it, shared.value), "doc_id long, lang_pred string, score double, rejected boolean")


def _accepted(batches: Iterator[pa.RecordBatch], model: LanguageModel | None, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        asked = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], ["doc_id", "text"])
        for answer in _predict(iter([asked]), model):
            yield batch.filter(pc.invert(answer.column(3)))


def drop_rejected(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is rejected; the other rows and all columns as they are.

    Null texts and texts without a letter go; without a model everything goes. Repeated rows stay or go together;
    ids play no part. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    return arrow_map(docs, lambda it: _accepted(it, shared.value, at), docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
