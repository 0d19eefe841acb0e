"""Hashed n-gram counts of texts and the bounded labelled samples that classifiers are fitted on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import tokens

#: Texts whose counts are held as one dense matrix.
ROWS = 128
_LETTERS = np.full(256, 32, np.uint8)
for _b in [*range(97, 123), *range(128, 256)]:
    _LETTERS[_b] = _b
_LETTERS[65:91] = np.arange(97, 123)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id's text is 2 modulo 4 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample_per_class(rows: DataFrame, label: str, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``per_class`` rows of each label, by a hash of the id: the same rows however the table is split.

    Labels are counted first (combined before the shuffle), and rows of frequent labels are thinned by their hash
    to about four times the number wanted, so that putting them in order takes a bounded number of rows. There
    are few labels: callers pass classes or grades.
    """
    million = 1_000_000
    counts = F.broadcast(rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n")))
    thin = rows.join(counts, label).where(F.pmod(F.xxhash64(id_col), F.lit(million)) * F.col("__n") < F.lit(4 * per_class * million))
    order = Window.partitionBy(label).orderBy(F.pmod(F.xxhash64(id_col), F.lit(million)), F.xxhash64(id_col), id_col)
    return thin.withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") <= per_class).drop("__nth", "__n")


def subword_counts(data: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], buckets: int) -> np.ndarray:
    """(texts x buckets) counts of hashed byte n-grams inside words; one space marks a word's border."""
    return _counts(_LETTERS[data], offsets, orders, buckets, True)


def byte_counts(data: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], buckets: int) -> np.ndarray:
    """(texts x buckets) counts of hashed byte n-grams of the texts as they are."""
    return _counts(data, offsets, orders, buckets, False)


def _grams(data: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], bits: int, in_words: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: hashes of ``bits`` bits of the n-grams at every place, the text of each, and whether it is one."""
    texts = len(offsets) - 1
    lengths = np.diff(offsets)
    # one border space before each text and after the last keeps words of two texts apart
    padded = np.full(len(data) + texts + 1, 32, np.uint8)
    for i in range(texts):
        padded[offsets[i] + i + 1 : offsets[i + 1] + i + 1] = data[offsets[i] : offsets[i + 1]]
    text = np.concatenate((np.repeat(np.arange(texts, dtype=np.int32), lengths + 1), np.full(1, texts, np.int32)))
    wide = padded.astype(np.uint32)
    shift = np.uint32(32 - bits)
    space = padded == 32
    gram = wide
    inner = np.zeros(len(padded), bool)
    for order in range(2, max(orders) + 1):
        n = len(padded) - order + 1
        if n <= 0:
            break
        gram = gram[:n] * np.uint32(0x01000193)
        gram ^= wide[order - 1 :]
        inner = inner[:n]
        if order > 2:
            inner = inner | space[order - 2 : order - 2 + n]
        if order not in orders:
            continue
        hashed = ((gram + np.uint32(order)) * np.uint32(0x9E3779B1) >> shift).astype(np.int32)
        if in_words:
            whole = ~(inner | (space[:n] & space[order - 1 :]))
        else:
            whole = text[:n] == text[order - 2 : order - 2 + n] if texts > 1 else np.ones(n, bool)
        yield hashed, text[:n], whole


def _counts(data: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], buckets: int, in_words: bool) -> np.ndarray:
    texts = len(offsets) - 1
    out = np.zeros(texts * buckets + 1, np.int64)
    for hashed, text, whole in _grams(data, offsets, orders, int(buckets).bit_length() - 1, in_words):
        out += np.bincount(np.where(whole, text * np.int32(buckets) + hashed, np.int32(texts * buckets)), minlength=len(out))
    return out[:-1].astype(np.float32).reshape(texts, buckets)


def subwords(data: np.ndarray, offsets: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every byte n-gram of one order inside words, borders included."""
    for hashed, text, whole in _grams(_LETTERS[data], offsets, (order,), bits, True):
        return hashed[whole], text[whole]
    return np.zeros(0, np.int32), np.zeros(0, np.int32)


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


def dense_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    return tokens.chunks(column, ROWS)
