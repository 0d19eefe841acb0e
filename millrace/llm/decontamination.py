"""Benchmark decontamination by latent semantic retrieval and a subsequence check.

1. Words are lower-cased runs of letters and digits. The vocabulary is the whole benchmark's: other words add
   nothing to an inner product with a benchmark passage.
2. A first pass over all documents counts in how many passages (windows of ``WINDOW`` words) each term occurs.
3. A second pass multiplies the TF-IDF passage matrix X of all documents with a random matrix: X'(X R), summed
   by Spark. From that the driver gets the leading right singular vectors and values of X (the one-pass
   randomised decomposition of a positive matrix); its inputs are as large as the vocabulary, not the corpus.
4. A third pass searches for candidates. Stretches of a document that hold enough of an item's rarer words are held
   against the item in the latent space (half whitened: divided by the roots of the singular values): a stretch with
   a passage whose cosine to a chunk of the item is ``COSINE`` or more is a candidate. As a cosine is no bound for
   step 5, stretches below it that share as many words with the item as step 5 asks for are candidates too. What
   is enough of the rarer words also follows from step 5 (n - t + k of an item's n words hold at least k of any
   t), so no match that step 5 would confirm is lost.
5. A candidate is confirmed in place: the longest common subsequence of the item's words and the document's
   words around the match must cover ``LCS`` of the item, or ``LCS_WITH_ANSWER`` of it if the item's answer is
   there too. Every stretch as long as the item and its slack on both sides is tried. Of items of more than
   ``PASSAGE`` words, ``LCS`` of any passage of so many words (one every ``PASSAGE_STEP`` words) is enough.

The first two passes are made once for the whole benchmark; the third sends items to the tasks in blocks of at
most ``BLOCK``, one pass for each, so what is sent is bounded and a match doesn't depend on the other items.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import tokens
from millrace.llm.common import arrow_map, table
from millrace.llm.features import lowered

WINDOW = 16
STRIDE = 8
#: Steps at which an item is cut into chunks of WINDOW words.
CHUNK_STEP = 4
RANK = 40
OVERSAMPLE = 8
#: Share of an item's words that are asked for at once before words are aligned. Any share finds all; it sets the cost.
ASKED = 0.15
#: Items whose rarer words are looked up together.
GROUP = 256
LCS = 0.7
LCS_WITH_ANSWER = 0.5
#: Words of the passages of long items, and steps at which they begin.
PASSAGE, PASSAGE_STEP = 40, 8
#: Benchmark items in one block.
BLOCK = 2000
#: Least cosine of a candidate, and pairs of passages and chunks whose cosines are taken at once.
COSINE, PAIRS = 0.5, 1 << 16

_WORD_BYTES = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _WORD_BYTES[_b] = _b


def word_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, bounds of each text's words) of consecutive chunks of a text column."""
    for at, data, offsets in tokens.chunks(lowered(column)):
        hashed, _, _, bounds = tokens.words(_WORD_BYTES[data], offsets)
        yield at, hashed, bounds


@dataclass
class Item:
    item_id: int
    words: list[int]
    answer: list[int]


_LOW = np.uint64((1 << 20) - 1)


class Vocabulary:
    """Sorted word hashes."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(words & _LOW).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.words)

    def terms(self, hashed: np.ndarray) -> np.ndarray:
        """Position of each word in the vocabulary, or -1."""
        out = np.full(len(hashed), -1)
        if not len(self.words):
            return out
        may = np.flatnonzero(self.seen[(hashed & _LOW).astype(np.int64)])
        spot = np.minimum(np.searchsorted(self.words, hashed[may]), len(self.words) - 1)
        same = self.words[spot] == hashed[may]
        out[may[same]] = spot[same]
        return out


def _words_of(text: str) -> list[int]:
    return [int(h) for _, hashed, _ in word_chunks(pa.array([text])) for h in hashed]


def read_items(rows: list) -> list[Item]:
    """Items of collected rows (item_id, text, answer). Without an answer, the last sentence stands for it, or the last five words if it is short."""
    items = []
    for item_id, text, answer in rows:
        words = _words_of(text or "")
        if not words:
            continue
        last = [s for s in (text or "").replace("!", ".").replace("?", ".").split(".") if s.strip()][-1:]
        own = _words_of(answer if answer else last[0] if last else "")
        items.append(Item(item_id, words, own if answer or len(own) >= 3 else words[-5:]))
    return items


def words_of_items(items: list[Item]) -> np.ndarray:
    return np.unique(np.array([w for i in items for w in i.words], np.uint64))


def windows(begin: np.ndarray, end: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of WINDOW words inside each range of words, every ``stride`` words: starts, lengths, ranges. A range's last window is moved back to be full; short ranges are one window."""
    sizes = end - begin
    count = np.where(sizes > WINDOW, -(-(sizes - WINDOW) // stride) + 1, (sizes > 0).astype(np.int64))
    own = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    start = begin[own] + np.minimum(nth * stride, np.maximum(sizes[own] - WINDOW, 0))
    return start, np.minimum(sizes[own], WINDOW), own


def passages(bounds: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of whole texts."""
    return windows(bounds[:-1], bounds[1:], stride)


def window_terms(term: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(windows x WINDOW) terms, -1 where there is none."""
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < length[:, None]
    return np.where(inside, term[np.minimum(at, max(len(term) - 1, 0))], -1)


def weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weight of every place of the windows, rows of length one. Repeats of a term add up."""
    value = np.where(rows >= 0, idf[np.maximum(rows, 0)], 0.0)
    same = (rows[:, :, None] == rows[:, None, :]) & (rows >= 0)[:, :, None]
    norm = np.sqrt(np.einsum("ij,ijk,ik->i", value, same, value))
    return value / np.maximum(norm, 1e-9)[:, None]


def _count(batches: Iterator[pa.RecordBatch], known: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Passages in which each term occurs (term -1: passages), summed over the task."""
    size = len(known)
    total = np.zeros(size + 1, np.int64)
    for batch in batches:
        for _, hashed, bounds in word_chunks(batch.column(0)):
            term = known.terms(hashed)
            start, _, _ = passages(bounds, WINDOW)
            total[size] += len(start)
            met = np.flatnonzero(term >= 0)
            # windows start every WINDOW words of a text; the moved last one is counted where its words begin
            text = np.searchsorted(bounds, met, "right") - 1
            window = (met - bounds[text]) // WINDOW
            keyed = np.unique((text * (int(np.diff(bounds).max(initial=0)) // WINDOW + 2) + window) * size + term[met]) % size if len(met) else met
            total[:size] += np.bincount(keyed, minlength=size)
    spots = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.where(spots == size, -1, spots).astype(np.int32)), pa.array(total[spots])], ["term", "n"])


def _sketch(batches: Iterator[pa.RecordBatch], known: Vocabulary, idf: np.ndarray, random: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The task's part of X'(X R): a row for each term, a column for each random direction."""
    size, wide = random.shape
    total = np.zeros((size, wide))
    random = random.astype(np.float32)
    for batch in batches:
        for _, hashed, bounds in word_chunks(batch.column(0)):
            term = known.terms(hashed)
            start, length, _ = passages(bounds, WINDOW)
            for at in range(0, len(start), 4096):
                rows = window_terms(term, start[at : at + 4096], length[at : at + 4096])
                value = weighted(rows, idf)
                where, place = np.nonzero(rows >= 0)
                if not len(where):
                    continue
                flat, weight = rows[where, place], value[where, place].astype(np.float32)[:, None]
                begin = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
                image = np.add.reduceat(random[flat] * weight, begin, axis=0)
                back = np.cumsum(np.concatenate(([False], where[1:] != where[:-1])))
                order = np.argsort(flat, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], flat[order][1:] != flat[order][:-1])))
                total[flat[order][first]] += np.add.reduceat((image[back] * weight)[order], first, axis=0)
    used = np.flatnonzero(total.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(total[used, j]) for j in range(wide))], ["term", *(f"c{j}" for j in range(wide))])


def decompose(product: np.ndarray, random: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading singular vectors (columns) and values of X from X'X R and R."""
    shift = 1e-9 * max(np.linalg.norm(product), 1e-12)
    moved = product + shift * random
    core = random.T @ moved
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > 1e-10 * max(value.max(), 1e-300)
    left, size, _ = np.linalg.svd(moved @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)
    return left[:, :rank], size[:rank]


@dataclass
class Unit:
    """Words to be found: an item, or a passage of it (without an answer)."""

    item: int  # its place in the block
    words: list[int]
    answer: list[int] | None
    reach: int  # words of a document over which a match may spread
    need: int  # least words in common


@dataclass
class Group:
    """Units and their rarer words: ``units[begin[t] : begin[t + 1]]`` have term t among them."""

    first: int  # the first unit
    begin: np.ndarray
    units: np.ndarray
    asked: np.ndarray  # of a unit's rarer words, how many every match has
    reach: np.ndarray


@dataclass
class Latent:
    """What the passes over all documents give: the weights of terms and their place in the latent space."""

    known: Vocabulary
    idf: np.ndarray
    mapping: np.ndarray  # vocabulary x latent directions; the last row is zero and stands for -1

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        """Latent vectors of windows of terms, of length one (or zero)."""
        out = np.zeros((len(rows), self.mapping.shape[1]), np.float32)
        for k in range(WINDOW):
            out += self.mapping[rows[:, k]]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@dataclass
class Index:
    """A block of items, ready to be searched."""

    latent: Latent
    items: list[Item]
    chunks: np.ndarray  # chunks x latent directions, rows of length one
    begin: np.ndarray  # items + 1: the first chunk of each
    units: list[Unit]
    groups: list[Group]

    def cosines(self, item: np.ndarray, start: np.ndarray, end: np.ndarray, term: np.ndarray) -> np.ndarray:
        """For each stretch of words the best cosine of a passage of it and a chunk of its item."""
        at, length, own = windows(start, end, STRIDE)
        best = np.zeros(len(item), np.float32)
        vector = self.latent.vectors(window_terms(term, at, length))
        count = (self.begin[item + 1] - self.begin[item])[own]
        upto = np.cumsum(count)
        lo = 0
        while lo < len(own):  # so many windows at once that their pairs with chunks stay bounded
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
            window = np.repeat(np.arange(lo, hi), count[lo:hi])
            chunk = self.begin[item[own[window]]] + np.arange(len(window)) - np.repeat(upto[lo:hi] - count[lo:hi] - (upto[lo - 1] if lo else 0), count[lo:hi])
            np.maximum.at(best, own[window], np.einsum("ij,ij->i", vector[window], self.chunks[chunk]))
            lo = hi
        return best


def slack(size: int) -> int:
    """Words by which a match of ``size`` words may spread on either side; items under five words have to be nearly in one piece."""
    return max(STRIDE, size // 4) if size >= 5 else size // 2


def units_of(items: list[Item]) -> list[Unit]:
    out = []
    for i, item in enumerate(items):
        n = len(item.words)
        out.append(Unit(i, item.words, item.answer, n + 2 * slack(n), math.ceil(LCS_WITH_ANSWER * n - 1e-9)))
    for i, item in enumerate(items):
        if (last := len(item.words) - PASSAGE) > 0:
            for at in sorted({*range(0, last + 1, PASSAGE_STEP), last}):
                out.append(Unit(i, item.words[at : at + PASSAGE], None, PASSAGE + 2 * slack(PASSAGE), math.ceil(LCS * PASSAGE - 1e-9)))
    return out


def group_units(units: list[Unit], known: Vocabulary, idf: np.ndarray) -> list[Group]:
    groups = []
    for first in range(0, len(units), GROUP):
        pairs, asked = [], []
        for u, unit in enumerate(units[first : first + GROUP]):
            n, term = len(unit.words), known.terms(np.array(unit.words, np.uint64))
            terms, times = np.unique(term, return_counts=True)
            order = np.argsort(-idf[terms], kind="stable")
            held = np.cumsum(times[order])
            size = int(np.searchsorted(held, n - unit.need + min(max(1, math.ceil(ASKED * n)), unit.need))) + 1
            asked.append(int(held[size - 1]) - (n - unit.need))
            pairs += [(int(t), u) for t in terms[order[:size]]]
        pairs = np.array(sorted(pairs))
        groups.append(Group(first, np.searchsorted(pairs[:, 0], np.arange(len(idf) + 1)), pairs[:, 1].astype(np.uint16), np.array(asked), np.array([u.reach for u in units[first : first + GROUP]])))
    return groups


def build_index(items: list[Item], latent: Latent) -> Index:
    rows, begin = [], [0]
    for item in items:
        term = latent.known.terms(np.array(item.words, np.uint64))
        last = max(len(term) - WINDOW, 0)
        for at in sorted({*range(0, last + 1, CHUNK_STEP), last}):
            piece = term[at : at + WINDOW]
            rows.append(np.concatenate((piece, np.full(WINDOW - len(piece), -1))))
        begin.append(len(rows))
    units = units_of(items)
    return Index(latent, items, latent.vectors(np.array(rows)), np.array(begin), units, group_units(units, latent.known, latent.idf))


def common_subsequence(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel; ``masks`` has the places of each of the item's words."""
    ones = (1 << size) - 1
    row = ones
    for w in words:
        if m := masks.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & ones
    return size - row.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def stretches(term: np.ndarray, bounds: np.ndarray, group: Group) -> Iterator[tuple[int, int, int, int]]:
    """(unit, text, start, end) of all stretches that may hold a match: every run of a unit's ``reach`` words with as many of its rarer words as asked lies in one."""
    at = np.flatnonzero(term >= 0)
    begin, count = group.begin[term[at]], group.begin[term[at] + 1] - group.begin[term[at]]
    place = np.repeat(at, count)
    unit = group.units[np.arange(len(place)) + np.repeat(begin - np.cumsum(count) + count, count)]
    order = np.argsort(unit, kind="stable")
    place, unit = place[order], unit[order]
    # the asked-th word from each on: of the same unit, in reach, in the same text
    one = np.flatnonzero(np.arange(len(unit)) + group.asked[unit] - 1 < len(unit))
    other = one + group.asked[unit[one]] - 1
    fits = (unit[one] == unit[other]) & (place[other] - place[one] < group.reach[unit[one]])
    one, other = one[fits], other[fits]
    text = np.searchsorted(bounds, place[one], "right") - 1
    fits = place[other] < bounds[text + 1]
    one, other, text = one[fits], other[fits], text[fits]
    if not len(one):
        return
    unit, reach = unit[one].astype(np.int64), group.reach[unit[one]]
    start = np.maximum(bounds[text], place[other] - reach + 1)
    end = np.minimum(bounds[text + 1], place[one] + reach)
    # overlapping ones are joined, but not without end
    part = place[one] // (4 * reach)
    new = np.flatnonzero(np.concatenate(([True], (unit[1:] != unit[:-1]) | (text[1:] != text[:-1]) | (part[1:] != part[:-1]) | (start[1:] > end[:-1]))))
    last = np.concatenate((new[1:], [len(one)])) - 1
    yield from zip((unit[new] + group.first).tolist(), text[new].tolist(), start[new].tolist(), end[last].tolist(), strict=True)


def confirm(unit: Unit, masks: dict[int, int], answer: dict[int, int], words: list[int]) -> tuple[float, int, int] | None:
    """(ratio, start, end) of the best match of the unit in a stretch of words, or None."""
    n = len(unit.words)

    def holds(common: int, some: list[int]) -> bool:
        return common >= LCS * n or (unit.answer is not None and common >= LCS_WITH_ANSWER * n and common_subsequence(answer, len(unit.answer), some) == len(unit.answer))

    most = common_subsequence(masks, n, words)
    if not holds(most, words):
        return None
    # long items are tried at every n/32-th word, over as many words more
    step = max(1, n // 32)
    size = unit.reach + step - 1
    best = None
    for a in range(0, max(len(words) - size, 0) + step, step):
        some = words[a : a + size]
        common = common_subsequence(masks, n, some)
        if (best is None or common > best[0]) and holds(common, some):
            best = common, a, min(a + size, len(words))
            if common == most:
                break
    if best is None:
        return None
    common, a, b = best
    lo, hi = a, b - 1  # the last start that keeps all
    while lo < hi:
        mid = (lo + hi + 1) // 2
        some = words[mid:b]
        if common_subsequence(masks, n, some) == common and holds(common, some):
            lo = mid
        else:
            hi = mid - 1
    return common / n, lo, b


def shared_words(unit: Counter, words: list[int]) -> int:
    """Words in common, repeats counted: no common subsequence is longer."""
    return sum(min(n, unit[w]) for w, n in Counter(words).items() if w in unit)


def find(column: pa.Array, index: Index, once: bool = False) -> list[tuple[int, int, float, float, str, int, int]]:
    """(row, item_id, lcs, cosine, by, start word, end word) of every confirmed match in a text column; with ``once``, of one match in each row at least.

    ``by`` tells what made it a candidate: the cosine, or else the words in common.
    """
    masks = [_masks(u.words) for u in index.units]
    answers = [_masks(u.answer or []) for u in index.units]
    counts = [Counter(u.words) for u in index.units]
    item_of = np.array([u.item for u in index.units], np.int64)
    found: list[tuple[int, int, float, float, str, int, int]] = []
    for first, hashed, bounds in word_chunks(column):
        term = index.latent.known.terms(hashed)
        whole: set[tuple[int, int]] = set()
        for group in index.groups:
            may = list(stretches(term, bounds, group))
            if not may:
                continue
            places = np.array(may, np.int64)
            cosine = index.cosines(item_of[places[:, 0]], places[:, 2], places[:, 3], term)
            for (u, text, start, end), near in zip(may, cosine.tolist(), strict=True):
                unit = index.units[u]
                if (0 if once else unit.item, text) in whole:  # found already, with all its words
                    continue
                words = hashed[start:end].tolist()
                if near < COSINE and shared_words(counts[u], words) < unit.need:
                    continue
                if match := confirm(unit, masks[u], answers[u], words):
                    ratio, a, b = match
                    if once or ratio == 1:
                        whole.add((0 if once else unit.item, text))
                    lo = int(bounds[text])
                    found.append((first + text, index.items[unit.item].item_id, ratio, near, "cosine" if near >= COSINE else "words", start + a - lo, start + b - lo))
    return found


def _search(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = find(batch.column(1), index)
        kinds = (pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), *(pa.array([f[k] for f in found], t) for k, t in enumerate(kinds, 1))],
            ["doc_id", "item_id", "lcs", "cosine", "by", "start_word", "end_word"],
        )


def _clean(batches: Iterator[pa.RecordBatch], index: Index, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        keep[[f[0] for f in find(batch.column(at), index, once=True)]] = False
        yield batch.filter(pa.array(keep))


FOUND = "doc_id long, item_id long, lcs double, cosine double, by string, start_word long, end_word long"


def fit(texts: DataFrame, known: Vocabulary, rank: int = RANK, seed: int = 5) -> Latent | None:
    """The latent space of the benchmark's words over all ``texts`` (one text column); None without common words."""
    counted = arrow_map(texts, lambda it: _count(it, known), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts = dict(zip(counted["term"].to_pylist(), counted["n"].to_pylist(), strict=True))
    total = counts.pop(-1, 0)
    if not counts:
        return None
    df = np.array([counts.get(t, 0) for t in range(len(known))])
    idf = np.log((1 + total) / (1 + df)) + 1e-3
    random = np.random.default_rng(seed).normal(size=(len(idf), min(rank + OVERSAMPLE, len(idf))))
    wide = random.shape[1]
    schema = "term int, " + ", ".join(f"c{j} double" for j in range(wide))
    parts = arrow_map(texts, lambda it: _sketch(it, known, idf, random), schema).groupBy("term").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(wide))).toArrow()
    product = np.zeros_like(random)
    product[parts["term"].to_numpy()] = np.column_stack([parts[f"c{j}"].to_numpy() for j in range(wide)])
    vectors, values = decompose(product, random, rank)
    keep = values > 1e-6 * max(values.max(initial=0), 1e-300)
    mapping = (idf[:, None] * vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    return Latent(known, idf, np.vstack((mapping, np.zeros((1, mapping.shape[1]), np.float32))))


def blocks(benchmark: DataFrame, size: int = BLOCK, answer_col: str | None = None) -> Iterator[list[Item]]:
    """The benchmark in blocks of about ``size`` items, by a hash of their ids and texts; each is collected on its own."""
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"), answer.alias("answer"))
    n = -(-rows.count() // size)
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield read_items(sorted(((r[0], r[1], r[2]) for r in part.collect()), key=str))


def indexes(texts: DataFrame, benchmark: DataFrame, size: int = BLOCK, answer_col: str | None = None) -> Iterator[Index]:
    """The search index of each block: one vocabulary and one latent space for all. The driver holds the benchmark's distinct words and the items of one block."""
    known = np.zeros(0, np.uint64)
    for items in blocks(benchmark, size, answer_col):
        known = np.union1d(known, words_of_items(items))
    if len(known) and (latent := fit(texts, Vocabulary(known))):
        yield from (build_index(items, latent) for items in blocks(benchmark, size, answer_col) if items)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", answer_col: str | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, lcs, cosine, by, start_word, end_word): one row for each document and benchmark item found in it.

    All documents and their whole texts are searched. Null and empty texts hold nothing; null and empty items and
    items without a word are never found. Rows that repeat a document id are one document, repeated items one
    item; of several matches the longest counts, of equal ones the one with the higher cosine. Documents or items
    with a null id are reported with a null id. Other columns are not read. An empty table on
    either side gives an empty result. The place is in words, counted from the text's start. ``lcs`` is the
    share of the item, or of a passage of a long item, whichever is found better.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hits = []
    for index in indexes(rows.select("text"), benchmark, block, answer_col):
        shared = spark.sparkContext.broadcast(index)
        hits.append(arrow_map(rows, lambda it, s=shared: _search(it, s.value), FOUND))
    found = functools.reduce(DataFrame.unionByName, hits) if hits else spark.createDataFrame([], FOUND)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs", "cosine", "by", "start_word", "end_word")).alias("b"))
    return best.select("doc_id", "item_id", "b.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` without the rows in whose text a benchmark item was found; the rows are filtered where they are searched.

    Null and empty texts stay, repeated rows stay or go together, ids play no part, and all columns are kept as they
    are. Without items everything stays; an empty table stays empty.
    """
    texts, at = docs.select(F.col(text_col).cast("string").alias("text")), docs.columns.index(text_col)
    for index in indexes(texts, benchmark, block):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = arrow_map(docs, lambda it, s=shared: _clean(it, s.value, at), docs.schema)
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
