"""Near-duplicate documents by MinHash with tensored banding, verified on whole shingle sets.

Two small collections of ``m`` MinHash groups (``ROWS`` minima each) are computed per document. Every pair
(i, j) of a group of the first and a group of the second collection is a table, and (i, j, group i, group j)
is the document's key in it: ``m * m`` tables from ``2 * m`` groups, so the hashing work is about the square
root of what as many independent tables need. Two documents meet when some group of each collection agrees.

Steps:
1. One Arrow pass over the texts: size, 128-bit cryptographic digest and groups of each document's whole shingle set.
2. Documents with equal sets become one class with its smallest id as representative.
3. Groups that no other class has are left out; keys are formed by pairs of the groups that are left.
4. Every table bucket compares its members with its smallest member only (a star, not all pairs).
5. After the components of the verified links, buckets whose other members still lie in several components, among
   members of about the same size, are finished: each member outside its bucket's largest component is compared
   with all members of other components that an exact prefix filter leaves (see ``prefix_pairs``). No possible
   link between two components of a bucket stays untested, so none is lost to the star.
6. Every comparison is exact, on the two whole sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import tokens
from millrace.llm.common import Stage, arrow_map, maybe_in, spread_join, table, without
from millrace.llm.components import connected_components

WIDTH = 5
ROWS = 3
#: Chance to miss a pair that is exactly at the threshold.
MISS = 1e-4
PERCENT = 85


def groups_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Groups per collection so that a pair at the threshold is missed with a chance of at most ``miss``."""
    return math.ceil(math.log(miss / 2) / math.log(1 - (percent / 100) ** rows))


def _ascii_lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def signatures(batches: Iterator[pa.RecordBatch], width: int, groups: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n_shingles, digest, bands): digest and 2 * ``groups`` MinHash groups of the whole set."""
    hashes = 2 * groups * ROWS
    factors = tokens.mix(np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    for batch in batches:
        n = batch.num_rows
        sizes, digests = np.zeros(n, np.int64), []
        bands = np.zeros((n, 2 * groups), np.uint64)
        for at, data, offsets in tokens.chunks(batch.column(1)):
            hashed, _, _, bounds = tokens.words(_ascii_lower(data), offsets)
            sets = list(tokens.shingles(hashed, bounds, width))
            digests += [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            size = np.array([len(s) for s in sets], np.int64)
            sizes[at : at + len(sets)] = size
            full = np.flatnonzero(size)
            if not len(full):
                continue
            scrambled = tokens.mix(np.concatenate(sets))
            begin = (np.cumsum(size) - size)[full]
            minima = np.empty((len(full), hashes), np.uint64)
            for k in range(hashes):
                minima[:, k] = np.minimum.reduceat(scrambled * factors[k], begin)
            minima = tokens.mix(minima).reshape(len(full), 2 * groups, ROWS)
            banded = minima[:, :, 0]
            for r in range(1, ROWS):
                banded = tokens.mix(banded * np.uint64(0x2545F4914F6CDD1D) + minima[:, :, r])
            bands[at + full] = banded
        flat = pa.array(bands.reshape(-1).view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (2 * groups)), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(digests, pa.binary()), lists], ["doc_id", "n_shingles", "digest", "bands"])


def shingle_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, shingles): the whole sorted set, a record batch for each chunk of texts."""
    for batch in batches:
        for at, data, offsets in tokens.chunks(batch.column(1)):
            hashed, _, _, bounds = tokens.words(_ascii_lower(data), offsets)
            sets = list(tokens.shingles(hashed, bounds, width))
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), lists], ["doc_id", "shingles"])


def _common(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, set a, set b) to the pairs (a, b) that reach the threshold on their whole sets."""
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        keep = []
        for i in range(batch.num_rows):
            x, y = left[i].values.to_numpy(zero_copy_only=False), right[i].values.to_numpy(zero_copy_only=False)
            shared = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
            keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a stage table whose sets reach the threshold. Pairs of a hot member (a bucket's hub) are dealt to several tasks, each of which gets its set once."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    met = spread_join(pairs.select("a", "b"), one, "a", "b").join(two, "b").select("a", "b", "left", "right")
    return arrow_map(met, lambda it: _common(it, percent), "a long, b long").distinct()


def keys_of(able: DataFrame, groups: int, stage: Stage) -> DataFrame:
    """(key, rep, n): the keys of classes (rep, n, bands) in all tables, from pairs of groups that some other class has too."""
    grouped = able.select("rep", "n", F.posexplode("bands").alias("g", "x"))
    shared = grouped.groupBy("g", "x").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("g", "x")
    live = stage.keep(grouped.join(shared, ["g", "x"]).groupBy("rep", "n").agg(F.collect_list(F.struct("g", "x")).alias("live")), "live")
    first = live.select("rep", "n", "live", F.explode(F.filter("live", lambda e: e["g"] < groups)).alias("p"))
    both = first.select("rep", "n", "p", F.explode(F.filter("live", lambda e: e["g"] >= groups)).alias("q"))
    return both.select(F.xxhash64("p.g", "q.g", "p.x", "q.x").alias("key"), "rep", "n")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are maximal runs outside ASCII white space of the text with A-Z in lower case; a set holds the
    distinct ``width``-word shingles, or the whole sequence of a shorter text. Documents are linked when
    100 * intersection >= ``percent`` * union; component_id is the smallest id reachable. Null and empty texts
    and texts without words have an empty set and are linked with nothing. Texts are taken whole, however long.
    Rows with a null id keep a null component_id, are linked with nothing and are kept. Rows that repeat an id
    are one document: their links add up, and they are kept or dropped together. Columns other than the two are
    not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "near-dedup")
    groups = groups_for(percent)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = stage.keep(arrow_map(texts, lambda it: signatures(it, width, groups), "doc_id long, n_shingles long, digest binary, bands array<long>"), "signed")

    # classes of equal sets; sets too small to have a different partner at the threshold have no keys
    classes = stage.keep(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands")),
        "classes",
    )
    able = classes.where(100 * F.col("n") >= percent * (F.col("n") + 1))
    keys = keys_of(able, groups, stage)
    stars = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("far")).where("hub < far").select("key", "hub")
    members = stage.keep(keys.join(stars, "key"), "members")

    sizes = able.groupBy(F.col("rep").alias("id")).agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"))
    tested = stage.keep(_near_in_size(members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), sizes, percent), "tested")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = arrow_map(maybe_in(texts, wanted), lambda it: shingle_sets(it, width), "doc_id long, shingles array<long>")
    sets = stage.keep(sets.join(wanted, "doc_id", "left_semi"), "sets")
    links = stage.keep(verified(tested, sets, percent), "links")
    labels = connected_components(links, stage)

    # buckets whose members beside the hub (which has met all) still lie in several components, at sizes that allow a link
    step = math.log(100 / percent)
    band = F.floor(F.log("n") / step).cast("int")
    others = members.where("rep <> hub").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"), F.explode(F.array(band, band + 1)).alias("band"))
    others = stage.keep(others, "others")
    mixed = others.groupBy("key", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "band")
    open_members = stage.keep(others.join(mixed, ["key", "band"]), "open")
    if not open_members.isEmpty():
        largest = open_members.groupBy("key", "band", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key", "band").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
        minor = open_members.join(largest, ["key", "band"]).where("comp <> main").select("rep").distinct().withColumn("minor", F.lit(True))
        in_open = open_members.select("rep", "comp").distinct().join(minor, "rep", "left")
        cross = stage.keep(prefix_pairs(in_open, sets, percent, stage).join(tested.select("a", "b"), ["a", "b"], "left_anti"), "cross")
        more = stage.keep(verified(cross, sets, percent), "links")
        if not more.isEmpty():
            labels = connected_components(links.unionByName(more), stage)
        stage.drop(cross, more)
    stage.drop(members, tested, sets, links, others, open_members)

    # a class whose representative id is also another class's stands for the same document
    found = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    with_set = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "digest").join(found, "digest").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_set.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: Sizes that differ by less than this factor share a class.
SIZE_STEP = 1.02


def _size_class(n: Column) -> Column:
    return F.floor(F.log(F.greatest(n, F.lit(1))) / math.log(SIZE_STEP)).cast("int")


def prefix_pairs(docs: DataFrame, sets: DataFrame, percent: int, stage: Stage) -> DataFrame:
    """Pairs (a, b) of ``docs`` (rep, comp, minor) that can reach the threshold: one of them minor, in different components.

    An exact prefix filter, with no chance to miss. Shingles of each set are put in the order of how many of the
    documents have them, rare ones first. Two sets that reach the threshold have their first common shingle early
    in both, as early as their two sizes demand; so each set only offers its first shingles, fewer for partners of
    about its own size, and offers meet by (shingle, size class, size class). Distant copies of one text have their
    own rare shingles first and hardly meet, whatever the size of their group.
    """
    own = sets.join(docs.withColumnRenamed("rep", "doc_id"), "doc_id").select("doc_id", "comp", F.coalesce("minor", F.lit(False)).alias("minor"), F.size("shingles").alias("n"), F.xxhash64("shingles").alias("set"), "shingles")
    # repeated rows are one set, or each of its shingles would take several places in the order
    own = stage.keep(own.dropDuplicates(["doc_id", "set"]).withColumn("s", F.explode("shingles")).drop("shingles"), "shingles")
    held = own.groupBy("s").agg(F.count(F.lit(1)).alias("held"))
    order = Window.partitionBy("doc_id", "set").orderBy("held", "s")
    ranked = own.join(held, "s").withColumn("i", F.row_number().over(order) - 1)
    # a shingle that one document has takes its place in the order but can't meet another; the smallest partner has
    # percent / 100 of the size
    early = ranked.where("held > 1").where((100 + percent) * 100 * (F.col("n") - F.col("i")) >= percent * (100 + percent) * F.col("n"))
    early = stage.keep(early.select("doc_id", "comp", "minor", "n", "s", "i"), "early")
    # a shingle that only one component offers joins nothing
    between = early.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("minor").alias("some_minor")).where("lo < hi AND some_minor").select("s")
    early = early.join(between, "s")
    spread = F.filter(
        F.sequence(_size_class(F.col("n") * percent / 100) - 1, _size_class(F.col("n") * 100 / percent) + 1),
        lambda c: (100 + percent) * (F.col("n") - F.col("i")) >= percent * (F.col("n") + F.floor(F.pow(F.lit(SIZE_STEP), c)) - 1),
    )
    offers = stage.keep(early.select("doc_id", "comp", "minor", "n", "s", "i", _size_class(F.col("n")).alias("own"), F.explode(spread).alias("other")), "offers")
    one = offers.where("minor").select("s", "own", "other", F.col("doc_id").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"), F.col("i").alias("ix"))
    two = offers.select("s", F.col("other").alias("own"), F.col("own").alias("other"), F.col("doc_id").alias("y"), F.col("comp").alias("cy"), F.col("n").alias("ny"), F.col("i").alias("iy"))
    enough = (100 + percent) * F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy")) >= percent * (F.col("nx") + F.col("ny"))
    met = one.join(two, ["s", "own", "other"]).where((F.col("cx") != F.col("cy")) & enough)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _near_in_size(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes alone don't rule the threshold out."""
    a = sizes.select(F.col("id").alias("a"), F.col("n_min").alias("a_min"), F.col("n_max").alias("a_max"))
    b = sizes.select(F.col("id").alias("b"), F.col("n_min").alias("b_min"), F.col("n_max").alias("b_max"))
    near = (100 * F.col("a_max") >= percent * F.col("b_min")) & (100 * F.col("b_max") >= percent * F.col("a_min"))
    return pairs.join(a, "a").join(b, "b").where(near).select("a", "b")


def keep_one(docs: DataFrame, percent: int = 80, **options) -> DataFrame:
    """``docs`` without the near copies: of every group the document with the smallest id stays.

    Null ids, texts without words and unlinked documents stay; rows that repeat an id stay or go together. An
    empty table stays empty.
    """
    id_col = options.get("id_col", "doc_id")
    gone = near_duplicates(docs, percent, **options).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"))
    return without(rows, gone).select("row.*")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (
  SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x
), k AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(k.y, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(k.y, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.x = d.doc_id
"""
