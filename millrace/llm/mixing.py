"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

1. Size every document in words and every source in total words.
2. Water-filling: every source gets ``weight * level`` words; sources whose share exceeds ``max_epochs`` times
   their size are clamped there, and the level rises so that the others share the excess in proportion to
   their weights. Only two sums travel to the driver in each round.
3. Every document of a source is taken ``quota // source_size`` whole times. The rest of the quota goes, in
   order of a seeded hash, to further repetitions of documents; the one at the border is taken in part, so
   that a source's taken words equal its rounded target.

The border of a source is found without sorting the source: words are first summed by source and hash prefix
(4096 cells), the cell in which the border lies is refined by a longer prefix, and only the documents of one
cell of a cell are put in order. That makes the work per task independent of a source's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, Stage, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hex digits of the hash that each of the two histogram levels adds (4096 cells each).
CELL = 3


def _draw(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))).cast("binary"))


def _words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def word_counts(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), _words(F.col(text_col)).alias("size")).withColumn("draw", _draw(F.col("doc_id"), seed))


def source_targets(sizes: DataFrame, stage: Stage, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target): ``sizes`` has columns source and size.

    Sources in code point order (null last) take the weights in turn. They are numbered by ranges, a range in a
    task; only the number of sources of each range meets in one place. Sums alone come to the driver.
    """
    named = (F.col("source").isNull(), F.col("source"))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = stage.keep(per.repartitionByRange(*named).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    offsets = per.groupBy("range").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("range", "before")
    nth = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*named)) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (nth % len(weights) + 1).cast("int")).cast("long")
    per = stage.keep(per.join(offsets, "range").select("source", "source_size", weight.alias("weight")), "weights")
    cap = F.col("source_size") * max_epochs
    total = per.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    spare, open_weight, clamped = total, None, -1
    while True:
        # a source is clamped when weight * spare / open_weight > cap, in whole numbers
        over = F.lit(False) if open_weight is None else (F.col("weight") * F.lit(spare).cast("decimal(38,0)") > cap * F.lit(open_weight).cast("decimal(38,0)"))
        w, held, n = per.agg(F.sum(F.when(~over, F.col("weight"))), F.sum(F.when(over, cap)), F.count(F.when(over, True))).first()
        if open_weight is not None and n == clamped:
            break
        spare, open_weight, clamped = total - (held or 0), (w or 0), n
        if not open_weight:
            over = F.lit(True)
            break
    share = (F.col("weight") * F.lit(spare)).cast("double") / F.lit(float(open_weight or 1))
    return per.withColumn("target", F.when(over, cap.cast("double")).otherwise(share))


def _same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def rules(sizes: DataFrame, stage: Stage, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """A row for each source: source_size, target, ``whole`` rounds, ``border`` (hash prefix up to which documents are taken once more) and ``border_words`` (left for that prefix)."""
    targets = stage.keep(source_targets(sizes, stage, weights, max_epochs), "targets")
    # quota = whole rounds of the source + words left for further repetitions
    quota = targets.withColumn("quota", F.floor(F.col("target") + 0.5).cast("long")).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0)).alias("whole"),
        F.when(F.col("source_size") > 0, F.expr("quota % source_size")).otherwise(F.lit(0)).alias("left"),
    )
    cells = sizes.groupBy("source", F.substring("draw", 1, CELL).alias("cell")).agg(F.sum("size").alias("words"))
    level1 = _border(cells.alias("c").join(quota.alias("q"), _same_source("c", "q")).select("c.source", "c.cell", "c.words", "q.left"))
    fine = (
        sizes.alias("s").join(level1.alias("b"), _same_source("s", "b") & F.col("s.draw").startswith(F.col("b.cell")))
        .groupBy("s.source", F.substring("s.draw", 1, 2 * CELL).alias("cell")).agg(F.sum("s.size").alias("words"), F.first("b.left").alias("left"))
    )
    level2 = stage.keep(_border(fine), "border")
    ruled = quota.alias("q").join(level2.alias("b"), _same_source("q", "b"), "left").select("q.*", F.col("b.cell").alias("border"), F.col("b.left").alias("border_words"))
    return stage.keep(ruled, "rule")


def _split(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose draw tells what is taken of them, with ``more`` (once more or not), and rows at the border, with the words of it ``before`` each.

    The border is a cell of a cell, so only few rows are put in order.
    """
    prefix = F.substring("draw", 1, 2 * CELL)
    plain = placed.where(F.col("border").isNull() | (prefix != F.col("border"))).withColumn("more", F.coalesce(prefix < F.col("border"), F.lit(False)))
    in_order = Window.partitionBy("source").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where(prefix == F.col("border"))
    return plain, edge.withColumn("before", F.sum("size").over(in_order))


def _extra() -> Column:
    return F.greatest(F.lit(0), F.least(F.col("size"), F.col("border_words") - F.coalesce("before", F.lit(0)))).cast("long")


def _repeats(extra: Column) -> Column:
    return (F.col("whole") + F.when((extra > 0) & (2 * extra >= F.col("size")), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, repeats.

    ``size`` counts maximal runs without ASCII white space (null and empty texts: 0 words; they take 0 words
    and are repeated as often as their source goes round whole); texts are counted whole, however long. ``taken`` is the number of words the mix takes
    of the document, repetitions counted, at most ``max_epochs * size``. ``repeats`` rounds it to whole copies
    for a mix that can't cut documents. The same seed gives the same mix whatever the partitioning. Rows that
    repeat an id draw the same hash; at a border they are ordered by size, and equal ones by chance of their
    order, which doesn't change the result as a set. A null source is a source of its own (listed last); null ids share
    one draw. Input columns other than the three named are not read. An empty table gives an empty result.
    """
    stage = Stage(docs.sparkSession, "mix")
    sizes = stage.keep(word_counts(docs, seed, id_col, text_col, source_col), "sizes")
    ruled = rules(sizes, stage, weights, max_epochs)
    placed = sizes.alias("s").join(ruled.alias("r"), _same_source("s", "r")).select("s.*", "r.source_size", "r.target", "r.whole", "r.border", "r.border_words")
    plain, edge = _split(placed)
    both = plain.withColumn("extra", F.when(F.col("more"), F.col("size")).otherwise(F.lit(0)).cast("long")).drop("more").unionByName(edge.withColumn("extra", _extra()).drop("before"))
    return both.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
        _repeats(F.col("extra")).alias("repeats"),
    )


def _border(cells: DataFrame) -> DataFrame:
    """Of (source, cell, words, left): per source the cell in which the running sum passes ``left``, and what is left for it.

    A source has at most 4096 cells here, whatever its size. Sources without a remainder have no row.
    """
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    run = cells.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    return run.where("before < left AND left <= before + words").select("source", "cell", (F.col("left") - F.col("before")).alias("left"))


def mixed_rows(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as mixed: every row as often as ``repeats`` of ``mix`` says, with its own columns unchanged, whatever their names.

    Each row is judged by its own draw and size where it stands, so rows that repeat an id or have none get their own
    number, and texts are not shuffled but for the few at a border. Rows without words are repeated as often as their
    source goes round whole. An empty table stays empty.
    """
    stage = Stage(docs.sparkSession, "mix")
    ruled = rules(stage.keep(word_counts(docs, seed, id_col, text_col, source_col), "sizes"), stage, weights, max_epochs)
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), _draw(F.col(id_col), seed).alias("draw"))
    placed = own.alias("s").join(ruled.alias("r"), _same_source("s", "r")).select("s.*", "r.whole", "r.border", "r.border_words")
    # only rows at a border need their size again; of the others it matters whether they have a word at all
    plain, edge = _split(placed.withColumn("size", F.when(F.col("border") == F.substring("draw", 1, 2 * CELL), _words(F.col("text")))))
    plain = plain.select("row", (F.col("whole") + (F.col("more") & F.coalesce(F.col("text").rlike(WORD), F.lit(False))).cast("int")).cast("int").alias("repeats"))
    edge = edge.select("row", _repeats(_extra()).alias("repeats"))
    counted = plain.unionByName(edge).where("repeats > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("nth")).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS draw
  FROM documents
), p AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source
), w AS (
  SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight,
         sum(source_size) OVER ()::BIGINT AS total
  FROM p
), r AS (  -- sources by the level at which they reach their cap; what is clamped before each
  SELECT *, coalesce(sum(3 * source_size) OVER o, 0)::BIGINT AS held, coalesce(sum(weight) OVER o, 0)::BIGINT AS gone, sum(weight) OVER ()::BIGINT AS weights
  FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lv AS (  -- the first source that stays below its cap sets the level
  SELECT total - held AS spare, weights - gone AS open_weight FROM r
  WHERE weight * (total - held) <= 3 * source_size * (weights - gone) ORDER BY source_size / weight, source NULLS LAST LIMIT 1
), t AS (
  SELECT w.*, CASE WHEN weight * spare > 3 * source_size * open_weight THEN (3 * source_size)::DOUBLE
                   ELSE (weight * spare)::DOUBLE / open_weight::DOUBLE END AS target
  FROM w, lv
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole,
            CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT % source_size ELSE 0 END AS rest
  FROM t
), c AS (
  SELECT s.doc_id, s.size, q.source_size, q.target, q.whole, q.rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM c
"""
