"""Operator 12 - importance resampling towards a target distribution, over hashed n-grams.

Words are maximal runs of digits, letters a-z (after A-Z are lower-cased) and code points beyond
ASCII.  A document's features are all runs of 1 to 3 consecutive words, repeats counted; a feature's
bucket is the crc32 of its UTF-8 bytes modulo ``BUCKETS``.

1. The *position table* has a row for each word of each document: words are posexploded, ``lead()`` over
   the document gives the next two, and the three concatenations are hashed to three buckets.  Texts
   are shuffled once, by document; the window needs no further shuffle and its order is the one in
   which words come.
2. Buckets are counted over all documents and over the target (at most ``BUCKETS`` rows each), which
   gives each bucket a gain: the log ratio of its smoothed shares.
3. The gains, a table with that bound, are joined to the position table and summed up by document.
4. A seeded Gumbel value by document id is added to the weight; of the documents with enough words
   the ``percent`` highest are drawn, which draws without replacement in proportion to exp(weight).
   Ranks come from ranges of the order (``operators/ranking.py``).

Defined cases: null, empty and blank texts have no features, weight 0 and are never drawn; a null
doc_id is hashed as the empty string and comes before all others; rows are told apart by the row, so
repeated rows each have a result, and equal rows take neighbouring ranks; documents with one id and
equal score are ordered by number of features, then weight; an empty target leaves T = t = 0; an empty table gives an
empty result; further columns are ignored.  A text is one row and has to fit a task: splitting takes
about ten bytes a byte of text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.ranking import ordered_starts
from .cases import free, known, lower_ascii, shown
from .scratch import Scratch

BUCKETS, SEED, PERCENT, MIN_WORDS = 10_000, 42, 5, 20
ORDERS = ("one", "two", "three")
#: What separates words, before A-Z are lower-cased.
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _bucket(feature: Column) -> Column:
    return (F.crc32(feature.cast("binary")) % BUCKETS).cast("short")


def position_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, th, one, two, three): a row for each word with the buckets of the runs that start there.

    A run that the text is too short for is null; a text without words has one row of nulls.  ``row``
    numbers the rows of ``docs`` and is only fixed once the table is written.
    """
    # Equal rows are dealt out by the partition they are read from, so that they do not meet in one task.
    rows = (docs.select(known(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .withColumns({"th": F.xxhash64("text"), "part": F.spark_partition_id()}).repartition("id", "th", "part")
            .withColumn("row", F.monotonically_increasing_id()))
    words = rows.select("row", "id", "th", "part", F.posexplode(F.split("text", _GAPS))).withColumn("w", lower_ascii(F.col("col")))
    document = Window.partitionBy("row", "id", "th", "part").orderBy("pos")
    # Only the first and the last part of a split can be empty.
    following = words.select("row", "id", "th", F.nullif("w", F.lit("")).alias("w"), *(F.nullif(F.lead("w", k).over(document), F.lit("")).alias(f"w{k}") for k in (1, 2)))
    return following.select("row", "id", "th", _bucket(F.col("w")).alias("one"), _bucket(F.concat("w", F.lit(" "), "w1")).alias("two"),
                            _bucket(F.concat("w", F.lit(" "), "w1", F.lit(" "), "w2")).alias("three"))


def _features(positions: DataFrame, *keep: str) -> DataFrame:
    """(keep..., order, bucket): a row for each word and order, null buckets included."""
    return positions.unpivot(list(keep), list(ORDERS), "order", "bucket")


def _counts(positions: DataFrame, name: str) -> DataFrame:
    return _features(positions).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias(name))


def gains(source: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) for the buckets of ``source``, from the (bucket, s) and (bucket, t) counts."""
    totals = [counts.agg(F.sum(name)).first()[0] or 0 for counts, name in ((source, "s"), (target, "t"))]
    S, T = (F.lit(float(x + BUCKETS)) for x in totals)
    t, s = F.coalesce(F.col("t"), F.lit(0)) + F.lit(1.0), F.col("s") + F.lit(1.0)
    return source.join(target, "bucket", "left").select("bucket", F.floor(1000 * F.ln((t * S) / (s * T))).alias("gain"))


def weigh(spark: SparkSession, docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", scratch: Scratch | None = None) -> DataFrame:
    """(id, th, n_words, n_features, weight), a row for each row of ``docs``."""
    scratch = scratch or Scratch(spark, "resampling")
    positions = scratch.save(position_table(docs, id_col, text_col), "positions")
    source = scratch.save(_counts(positions, "s"), "source", release=False)
    wanted = scratch.save(_counts(position_table(target, target_id, text_col), "t"), "target", release=False)
    # At most BUCKETS rows of two numbers, however large the corpus.
    gained = _features(positions, "row", "id", "th").join(F.broadcast(gains(source, wanted)), "bucket", "left")
    return gained.groupBy("row", "id", "th").agg(F.count_if((F.col("order") == ORDERS[0]) & F.col("bucket").isNotNull()).alias("n_words"), F.count("bucket").alias("n_features"),
                                                 F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight")).drop("row")


def _gumbel(seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(shown("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def draw(spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(id, th, n_words, n_features, weight, score, rank) for each row; ``rank`` is null for rows that are not drawn."""
    scratch = Scratch(spark, "resampling")
    scored = scratch.save(weigh(spark, docs, target, scratch=scratch).withColumn("score", F.col("weight") + _gumbel(seed)), "scored")
    scratch.drop("positions")
    enough = scored.where(F.col("n_words") >= min_words)
    drawn = enough.count() * percent // 100
    # Equal rows are one row with a number while they are ranked.
    equal = enough.groupBy(*scored.columns).agg(F.count("*").alias("times"))
    order = [F.desc("score"), F.asc("id"), F.asc("n_features"), F.asc("weight"), F.asc("th")]
    ranked = (ordered_starts(equal, scratch, order, "times", "before").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
              .withColumn("rank", F.col("before") + F.col("nth")).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))))
    return ranked.select(*scored.columns, "rank").unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their columns; of equal rows as many as are drawn (one of them stands for all)."""
    id_, th, times, nth = free(docs.columns, "_id", "_th", "_times", "_nth")
    taken = draw(spark, docs, target, percent, min_words, seed).where("rank IS NOT NULL").groupBy(F.col("id").alias(id_), F.col("th").alias(th)).agg(F.count("*").alias(times))
    keyed = docs.withColumns({id_: known("doc_id"), th: F.xxhash64(F.coalesce("text", F.lit("")))}).dropDuplicates([id_, th])
    return keyed.join(taken, [id_, th]).withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)


def resampling_digest(spark: SparkSession, docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row, as drawn in production."""
    return draw(spark, docs, target).select(shown("id").alias("doc_id"), "n_features", "weight", "score", "rank")
