"""Operator 13 - spelling variants: words one edit apart, each led to a far more frequent form.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased.  Those of at least
``MIN_LETTERS`` letters that come ``MIN_COUNT`` times or more over all texts are compared.

1. Every word has a bit mask of letter parities: which letters come an odd number of times (the xor of
   the letters' bits).  One inserted, deleted or replaced letter flips at most two bits.
2. The mask is split into three bands, letters being dealt to bands by how often they come, so that
   bands are about equally telling.  Of three bands two flips leave one equal, so near words meet in
   a join on an equal band with a length that differs by one at most.
3. A band alone is a large group in a large vocabulary.  One edit also leaves the first or the second
   half of a word (counted in the shorter word's length) as it was, so the half is part of the join
   key; that loses no pair and keeps groups small.
4. A pair is taken where it meets first, its masks must differ in two bits at most, and the edit
   distance is verified.
5. A word's form is the most frequent near word if that is ``TIMES`` as frequent; forms are followed to
   the last by pointer doubling.  Counts grow fivefold with each step, so no chain is longer than 27.

For measuring, ``noise`` deletes a letter of one run in so many, chosen by a hash of document and run.

Defined cases: null, empty and blank texts have no words; a null doc_id is hashed as the empty string;
repeated rows and rows of one id count one by one; ties of frequency go to the smaller word in
code-point order; text in a task is one row at a time, split into its runs, about ten bytes a byte of text; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .cases import lower_ascii
from .scratch import Scratch

MIN_LETTERS, MIN_COUNT, TIMES, NOISE, BANDS = 6, 5, 5, 199, 3
#: A letter of a run; a class of what is not a letter took seven times as long.
_LETTER = "[A-Za-zÀ-ÿ]"
#: 2 to this power is more than the longest chain of forms.
DOUBLINGS = 5


def word_counts(docs: DataFrame, noise: int | None = NOISE, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) over all texts, counted in the tasks before the shuffle."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(f"{_LETTER}{{{min_letters},}}"), F.lit(0))).alias("run"))
    word = F.col("run")
    # Whole runs are found, as a match takes all letters that follow; shorter runs cannot give a word, whatever is deleted.
    runs = runs.withColumn("run", lower_ascii(F.col("run")))
    if noise:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = F.pmod("h", F.length("run")).cast("int")
        word = F.when(F.col("h") % noise == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def parity_masks(words: DataFrame) -> DataFrame:
    """(word, n, m0, m1, m2): the parity mask of each word in three bands of at most 31 letters."""
    letters = words.select("word", "n", F.explode(F.split("word", "")).alias("letter")).where("letter <> ''")
    # One row for each letter of the alphabet: 90 at most.
    order = [r["letter"] for r in letters.groupBy("letter").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "letter").collect()]
    bits = words.sparkSession.createDataFrame([(c, i % BANDS, 1 << (i // BANDS)) for i, c in enumerate(order)], "letter string, band int, bit int")
    mask = [F.bit_xor(F.when(F.col("band") == b, F.col("bit")).otherwise(0)).alias(f"m{b}") for b in range(BANDS)]
    return letters.join(F.broadcast(bits), "letter").groupBy("word", "n").agg(*mask)


def _halves(masked: DataFrame, shorter: Column) -> DataFrame:
    """A row for each band and half of each word, as one of two words of which the shorter has so many letters."""
    cut = F.floor(shorter / 2).cast("int")
    halves = F.array(F.substring("word", F.lit(1), cut), F.substring("word", F.length("word") - (shorter - cut) + 1, shorter - cut))
    keyed = masked.withColumns({"shorter": shorter, "cut": cut}).select("*", F.posexplode(halves).alias("side", "half"))
    return keyed.select("*", F.posexplode(F.array(*(f"m{b}" for b in range(BANDS)))).alias("band", "value"))


def near_pairs(masked: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of words at edit distance one, each once."""
    own = F.length("word")
    left = _halves(masked, own)
    right = left.unionByName(_halves(masked, own - 1))
    a, b = left.alias("a"), right.alias("b")
    c = F.col
    differs = [c(f"a.m{i}") != c(f"b.m{i}") for i in range(BANDS)]
    first_band = (c("a.band") == 0) | ((c("a.band") == 1) & differs[0]) | ((c("a.band") == 2) & differs[0] & differs[1])
    first_side = (c("a.side") == 0) | (F.substring(c("a.word"), F.lit(1), c("a.cut")) != F.substring(c("b.word"), F.lit(1), c("a.cut")))
    flips = sum((F.bit_count(c(f"a.m{i}").bitwiseXOR(c(f"b.m{i}"))) for i in range(1, BANDS)), F.bit_count(c("a.m0").bitwiseXOR(c("b.m0"))))
    # ``shorter`` is the length of a, and that of b or one less: the length filter.
    lengths = (F.length("b.word") > F.length("a.word")) | (c("a.word") < c("b.word"))
    met = [c(f"a.{k}") == c(f"b.{k}") for k in ("band", "value", "side", "half", "shorter")]
    on = met[0]
    for x in (*met[1:], lengths, flips <= 2, first_band, first_side, F.levenshtein(c("a.word"), c("b.word"), 1) == 1):
        on = on & x
    # The optimiser knows nothing of the expansion and would broadcast: both sides are shuffled.
    return a.join(b.hint("merge"), on).select(c("a.word").alias("a"), c("a.n").alias("n_a"), c("b.word").alias("b"), c("b.n").alias("n_b"))


def _roots(formed: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) for each word that has a form: each round doubles how far forms are followed."""
    hops = scratch.save(formed.select("word", F.col("form").alias("root")), "roots-0", release=False)
    for k in range(DOUBLINGS):
        further = hops.select(F.col("word").alias("via"), F.col("root").alias("last"))
        joined = hops.join(further, hops["root"] == further["via"], "left")
        if joined.where("via IS NOT NULL").isEmpty():
            break
        hops = scratch.save(joined.select("word", F.coalesce("last", "root").alias("root")), f"roots-{k + 1}", release=False)
    return hops


def spelling_forms(spark: SparkSession, docs: DataFrame, noise: int | None = NOISE, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the corpus."""
    scratch = Scratch(spark, "spelling")
    words = scratch.save(word_counts(docs, noise, min_letters, min_count), "words")
    pairs = scratch.save(near_pairs(scratch.save(parity_masks(words), "masks")), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("low"), "near")).alias("best"))
    enough = -F.col("best.low") >= times * F.col("n")
    near = scratch.save(best.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.low")).alias("form_n")), "near")
    roots = _roots(near.where("form IS NOT NULL"), scratch)
    return (words.join(near, "word", "left").join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"))
