"""Spelling variants by anagram hashing: words that one inserted, deleted or replaced letter tells apart.

A word's anagram value is the sum over its letters of the code point to the fifth power, modulo 2^61 - 1; letter order leaves it unchanged.
Two words one letter apart have values that differ by one letter's power (addition, removal) or by two letters'
difference (exchange). Each word states its value and its value less each of its letters, so all three are equal keys: a
removal meets a whole word, an exchange meets another removal. One edit also leaves the front half or the back half
of what the words share in place, so a half joins the key, which keeps the many words of equal letters apart. What
meets is verified by its letters' order. A pair meets once: what meets by the back half is left out if the fronts are equal.

Joins of words are merge joins by hint: Spark's size check sees the compressed file of the words, not the rows that their letters
make of it, and would send those whole through the driver.

The forms of words make chains, along which counts grow fivefold or more, so roots take at most five doublings.

Defined cases: a null text has no words; a null id edits no letters; rows that repeat count each time; an empty table
gives an empty one; texts are whole, words of any length; no other column is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.native import A_TO_Z
from sievegrid.session import stage, unstage

LETTERS = r"A-Za-zÀ-ÿ"
#: The anagram values' modulus, a prime above every letter's power.
MODULUS = (1 << 61) - 1


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6) -> DataFrame:
    """(id, run): the longest runs of letters, A-Z lower-cased, of ``least_length`` or more, once each time they occur."""
    found = F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    runs = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(found).alias("run"))
    return runs.withColumn("run", F.translate("run", A_TO_Z, A_TO_Z.lower()))


def word_counts(words: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n) of the words (word) that are long and frequent enough."""
    counted = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def anagram_value(word: Column) -> Column:
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, x: F.pmod(a + _power(x), F.lit(MODULUS)))


def _power(letter: Column) -> Column:
    """The fifth power of a letter's code point, below 2^41 for code points below 256; of others modulo the modulus at each step."""
    point = F.ascii(letter).cast("long")
    times = lambda a: F.pmod(a * point, F.lit(MODULUS))
    return times(times(point * point * point))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of all ordered pairs of distinct words (word, n) that one letter's edit tells apart."""
    value = words.select("word", "n", anagram_value(F.col("word")).alias("value"))
    letters = F.array_distinct(F.split("word", ""))
    less = value.withColumn("gone", F.explode(F.concat(F.array(F.lit("")), letters)))
    less = less.withColumn("key", F.pmod(F.col("value") - F.when(F.col("gone") == "", F.lit(0)).otherwise(_power(F.col("gone"))), F.lit(MODULUS)))
    less = less.withColumn("size", F.length("word") - F.length("gone")).withColumn("reach", F.expr("size div 2").cast("int"))
    sides = less.withColumn("side", F.explode(F.array(F.lit(True), F.lit(False))))
    half = F.expr("if(side, left(word, reach), right(word, size - reach))")
    keyed = sides.select("key", F.xxhash64("side", half).alias("half"), "side", (F.col("gone") == "").alias("whole"), "value", "reach", "word", "n")
    a, b = keyed.alias("a"), keyed.alias("b")
    meets = (
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.half") == F.col("b.half"))
        & (F.col("a.side") == F.col("b.side"))
        & ~(F.col("a.whole") & F.col("b.whole"))
        & (F.col("a.value") != F.col("b.value"))
        & (F.col("a.side") | (F.expr("left(a.word, a.reach)") != F.expr("left(b.word, a.reach)")))
        & (F.levenshtein("a.word", "b.word", 1) == 1)
    )
    return a.join(b.hint("merge"), meets).select("a.word", "a.n", F.col("b.word").alias("other"), F.col("b.n").alias("other_n"))


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each of (word, n), whose words are distinct.

    ``form`` is the near word of largest n, ties to the smallest, if that is at least ``ratio`` times the word's n; ``root``
    the last of the forms that follow.
    """
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    told = words.join(near.hint("merge"), "word", "left")
    fits = -F.col("best.less") >= F.col("n") * ratio
    told = stage(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "variants")
    root = roots(told.where("form is not null").select("word", F.col("form").alias("root")))
    return told.join(root.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where the links (word, root), which have no circles, end; each round doubles their reach."""
    links = stage(links, "roots")
    while True:
        further = links.join(links.select(F.col("word").alias("root"), F.col("root").alias("next")).hint("merge"), "root", "left")
        moved = stage(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        unstage(links)
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links
