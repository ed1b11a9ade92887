"""Quality rules by distribution divergence.

A document's histograms of character classes and of common short words are compared with those of its language,
taken over the whole corpus, by the Jensen-Shannon distance (base 2, from 0 to 1). Native: DataFrame functions only.

Defined cases: a null text is an empty one; null and unknown languages are languages of their own; a document or a
language below its minimum length is not judged by divergence; repeated rows give repeated results; an empty table
gives an empty one. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.llm.native import let, text_of, total, upto, words_of
from sievegrid.session import stage

SYMBOLS = "#*$%&|<>"
CLASSES = ["lower", "upper", "digit", "symbol", "punctuation", "other"]


#: A packed window keeps its place in so many low bits; longer texts skip the packing.
PLACE_BITS = 24


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the same list of words.

    Windows are hashed, packed with their place in one long and sorted as plain longs. Only the few neighbours that
    agree in the hash's upper bits are looked at again, by the whole 64-bit hash.
    """
    n = F.size(words) - 2
    hashed = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    all_places = F.transform(upto(n), lambda i: i - 1)

    def suspects(s: Column) -> Column:
        near = F.zip_with(
            s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda a, b: F.when(F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS), F.array(a, b))
        )
        place = F.lit((1 << PLACE_BITS) - 1).cast("long")
        return F.transform(F.array_distinct(F.flatten(F.array_compact(near))), lambda x: x.bitwiseAND(place).cast("int"))

    packed = F.transform(F.slice(words, 1, F.greatest(n, F.lit(0))), lambda w, i: F.shiftleft(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)), PLACE_BITS).bitwiseOR(i.cast("long")))
    places = F.when(n <= (1 << PLACE_BITS), let(F.sort_array(packed), suspects)).otherwise(all_places)

    def repeated(s: Column) -> Column:
        same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
        size = F.size(s)
        kept = F.filter(upto(size), lambda i: ((i > 1) & same(i - 1, F.greatest(i - 2, F.lit(0)))) | ((i < size) & same(i - 1, i)))
        return F.sort_array(F.transform(kept, lambda i: F.get(s, i - 1)["i"]))

    def covered(p: Column) -> Column:
        most = F.greatest(F.size(p) - 1, F.lit(0))
        gaps = F.zip_with(F.slice(p, 2, most), F.slice(p, 1, most), lambda a, b: F.least(a - b, F.lit(3)))
        return F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(total(gaps) + 3)

    exact = F.sort_array(F.transform(places, lambda i: F.struct(hashed(i).alias("h"), i.alias("i"))))
    return let(exact, lambda s: let(repeated(s), covered))


def document_counts(text: Column, words: Column) -> dict[str, Column]:
    """The base counts of a whole text."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def class_histogram(rare: Column, word_chars: Column, n_symbols: Column) -> Column:
    """Counts by CLASSES. rare: the text without lower-case letters and white space."""
    n = lambda pattern: F.length(F.regexp_replace(rare, pattern, ""))
    upper, digit = n(r"[^\p{Lu}]+"), n(r"[^\p{Nd}]+")
    mark = F.length(F.regexp_replace(F.translate(rare, SYMBOLS, ""), r"[^\p{P}]+", ""))
    lower = word_chars - F.length(rare)
    other = F.length(rare) - upper - digit - n_symbols - mark
    return F.array(*[c.cast("double") for c in (lower, upper, digit, n_symbols, mark, other)])


def divergence_term(p: Column, q: Column) -> Column:
    """A cell's part of twice the Jensen-Shannon divergence."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log2(q / m)).otherwise(F.lit(0.0))


def _by_language(rows: DataFrame, reference: DataFrame, draw: Column, salts: int = 64) -> DataFrame:
    """Left join with a row a language, salted: a language may hold most rows."""
    salted = reference.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod(draw, F.lit(salts))).join(salted, ["lang", "salt"], "left").drop("salt")


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    common_words: int = 32,
    common_length: int = 4,
    min_words: int = 50,
    min_reference_words: int = 2000,
    max_class_distance: float = 0.33,
    max_word_distance: float = 0.48,
    carry: bool = False,
) -> DataFrame:
    """One row a document: counts, distances (null where not judged), base_failed and kept; ``carried``, its whole row, if asked for.

    The references cover every document: the ``common_words`` most frequent words of at most ``common_length``
    characters of each language, with their shares, and its characters' classes.
    """
    lang = F.struct(F.col(f"`{lang_col}`").cast("string").alias("name"))  # null is a language of its own
    base = docs.select(F.col(f"`{id_col}`").alias("id"), lang.alias("lang"), text_of(text_col).alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("carried")] if carry else []))
    carried = ["carried"] if carry else []

    short = F.filter(words_of(F.col("text")), lambda w: F.length(w) <= common_length)
    counts = base.select("lang", F.explode(short).alias("word")).select("lang", F.lower("word").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("k") <= common_words)
    common = stage(ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "word", "n"))).alias("top")), "common-words")

    with_top = _by_language(base, common, F.xxhash64("text")).withColumn("common", F.coalesce(F.col("top.word"), F.array().cast("array<string>")))
    parsed = with_top.select("id", "lang", "text", "common", *carried, words_of(F.col("text")).alias("words"))
    short_words = F.filter("words", lambda w: F.length(w) <= common_length)
    places = F.sort_array(F.filter(F.transform(short_words, lambda w: F.array_position("common", F.lower(w))), lambda p: p > 0))

    def runs(p: Column) -> Column:
        ends = F.filter(upto(F.size(p)), lambda i: (i == F.size(p)) | (F.get(p, i - 1) != F.get(p, i)))
        return let(ends, lambda e: F.transform(upto(F.size(e)), lambda j: F.struct(F.get(p, F.get(e, j - 1) - 1).cast("int").alias("k"), (F.get(e, j - 1) - F.when(j > 1, F.get(e, F.greatest(j - 2, F.lit(0)))).otherwise(F.lit(0))).alias("n"))))

    measured = parsed.select(
        "id",
        "lang",
        *carried,
        *[c.alias(k) for k, c in document_counts(F.col("text"), F.col("words")).items()],
        F.array_join("words", "").alias("letters"),
        let(places, runs).alias("common_counts"),
    )
    measured = measured.withColumn("word_chars", F.length("letters").cast("long")).withColumn("rare", F.regexp_replace("letters", r"\p{Ll}+", ""))
    measured = measured.withColumn("n_symbols", (F.length("rare") - F.length(F.translate("rare", SYMBOLS, ""))).cast("long"))
    measured = stage(
        measured.select("id", "lang", *carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "common_counts", class_histogram(F.col("rare"), F.col("word_chars"), F.col("n_symbols")).alias("classes")),
        "quality-counts",
    )

    sums = measured.groupBy("lang").agg(F.sum("n_words").alias("ref_words"), *[F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))])
    reference = sums.join(common, "lang", "left").select(
        "lang",
        "ref_words",
        F.array(*[f"c{i}" for i in range(len(CLASSES))]).alias("ref_classes"),
        F.transform("top", lambda t: t["n"] / F.col("ref_words")).alias("ref_common"),
    )
    reference = stage(reference, "language-references")  # so that Spark knows its size before it plans the join
    judged = _by_language(measured, reference, F.xxhash64("id"))

    share = lambda a: let(total(a, "double"), lambda s: F.transform(a, lambda x: F.when(s > 0, x / F.greatest(s, F.lit(1e-300))).otherwise(F.lit(0.0))))
    class_distance = F.sqrt(F.greatest(total(F.zip_with(share(F.col("classes")), share(F.col("ref_classes")), divergence_term), "double"), F.lit(0.0)) / 2)
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    seen = total(F.transform("common_counts", lambda x: x["n"]))
    known = total(F.col("ref_common"), "double")
    terms = total(F.transform("common_counts", lambda x: divergence_term(x["n"] / n, F.get("ref_common", x["k"] - 1)) - F.get("ref_common", x["k"] - 1)), "double")
    word_distance = F.sqrt(F.greatest(terms + known + divergence_term((n - seen) / n, 1 - known), F.lit(0.0)) / 2)

    long_enough = (F.col("n_words") >= min_words) & (F.col("ref_words") >= min_reference_words)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        judged.withColumn("class_distance", F.when(long_enough, class_distance))
        .withColumn("word_distance", F.when(long_enough & F.col("ref_common").isNotNull(), word_distance))
        .withColumn("base_failed", failed)
        .select(
            F.col("id").alias(id_col),
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "base_failed",
            (~F.col("base_failed") & (F.coalesce("class_distance", F.lit(0.0)) <= max_class_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance)).alias("kept"),
            "class_distance",
            "word_distance",
            *carried,
        )
    )
