"""Quality rules: word and repetition counts, and distribution divergence from language references.

Every document gets a histogram of character classes and one of common words (and all others). References are the summed
histograms of all documents of a language. A document's Jensen-Shannon distance (base 2, the square root of
the divergence) is taken to every language and the least counts; a document is rejected if it is far from all
languages. Short documents are not judged by a histogram that is too thin. Only Spark SQL expressions run:
one pass over the texts, a small table of counts written to the shared folder, one aggregate by language.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: The twenty words used most in each language that a reference is built for.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"),
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "was", "for", "on", "are", "as", "with", "be", "by", "this", "from", "or"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au"),
}
VOCABULARY = tuple(sorted({w for words in COMMON_WORDS.values() for w in words}))
#: Character classes: what remains of a text when all else is removed. Other ASCII letters and controls follow by subtraction.
CLASSES = {"upper": "[^A-Z]+", "digit": "[^0-9]+", "symbol": "[^#*$%&|<>]+", "point": "[^.,;:!?'\"()\\-]+", "space": "[^ \\t-\\r]+", "wide": "[\\x00-\\x7F]+"}
WINDOW = 5


@dataclass(frozen=True)
class Limits:
    """Distances above which a document is rejected, and the least counts to judge by."""

    chars: float = 0.28
    least_chars: int = 200
    words: float = 0.32
    least_judged_words: int = 50
    least_words: int = 10
    repeat_percent: int = 20


def _left(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts of each row of ``docs``: id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ``chars``, ``common``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _counted(rows).drop("text")


def _counted(rows: DataFrame) -> DataFrame:
    """Adds the counts to ``rows`` with a non-null column ``text``."""
    keep = rows.columns
    counts = rows.select(
        *keep,
        F.length("text").cast("long").alias("n"),
        *[_left(F.col("text"), p).alias(c) for c, p in CLASSES.items()],
        F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike("[^ \\t-\\r]")).alias("lines"),
    )
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    counts = counts.select("*", F.size("words").cast("long").alias("n_words"), hashes.alias("h"), F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(*VOCABULARY)).alias("known"))
    at = F.when(F.col("n_words") > WINDOW, F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW)).otherwise(F.array().cast("array<int>"))
    counts = counts.select("*", F.transform(at, lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)])).alias("windows"))
    # where a window repeats, windows as (hash, place) are sorted, so that equal ones become neighbours
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    counts = counts.select("*", F.when(repeats, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("w"))
    twin = F.filter("w", lambda x, k: F.get("w", k - 1)["h"].eqNullSafe(x["h"]) | F.get("w", k + 1)["h"].eqNullSafe(x["h"]))
    counts = counts.select("*", F.sort_array(F.transform(twin, lambda x: x["i"])).alias("twins"))
    covered = F.aggregate(
        "twins",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    # known words and one of each sort into runs; how long a run is follows from where the next one begins
    counts = counts.select("*", F.sort_array(F.concat("known", F.array(*map(F.lit, VOCABULARY)))).alias("runs"))
    counts = counts.select("*", F.array(*[F.array_position("runs", v) for v in VOCABULARY], F.size("runs").cast("long") + 1).alias("at"))
    common = [F.get("at", F.lit(i + 1)) - F.get("at", F.lit(i)) - 1 for i in range(len(VOCABULARY))]
    other = F.col("n") - sum((F.col(c) for c in CLASSES), F.lit(0))
    return counts.select(
        *keep,
        "n_words",
        (F.col("n") - F.col("space")).alias("word_chars"),
        F.col("symbol").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.array(*CLASSES, other).alias("chars"),
        F.array(*common, F.col("n_words") - F.size("known")).alias("common"),
    )


def references(counts: DataFrame) -> list[tuple[list[float], list[float]]]:
    """Character-class and common-word histograms of each language with words of its own, over all its rows."""
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    sums += [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(len(VOCABULARY) + 1)]
    rows = counts.where(F.col("lang").isin(*COMMON_WORDS)).groupBy("lang").agg(*sums).orderBy("lang").collect()
    out = []
    for r in rows:  # one row a language of COMMON_WORDS at most
        for_lang = ([r[f"c{i}"] for i in range(len(CLASSES) + 1)], [r[f"w{i}"] for i in range(len(VOCABULARY) + 1)])
        if all(sum(x) for x in for_lang):
            out.append(tuple([v / sum(x) for v in x] for x in for_lang))
    return out


def js_distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (0 to 1) of a column of shares (an array that sums to 1) to a histogram."""
    ref = F.array(*[F.lit(float(r)) for r in reference])
    half = F.zip_with(
        shares,
        ref,
        lambda p, r: F.when(p > 0, p * F.log2(2 * p / (p + r))).otherwise(0.0) + F.when(r > 0, r * F.log2(2 * r / (p + r))).otherwise(0.0),
    )
    divergence = F.aggregate(half, F.lit(0.0), lambda a, x: a + x) / 2
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def judge(counts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds ``base_failed``, ``char_distance``, ``word_distance`` and ``kept``; distances are null where too thin to judge."""
    refs = references(counts)

    def nearest(column: str, k: int) -> Column:
        found = [js_distance(F.col(column), r[k]) for r in refs]
        return F.lit(None).cast("double") if not found else found[0] if len(found) == 1 else F.least(*found)

    base = (F.col("n_words") < limits.least_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))
    out = counts.withColumn("n_chars", F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x))
    n_chars, n_words = F.greatest("n_chars", F.lit(1)).cast("double"), F.greatest("n_words", F.lit(1)).cast("double")
    out = out.withColumn("char_shares", F.transform("chars", lambda c: c / n_chars)).withColumn("word_shares", F.transform("common", lambda c: c / n_words))
    out = out.select(
        *counts.columns,
        base.alias("base_failed"),
        F.when(F.col("n_chars") >= limits.least_chars, nearest("char_shares", 0)).alias("char_distance"),
        F.when(F.col("n_words") >= limits.least_judged_words, nearest("word_shares", 1)).alias("word_distance"),
    )
    far = (F.coalesce("char_distance", F.lit(0.0)) > limits.chars) | (F.coalesce("word_distance", F.lit(0.0)) > limits.words)
    return out.withColumn("kept", ~F.col("base_failed") & ~far)


def quality_rules(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id, counts, distances, ``base_failed`` and ``kept``.

    Words are runs of characters other than space and \\t-\\r; null texts have none and fail for having too
    few. Every document is compared with all references, whatever its language column says, and the nearest
    counts; so a null language is no obstacle, and a text in a language without a reference is judged by the
    reference that is nearest to it: give its words in COMMON_WORDS, or it may be rejected. With no reference at
    all (e.g. an empty table) only the base rules count. Rows that repeat are each answered; other columns are not read.
    """
    counts = durable(document_counts(docs, id_col, text_col, lang_col), "quality")
    return judge(counts, limits).withColumnRenamed("id", id_col)

