"""Statistics of whole texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, WORD

SYMBOLS = "[#*$%&|<>]"


def word_list(text: Column) -> Column:
    """The words of a text in order; none for a null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_repetition(df: DataFrame, words: str = "words") -> DataFrame:
    """Adds n_repeat_words: words in 3-word windows found twice or more in the text, first ones included.

    Windows are compared by 64-bit hash within one text: sorted, equal ones stand next to each other; the places of those that have
    an equal neighbour are put in order again, and each covers three words less what the next one covers too.
    """
    w = F.col(words)
    windows = F.when(
        F.size(w) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
    )
    df = df.withColumn("_windows", windows)
    marked = F.transform(F.col("_windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_sorted", F.when(F.size("_windows") > F.size(F.array_distinct("_windows")), F.sort_array(marked)))
    s = F.col("_sorted")
    equal = lambda k, j: F.coalesce(F.get(s, k)["h"] == F.get(s, j)["h"], F.lit(False))
    found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: equal(k, k + 1) | equal(k, k - 1))
    df = df.withColumn("_places", F.when(s.isNotNull(), F.sort_array(F.transform(found, lambda k: F.get(s, k)["i"]))))
    p = F.col("_places")
    steps = F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(3), lambda acc, k: acc + F.least(F.lit(3), F.get(p, k) - F.get(p, k - 1)))
    covered = F.when(p.isNull(), 0).otherwise(steps)
    return df.withColumn("n_repeat_words", covered.cast("long")).drop("_windows", "_sorted", "_places")


def base_statistics(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """keep, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper of each whole text (null: empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    df = docs.select(
        *keep,
        word_list(F.col("text")).alias("words"),
        lines.alias("lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    df = with_repetition(df)
    return df.select(
        *[c for c in df.columns if c not in ("words", "lines", "n_symbols", "n_upper", "n_repeat_words")],
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        "n_upper",
    )
