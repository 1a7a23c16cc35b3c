"""Line-first cleaning.

Each line is judged by rules on punctuation, navigation and boilerplate.
Failing lines are removed, and a document that loses too many of its words to
that, or fails the document rules, is rejected.

Words are runs without white space. A null or empty text has no words and is
rejected. Every row is judged by itself: repeated rows, null ids and further
columns stay as they are. Columns of the input named like one added here are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscale.llm.common import WHITE_SPACE, folded, materialised, split_words, unfolded

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
MOST_LOST_PERCENT = 50

# What a line has when it is not prose.
SYMBOL = r"[^#*$%&|<>]"
NAVIGATION = r"(?i)^\W*(home|menu|next|previous|prev|login|log in|sign in|sign up|register|search|contact|about|share|sitemap|back to top)\b"
BOILERPLATE = (
    r"(?i)(all rights reserved|cookie policy|privacy policy|terms of (use|service)|enable javascript"
    r"|click here|subscribe (now|to our)|lorem ipsum|powered by|add to cart)"
)


def line_fails(line: Column) -> Column:
    """True for a line that one of the rules removes; lines without words stay."""
    words = F.size(split_words(line))
    symbols = F.length(F.regexp_replace(line, SYMBOL, ""))
    punctuation = (symbols * 5 > words) & (symbols >= 3)
    navigation = (words <= 8) & F.rlike(line, F.lit(NAVIGATION)) & ~F.rlike(line, F.lit(r"[.!?]\s*$"))
    boilerplate = (words <= 40) & F.rlike(line, F.lit(BOILERPLATE))
    return punctuation | navigation | boilerplate


def _repeated_words(sorted_windows: str) -> Column:
    """Words covered by windows of three words that occur at least twice.

    ``sorted_windows`` holds (hash, position) in order, so equal windows are
    neighbours; the positions found then cover three words each, less overlap.
    """
    windows = F.col(sorted_windows)
    positions = F.array_sort(
        F.transform(
            F.filter(
                F.transform(
                    windows,
                    lambda window, index: F.struct(
                        window["position"].alias("position"),
                        (
                            F.coalesce(window["hash"] == F.get(windows, index - 1)["hash"], F.lit(False))
                            | F.coalesce(window["hash"] == F.get(windows, index + 1)["hash"], F.lit(False))
                        ).alias("repeated"),
                    ),
                ),
                lambda window: window["repeated"],
            ),
            lambda window: window["position"],
        )
    )
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("covered"))
    return F.aggregate(
        positions,
        start,
        lambda state, at: F.struct(
            at.alias("last"), (state["covered"] + F.least(F.lit(3), at - state["last"])).cast("long").alias("covered")
        ),
        lambda state: state["covered"],
    )


def quality_facts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with word counts, the base verdict, the cleaned text and ``kept``."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    words = split_words(text)
    lines = F.split(text, "\n")
    split = materialised(docs, _words=words, _lines=lines)
    full_lines = F.filter("_lines", lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    hashes = F.transform(
        F.when(F.size("_words") >= 3, F.sequence(F.lit(0), F.size("_words") - 3)).otherwise(F.array().cast("array<int>")),
        lambda at: F.xxhash64(F.get("_words", at), F.get("_words", at + 1), F.get("_words", at + 2)),
    )
    judged = F.transform("_lines", lambda line: F.struct(line.alias("line"), line_fails(line).alias("fails")))
    counted = materialised(
        split,
        n_words=F.size("_words").cast("long"),
        word_chars=F.length(F.regexp_replace(text, WHITE_SPACE, "")).cast("long"),
        n_symbols=F.length(F.regexp_replace(text, SYMBOL, "")).cast("long"),
        n_dup_lines=(F.size(full_lines) - F.size(F.array_distinct(full_lines))).cast("long"),
        _hashes=hashes,
        _judged=judged,
    ).drop("_words", "_lines")
    # Most texts repeat no window; only the others are sorted with positions.
    windows = F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.sort_array(F.transform("_hashes", lambda value, at: F.struct(value.alias("hash"), at.alias("position")))),
    ).otherwise(F.array().cast("array<struct<hash:bigint,position:int>>"))
    sorted_ = materialised(counted, _windows=windows).drop("_hashes")
    kept_lines = F.transform(F.filter("_judged", lambda item: ~item["fails"]), lambda item: item["line"])
    cleaned = F.when(F.exists("_judged", lambda item: item["fails"]), F.array_join(kept_lines, "\n")).otherwise(text)
    repeated = materialised(sorted_, n_repeat_words=_repeated_words("_windows"), cleaned_text=cleaned).drop("_windows", "_judged")
    left = F.when(F.col("cleaned_text") == text, F.col("n_words")).otherwise(F.size(split_words(F.col("cleaned_text"))))
    failed = (F.col("n_words") < LEAST_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT
    )
    lost = F.col("n_words") - left
    return repeated.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (lost * 100 <= F.col("n_words") * MOST_LOST_PERCENT)
    )


def quality_digest(facts: DataFrame) -> DataFrame:
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"
    return facts.select(*names.split())


def clean_documents(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Kept documents, their failing lines removed; the columns stay those of ``docs``."""
    facts = quality_facts(folded(docs, text=F.col(f"`{text_column}`"))).where("kept")
    return unfolded(facts, docs, **{text_column: F.col("cleaned_text")})
