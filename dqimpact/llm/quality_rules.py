"""Line-first cleaning with native expressions.

Each line is held against a punctuation, a navigation and a boilerplate rule; failing lines go, and a
document that loses more than a stated share of its text goes with them.  Everything is a column
expression over one row: no shuffle, no Python, and each pass over a text is linear in its length (the
one sort is over the repeated windows of a document that has some).

Defined results for odd rows: a null text counts as an empty one and has no words; a document
without words loses nothing but fails the base rules; repeated rows and repeated ids are judged row by
row; any further columns are carried along untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqimpact.llm.store import carried, quoted

# The white space between words, and the characters that count as symbols.
SPACE = " \t\n\u000b\f\r"
SPACES = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"

# Phrases that mark a line as boilerplate, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "accept cookies",
    "enable javascript",
    "subscribe to our newsletter",
    "lorem ipsum",
)

WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; shares are percentages, held as integers so that they are exact."""

    min_words: int = 20
    max_repeat_percent: int = 30
    # Words that carry a run of marks ("of%%%", "AND!!"), out of the words of a line.
    max_marked_percent: int = 30
    # A line of at least this many words without an end mark is a heading or a fragment ...
    fragment_words: int = 4
    # ... unless it is a passage of so many words.
    passage_words: int = 12
    # Separators such as | or » out of the words of a line.
    max_separator_percent: int = 20
    # A boilerplate phrase condemns a line of so many words at most; a longer one is prose that names it.
    boilerplate_words: int = 30
    # Characters lost with the removed lines, out of all characters of the words.
    max_lost_percent: int = 50


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _words(text: Column) -> Column:
    """Words of a text that has at least one; the caller sees to the others."""
    return F.split(F.btrim(text, F.lit(SPACE)), SPACES)


def _next(values: Column, step: int) -> Column:
    """The array moved `step` places forward, so that zip_with meets each element with a later one."""
    return F.slice(values, F.lit(step + 1), F.greatest(F.size(values) - step, F.lit(0)))


def _combined(hashes: Column, step: int) -> Column:
    return F.zip_with(hashes, _next(hashes, step), lambda a, b: F.xxhash64(a, b))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Add n_repeat_words: words covered by 8-word windows found at least twice in the text.

    A window is known by a 64-bit hash built in three doublings (1, 2, 4, 8 words).  Only a document in
    which some hash occurs twice goes through the sort that finds the places.
    """
    word_hash = F.transform("_words", lambda w: F.xxhash64(w))
    df = df.withColumn("_h1", F.when(F.size("_words") > WINDOW, word_hash))
    df = df.withColumn("_h2", _combined(F.col("_h1"), 1))
    df = df.withColumn("_h4", _combined(F.col("_h2"), 2))
    df = df.withColumn("_h8", _combined(F.col("_h4"), 4))
    df = df.withColumn("_windows", F.slice("_h8", F.lit(1), F.greatest(F.size("_h8") - WINDOW + 1, F.lit(0))))
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_placed", F.when(repeated, F.sort_array(placed)))
    pairs = F.zip_with(
        "_placed", _next(F.col("_placed"), 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))
    )
    places = F.flatten(F.filter(pairs, lambda p: p.isNotNull()))
    df = df.withColumn("_places", F.sort_array(F.array_distinct(places)))
    covered = F.zip_with(
        "_places", _next(F.col("_places"), 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))
    )
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda t, x: t + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop(
        "_h1", "_h2", "_h4", "_h8", "_windows", "_placed", "_places"
    )


# Marks whose runs disfigure a word, and separators of navigation bars.
MARKS = "[#*$%&<>!~^=_]{2,}"
SEPARATORS = "[|\u00bb\u00ab\u2022\u00b7\u00a6]"
END = "[.!?\u2026\u3002:;\"'\u201d\u2019)\\]][ \\t-\\r]*$"


def line_facts(line: Column, odd: Column) -> Column:
    """What the rules need to know of a line; `odd` is false where the whole text has no mark or separator."""
    return F.struct(
        line.alias("line"),
        _count(line, "[^ \\t-\\r]+").alias("words"),
        F.when(odd, _count(line, MARKS)).otherwise(0).alias("marked"),
        F.when(odd, _count(line, SEPARATORS)).otherwise(0).alias("separators"),
    )


def line_passes(x: Column, rules: Rules) -> Column:
    """Whether a line stands all rules; a line without words always does."""
    punctuated = x["marked"] * 100 <= x["words"] * rules.max_marked_percent
    fragment = (x["words"] >= rules.fragment_words) & (x["words"] < rules.passage_words)
    navigation = x["separators"] * 100 > x["words"] * rules.max_separator_percent
    short = (x["words"] > 0) & (x["words"] <= rules.boilerplate_words)
    phrase = x["line"].rlike("(?i)" + "|".join(BOILERPLATE))
    return punctuated & ~navigation & ~(fragment & ~x["line"].rlike(END)) & ~(short & phrase)


def quality_rules(df: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Add the base counts, cleaned_text, n_removed_lines, lost_chars, base_failed and kept to every row.

    Other columns are carried along whatever their names; those named like a result, in any case, are replaced.
    """
    made = [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_lines", "lost_chars",
        "cleaned_text", "base_failed", "kept",
    ]
    own = carried(df, made)
    none = F.array().cast("array<string>")
    df = df.select(
        F.coalesce(F.col(quoted(text)), F.lit("")).alias("_text"), *[F.col(quoted(c)).alias(name) for name, c in own.items()]
    )
    df = df.withColumn("_words", F.when(F.col("_text").rlike("[^ \\t-\\r]"), _words(F.col("_text"))).otherwise(none))
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": _count(F.col("_text"), f"[{SYMBOLS}]").cast("long"),
            "_odd": F.col("_text").rlike(f"{MARKS}|{SEPARATORS}"),
        }
    )
    df = _repeat_words(df).drop("_words")

    df = df.withColumn("_lines", F.transform(F.split("_text", "\n"), lambda x: line_facts(x, F.col("_odd"))))
    df = df.withColumn("_full", F.transform(F.filter("_lines", lambda x: x["words"] > 0), lambda x: x["line"]))
    df = df.withColumn("n_dup_lines", (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long")).drop("_full")
    df = df.withColumn("_good", F.filter("_lines", lambda x: line_passes(x, rules)))
    df = df.withColumns(
        {
            "n_removed_lines": (F.size("_lines") - F.size("_good")).cast("long"),
            "cleaned_text": F.array_join(F.transform("_good", lambda x: x["line"]), "\n"),
        }
    ).drop("_lines", "_good", "_odd")
    # Lines are lost whole: what is left of the words' characters is what is no white space.
    left = F.length("cleaned_text") - _count(F.col("cleaned_text"), "[ \\t-\\r]")
    df = df.withColumn("lost_chars", F.when(F.col("n_removed_lines") > 0, F.col("word_chars") - left).otherwise(0))
    df = df.withColumn("lost_chars", F.col("lost_chars").cast("long"))
    base = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent
    )
    lost = F.col("lost_chars") * 100 > F.col("word_chars") * rules.max_lost_percent
    df = df.withColumns({"base_failed": base, "kept": ~base & ~lost})
    whole_row = df.select(*own, *made)
    # A filter on a verdict must not be moved below: it would repeat, for every use of a column, all that
    # the column is made of.  What a generator gives out stays above it.
    lifted = whole_row.select(F.inline(F.array(F.struct(*whole_row.columns))))
    return lifted.select(*[F.col(name).alias(c) for name, c in own.items()], *made)
