"""Quality rules: a threshold table compiled into one projection [native]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, squash_white

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Common short words of the four languages.
STOP_WORDS = (
    "the of and to a in that is was it for on as with by be are at or an from this had "
    "de la le les des et en un une du que qui dans pour est pas sur par "
    "der die das und ist nicht ein eine von zu mit den dem des im für auf sich auch "
    "el los las del se por con para su una no es al lo como más"
).split()

#: (measure, lowest, highest): a row is kept if each measure lies within its bounds.
#: Measures of words speak only where there are words; null bounds are open.
RULES = (
    ("n_words", 20, None),
    ("mean_word_chars", 1.5, 15.0),
    ("symbols_per_word", None, 0.25),
    ("stop_word_share", 0.02, None),
    ("upper_word_share", None, 0.6),
    ("repeated_line_share", None, 0.5),
    ("repeated_word_share", None, 0.3),
    ("bullet_line_share", None, 0.9),
)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of ``window`` words that occurs twice or more
    in the array, first occurrences included.

    Windows are hashed from their words' hashes (64 bits).  Only a text whose
    windows are not all distinct goes on: sorted with their places, equal
    neighbours give the places of repeated windows, and the gaps between these
    places, at most a window each, add up to the words covered."""

    def of(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(h) - (window - 1))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + (k - 1)) for k in range(window)]))

    def repeated(order: Column) -> Column:
        at = lambda i: F.get(order, i)["h"]
        same = F.transform(order, lambda x, i: F.when((at(i - 1) == x["h"]) | (at(i + 1) == x["h"]), x["i"]))
        return F.array_sort(F.filter(same, lambda p: p.isNotNull()))

    def covered(places: Column) -> Column:
        # lengths up to the next place, a window at most; the last place counts a whole window
        return F.aggregate(F.transform(places, lambda p, i: F.least(F.coalesce(F.get(places, i + 1) - p, F.lit(window)), F.lit(window))), F.lit(0), lambda s, x: s + x)

    def count(g: Column) -> Column:
        order = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(let(order, repeated), covered))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(let(let(hashes, of), count)).cast("long")


def let(value: Column, f) -> Column:
    """f of a value that is made once: lambda arguments are the only names there are."""
    return F.transform(F.array(value), f)[0]


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts and the measures of ``RULES`` added."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.split(text, "\n")
    worded = F.filter(lines, lambda x: F.btrim(x, F.lit(WHITE)) != "")
    share = lambda a, b: F.when(b > 0, a / b)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    stop = r"(?<![^ \t-\r])(?:" + "|".join(STOP_WORDS) + r")(?![^ \t-\r])"
    out = docs.withColumn("_words", F.array_remove(F.split(squash_white(text), " "), ""))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": (F.length(text) - F.regexp_count(text, F.lit(r"[ \t-\r]"))).cast("long"),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_dup_lines": (F.size(worded) - F.size(F.array_distinct(worded))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")),
        "_lines": F.size(worded).cast("long"),
        "_stop": F.regexp_count(ascii_lower(text), F.lit(stop)).cast("long"),
        # the first capital is not the last character; nothing is tried twice
        "_upper": count(r"(?<![^ \t-\r])(?=[\p{N}\p{P}\p{S}]*+\p{Lu}[\p{Lu}\p{N}\p{P}\p{S}])[\p{Lu}\p{N}\p{P}\p{S}]++(?![^ \t-\r])"),
        "_bullets": count(r"(?m)^[ \t]*[-*•·]"),
    })
    n = F.col("n_words")
    out = out.withColumns({
        "mean_word_chars": share(F.col("word_chars"), n),
        "symbols_per_word": share(F.col("n_symbols"), n),
        "stop_word_share": share(F.col("_stop"), n),
        "upper_word_share": share(F.col("_upper"), n),
        "repeated_line_share": share(F.col("n_dup_lines"), F.col("_lines")),
        "repeated_word_share": share(F.col("n_repeat_words"), n),
        "bullet_line_share": share(F.col("_bullets"), F.col("_lines")),
    })
    return out.drop("_words", "_lines", "_stop", "_upper", "_bullets")


def compile_rules(rules=RULES) -> Column:
    """Whether all rules hold, as one boolean expression; an absent measure holds."""
    ok = F.lit(True)
    for name, lowest, highest in rules:
        c = F.col(name)
        within = (F.lit(True) if lowest is None else c >= lowest) & (F.lit(True) if highest is None else c <= highest)
        ok = ok & F.coalesce(within, F.lit(True))
    return ok


def judge_quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with the base counts, the measures, base_failed and kept added.

    Words are runs of characters other than ASCII white space; a null text has
    none.  n_symbols counts SYMBOLS; n_dup_lines the lines with a word that equal
    an earlier line; n_repeat_words as in ``repeated_words``.  base_failed: under
    20 words, or over 30% of words repeated.  kept: not base_failed, and all rules
    hold.  All is one projection of built-in functions over the row, with no
    shuffle, so repeated rows and ties cannot matter; an empty table gives an
    empty result.  Columns of ``docs`` that bear one of the new names are replaced."""
    out = measure(docs)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
