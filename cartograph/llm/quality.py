r"""Quality rules, line first.

Every line that has a word is judged alone and removed if a rule finds it to be

- symbol noise: over ``noise`` percent of its characters are among SYMBOLS;
- navigation: three or more separators, or nothing but words of NAVIGATION;
- boilerplate: a stock phrase of page furniture;
- shouting: 20 ASCII letters or more, over ``capitals`` percent of them capital;
- unpunctuated: it doesn't end in a sentence mark and has over ``per_mark`` words for each mark in it (four words without any).

Blank lines stay. A document that loses over ``max_lost`` percent of its word characters is rejected. So is one that fails the
measures of the whole input text: fewer than ``min_words`` words, or over ``max_repeat`` percent of words in 8-word windows found before.

All of it is row-local DataFrame expressions: one scan, no shuffle, no Python. Null, blank and empty texts
have no words and are rejected. Very long texts cost time in proportion to their length, and n log n for the sort of the
windows of those that repeat some. Repeated rows are judged alike, and ties don't arise. An empty table gives an empty table. Other columns pass through; an input column
with the name of a result column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartograph.llm.expr import BLANKS, carried, count_chars, let, lines, solid, with_text, words

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•"
MARKS = ".!?:;…。！？"
ENDS = r"[.!?…。！？][\"'”’»)\]]*\z"
WINDOW = 8

# Stock phrases of page furniture, matched without case anywhere in a line.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "forgot your password",
    "log in to", "lorem ipsum", "privacy policy", "read more", "sign up", "skip to content", "subscribe to our", "terms of use",
)

# Words of navigation bars; a line of nothing else is one.
NAVIGATION = (
    "about", "account", "archive", "back", "basket", "blog", "cart", "categories", "contact", "downloads", "events", "faq", "forum", "gallery",
    "help", "home", "imprint", "login", "logout", "menu", "news", "next", "previous", "print", "register", "search", "share", "shop", "sitemap",
    "store", "support", "top",
)
BAR = rf"^(?:{'|'.join(NAVIGATION)})(?:[ /|>»›•·-]+(?:{'|'.join(NAVIGATION)}))*\z"

NEW = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_lines", "lost_chars", "base_failed", "kept", "kept_text"]


def window_hashes(w: Column) -> Column:
    """A 64-bit hash of each WINDOW neighbouring words: words once, then pairs, fours and eights."""

    def doubled(h: Column, step: int) -> Column:
        return let(h, lambda h: F.zip_with(h, F.slice(h, step + 1, F.size(h)), lambda a, b: F.xxhash64(a, b)))

    hashes = doubled(doubled(doubled(F.transform(w, lambda x: F.xxhash64(x)), 1), 2), 4)
    return F.slice(hashes, 1, F.greatest(F.size(w) - WINDOW + 1, F.lit(0)))


def repeated_words(w: Column) -> Column:
    """Words that lie in windows of WINDOW words found at least twice in the text; equal hashes are compared word by word."""

    def marked(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            text = lambda x: F.slice(w, x["i"] + 1, WINDOW)
            same = lambda x, y: (x["h"] == y["h"]) & (text(x) == text(y))
            hit = lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False))
            return F.sort_array(F.transform(F.filter(s, hit), lambda x: x["i"]))

        def covered(p: Column) -> Column:
            gap = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(gap, F.lit(0), lambda a, x: a + x)

        return let(let(order, starts), covered)

    some = let(window_hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(marked(h)))
    return F.when(F.size(w) > WINDOW, some).otherwise(0).cast("long")


def stock_phrase(text: Column) -> Column:
    def any_of(low: Column) -> Column:
        out = F.lit(False)
        for phrase in BOILERPLATE:
            out = out | low.contains(phrase)
        return out

    return let(F.lower(text), any_of)


def flags(text: Column) -> Column:
    """What a whole text must have for some line to fail a rule: most texts have none of it, and their lines skip the rule."""
    return F.struct(count_chars(text, SYMBOLS).alias("symbols"), text.rlike(f"[{SEPARATORS}]").alias("bar"), stock_phrase(text).alias("stock"))


def line_fails(line: Column, of_text: Column, noise: int = 10, capitals: int = 70, per_mark: int = 50) -> Column:
    """True for a line with words that one of the line rules removes; of_text: flags() of the whole text."""
    upper, lower = count_chars(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count_chars(line, "abcdefghijklmnopqrstuvwxyz")

    def open_end(t: Column) -> Column:
        n = F.size(words(t))
        unmarked = (n >= 4) & (n > per_mark * count_chars(t, MARKS))
        return ~t.rlike(ENDS) & (unmarked | ((F.char_length(t) <= 200) & F.lower(t).rlike(BAR)))

    return (
        ((of_text["symbols"] > 0) & (100 * count_chars(line, SYMBOLS) > noise * F.char_length(line)))
        | (of_text["bar"] & (count_chars(line, SEPARATORS) >= 3))
        # Where most letters are capital, two capitals follow each other among the letters.
        | (line.rlike("[A-Z][^A-Za-z]*[A-Z]") & (upper + lower >= 20) & (100 * upper > capitals * (upper + lower)))
        | (of_text["stock"] & stock_phrase(line))
        | let(F.btrim(line, F.lit(BLANKS)), open_end)
    )


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def without_failing(text: Column, **options: int) -> Column:
    """The text without the lines that fail; blank lines stay."""
    return let(flags(text), lambda f: F.array_join(F.filter(lines(text), lambda x: ~(has_word(x) & line_fails(x, f, **options))), "\n"))


def quality(docs: DataFrame, text: str = "text", min_words: int = 20, max_repeat: int = 30, max_lost: int = 30, **options: int) -> DataFrame:
    """Adds n_lost_lines, lost_chars, kept and kept_text, the text without its failing lines, and the measures of the input text.

    A text that loses nothing is returned as it is, null included. Measures: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed. options: noise, capitals and per_mark of the line rules.
    """

    def by_line(all_lines: Column, f: Column) -> Column:
        def judged(full: Column) -> Column:
            bad = F.filter(full, lambda x: line_fails(x, f, **options))
            dup = (F.size(full) - F.size(F.array_distinct(full))).cast("long")
            return let(bad, lambda b: F.struct(dup.alias("dup"), F.size(b).cast("long").alias("n"), F.char_length(solid(F.array_join(b, ""))).cast("long").alias("c")))

        return let(F.filter(all_lines, has_word), judged)

    def measured(t: Column) -> Column:
        w = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
        return let(flags(t), lambda f: F.struct(by_line(lines(t), f).alias("l"), w.alias("w"), f["symbols"].alias("s"), F.char_length(solid(t)).cast("long").alias("c")))

    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(F.struct("*").alias("__row"), let(body, measured).alias("__q"))
    failed = (F.col("__q.w.n") < min_words) | (100 * F.col("__q.w.r") > max_repeat * F.col("__q.w.n"))
    own = F.col(f"__row.`{text}`")
    value = {
        "n_words": F.col("__q.w.n"), "word_chars": F.col("__q.c"), "n_symbols": F.col("__q.s"), "n_dup_lines": F.col("__q.l.dup"), "n_repeat_words": F.col("__q.w.r"),
        "n_lost_lines": F.col("__q.l.n"), "lost_chars": F.col("__q.l.c"), "base_failed": failed, "kept": ~failed & (100 * F.col("__q.l.c") <= max_lost * F.col("__q.c")),
        "kept_text": F.when(F.col("__q.l.n") == 0, own).otherwise(without_failing(own, **options)),
    }
    return out.select(*carried(docs, NEW), *[value[c].alias(c) for c in NEW])


def clean(docs: DataFrame, text: str = "text", **options: int) -> DataFrame:
    """The documents that the rules keep without their failing lines, with their own columns only.

    n_chars, where there is such a column, follows the new text.
    """
    judged = quality(docs.select(F.struct("*").alias("__row"), F.col(text)), text, **options).where("kept")
    return judged.select(*with_text(docs, text, F.col("n_lost_lines") > 0, F.col("kept_text")))
