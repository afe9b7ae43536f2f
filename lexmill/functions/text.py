"""Text cleaning, tokens and n-grams as native column expressions.

Character classes follow Unicode: "space" is every white-space code point plus the four
information separators, "word" is letters, numbers and the underscore. Combining vowel
signs are not word characters, so scripts such as Bengali split at them.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Bodies of the character classes used by every pattern below.
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
WORD = r"\p{L}\p{N}_"

# The cleaning patterns.
TAG = r"<[^>]++>"
URL = rf"http[^{SPACE}]++|www\.[^{SPACE}]++"
# An address swallows its whole run of non-space characters, so a match can only begin where
# the run begins; the look-behind keeps the search linear in the length of the text.
EMAIL = rf"(?<![^{SPACE}])[^{SPACE}][^@{SPACE}]*+@[^{SPACE}]++"
MENTION = rf"[@#]([{WORD}]++)"
SPACES = rf"[{SPACE}]++"
EDGE_SPACES = rf"\A[{SPACE}]++|(?<![{SPACE}])[{SPACE}]++\z"
TOKEN = rf"[{WORD}]{{2,}}+"


def bind(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is computed once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def strip_html(text: Column) -> Column:
    """Replace every tag by a space.

    Nothing after the last ``>`` can be part of a tag, so that tail stays out of the search:
    a text full of unclosed ``<`` would otherwise be scanned to its end from each of them.
    """
    tail = F.substring_index(text, ">", -1)
    head = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
    return F.concat(F.regexp_replace(head, TAG, " "), tail)


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, " ")


def strip_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, " ")


def unwrap_mentions(text: Column) -> Column:
    """``@name`` and ``#topic`` lose their first character."""
    return F.regexp_replace(text, MENTION, "$1")


def normalize_spaces(text: Column) -> Column:
    """Every run of white space becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def strip(text: Column) -> Column:
    """Drop white space at both ends."""
    return F.regexp_replace(text, EDGE_SPACES, "")


def _where(text: Column, marks: tuple[str, ...], change) -> Column:
    """``change(text)`` where the text holds one of the marks; the rest is spared the pattern."""

    def step(t: Column) -> Column:
        found = F.lit(False)
        for mark in marks:
            found = found | F.contains(t, F.lit(mark))
        return F.when(found, change(t)).otherwise(t)

    return bind(text, step)


def clean_text(
    text: Column,
    remove_urls: bool = True,
    remove_html: bool = True,
    normalize_whitespace: bool = True,
    lowercase: bool = False,
) -> Column:
    """Cleaned text; a missing text becomes the empty string.

    Addresses are always removed, mentions and hashtags always unwrapped, emoji always kept.
    """
    out = F.coalesce(text, F.lit(""))
    if remove_html:
        out = strip_html(out)
    if remove_urls:
        out = _where(out, ("http", "www."), strip_urls)
    out = _where(out, ("@",), strip_emails)
    out = _where(out, ("@", "#"), unwrap_mentions)
    if normalize_whitespace:
        out = normalize_spaces(out)
    if lowercase:
        out = F.lower(out)
    return out


def tokens(text: Column) -> Column:
    """Runs of two or more word characters, case and accents kept."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def ngrams(words: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams with ``low <= n <= high``, shorter ones first, words joined by one space."""
    if not 1 <= low <= high:
        raise ValueError("n-gram range must satisfy 1 <= low <= high")

    def of_length(seq: Column, n: int) -> Column:
        if n == 1:
            return seq
        count = F.greatest(F.size(seq) - (n - 1), F.lit(0))
        joined = F.slice(seq, 1, count)
        for start in range(2, n + 1):
            joined = F.zip_with(
                joined, F.slice(seq, start, count), lambda left, right: F.concat(left, F.lit(" "), right)
            )
        return joined

    if (low, high) == (1, 1):
        return words
    return bind(words, lambda seq: F.concat(*[of_length(seq, n) for n in range(low, high + 1)]))


def term_counts(grams: Column) -> Column:
    """``array<struct<term, n>>`` of one row, counted inside the row.

    The array is sorted and cut where neighbours differ, so no shuffle and no hash table is
    needed to count the terms of a document.
    """

    def cut(ordered: Column) -> Column:
        size = F.size(ordered)
        starts = F.filter(
            F.sequence(F.lit(1), size),
            lambda i: (i == 1)
            | (F.element_at(ordered, i) != F.element_at(ordered, F.greatest(i - 1, F.lit(1)))),
        )
        runs = bind(
            starts,
            lambda s: F.zip_with(
                s,
                F.concat(F.slice(s, 2, F.size(s)), F.array(size + 1)),
                lambda begin, end: F.struct(
                    F.element_at(ordered, begin).alias("term"), (end - begin).cast("long").alias("n")
                ),
            ),
        )
        return F.when(size > 0, runs)

    return bind(F.sort_array(grams), cut)


def char_count(text: Column) -> Column:
    return F.char_length(text)


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters."""
    return F.regexp_count(text, F.lit(rf"[^{SPACE}]++"))


def shorten(text: Column, limit: int, mark: str = "") -> Column:
    """First ``limit`` characters, followed by ``mark`` where something was cut off."""
    head = F.substring(text, 1, limit)
    if not mark:
        return head
    return F.when(F.char_length(text) > limit, F.concat(head, F.lit(mark))).otherwise(text)


def lines(text: Column) -> Column:
    """Non-blank lines of a text, each stripped; positions are lost."""
    stripped = F.transform(F.split(text, "\n"), strip)
    return F.filter(stripped, lambda line: line != "")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def truncate_ids(ids: Column, max_length: int, pad_id: int | None = None) -> tuple[Column, Column]:
    """First ``max_length`` ids and their attention mask, filled up with ``pad_id`` if given."""
    kept = F.slice(ids, 1, max_length)
    mask = F.transform(kept, lambda _: F.lit(1))
    if pad_id is None:
        return kept, mask
    missing = F.lit(max_length) - F.size(kept)
    return (
        F.concat(kept, F.array_repeat(F.lit(pad_id), missing)),
        F.concat(mask, F.array_repeat(F.lit(0), missing)),
    )
