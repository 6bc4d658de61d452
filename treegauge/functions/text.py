"""Tokenising, splitting, link extraction and chunking as expressions.

The searchable form of a text is one string in which every token has two spaces
on either side (`"  tok  tok  "`).  Token and phrase counts are then plain string
replacement and stay inside generated code; no array of tokens is built unless
an index is written.
"""

from __future__ import annotations

import unicodedata
from itertools import groupby

from pyspark.sql import Column, functions as F

# Link shapes and chunk geometry.
WIKILINK = r"\[\[([^\]|#]+)(?:\|[^\]]*)?\]\]"
INLINE_LINK = r"(?<!!)\[[^\]]*\]\(([^)\s]+)\)"
CHUNK_CHARS = 1000
CHUNK_OVERLAP = 100
HEAD = 8192

TOKEN_BREAK = r"[^\p{L}\p{N}\p{Co}]+"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _accent_map() -> tuple[str, str]:
    """Accented Latin letters and their base letter, derived from Unicode."""
    plain: dict[str, str] = {}
    for block in (range(0x00C0, 0x0250), range(0x1E00, 0x1F00)):
        for code in block:
            letter = chr(code)
            base = unicodedata.normalize("NFD", letter)[0]
            if base != letter and letter == letter.lower():
                plain[letter] = base
    # `translate` drops source characters beyond the target's length, which
    # is how combining marks written on their own disappear.
    marks = "".join(chr(code) for code in range(0x0300, 0x0370))
    return "".join(plain) + marks, "".join(plain.values())


_ACCENTED, _BASE = _accent_map()


def fold(text) -> Column:
    """Case-folded text without diacritics."""
    return F.translate(F.lower(_col(text)), _ACCENTED, _BASE)


def fold_word(word: str) -> str:
    """The same folding for a driver-side query string."""
    return word.lower().translate(
        {ord(c): (_BASE[i] if i < len(_BASE) else None)
         for i, c in enumerate(_ACCENTED)})


def searchable(text) -> Column:
    """`"Ab-c d"` -> `"  ab  c  d  "`; empty text gives the two end spaces.

    One expression without branches, so the text is folded once.
    """
    return F.regexp_replace(F.concat(F.lit(" "), fold(text), F.lit(" ")), TOKEN_BREAK, "  ")


def token_count(form) -> Column:
    """Tokens in a searchable string: its space pairs, less one."""
    form = _col(form)
    spaces = F.length(form) - F.length(F.replace(form, F.lit(" "), F.lit("")))
    return F.shiftright(spaces, 1) - F.lit(1)


def tokens(form) -> Column:
    return F.array_remove(F.split(F.trim(_col(form)), "  ", -1), "")


def occurrences(form, phrase: list[str]) -> Column:
    """How often the token sequence `phrase` occurs in a searchable string."""
    form = _col(form)
    needle = "".join(" %s " % token for token in phrase)
    borders = any(phrase[:n] == phrase[-n:] for n in range(1, len(phrase)))
    if borders:
        # The phrase can overlap itself, so count starting positions.
        return F.regexp_count(form, F.lit("(?=%s)" % needle))
    return ((F.length(form) - F.length(F.replace(form, F.lit(needle), F.lit(""))))
            / F.lit(len(needle))).cast("int")


def query_phrases(raw: str) -> list[list[str]]:
    """The words of a query as phrases; query syntax is never interpreted.

    White space parts words and a quote counts for nothing.  A word without an
    ASCII letter or digit asks for nothing.  Anything else that is no token
    character ends a token, so a word with separators inside is a phrase.
    """
    phrases = []
    for word in raw.replace('"', "").split():
        if not any(c.isascii() and c.isalnum() for c in word):
            continue
        phrase = [""]
        for c in fold_word(word):
            # Same classes as TOKEN_BREAK, decided by Unicode category.
            if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
                phrase[-1] += c
            elif phrase[-1]:
                phrase.append("")
        phrases.append([token for token in phrase if token])
    return phrases


#: Fixed value: what a name consists of in a search for names.
_NAME_MARKS = frozenset("_.-")


def name_terms(raw: str) -> list[str]:
    """Runs of name characters in a query, in lower case."""
    runs = groupby(raw, lambda c: c in _NAME_MARKS or c.isascii() and c.isalnum())
    return ["".join(run).lower() for named, run in runs if named]


# -- identifiers ------------------------------------------------------------

# Where a word comes apart, applied in this order.
BOUNDARIES = (
    r"(?<=[A-Za-z])(?=[0-9])",
    r"(?<=[0-9])(?=[A-Za-z])",
    r"(?<=[A-Z])(?=[A-Z][a-z])",
    r"(?<=[a-z])(?=[A-Z])",
)

WORD = r"[0-9A-Za-z_.\-/]+"

# An inner boundary; a word without one cannot split.
_SPLITS = (r"[0-9A-Za-z][_.\-/]+[0-9A-Za-z]|[a-z][A-Z]|[A-Za-z][0-9]"
           r"|[0-9][A-Za-z]|[A-Z][A-Z][a-z]")


#: A whole word that comes apart; words of small letters, but for the first, are passed over at once.
_SPLITTABLE = (r"(?<![0-9A-Za-z_.\-/])(?![A-Z]?[a-z]*+(?![0-9A-Za-z_.\-/]))"
               r"(?=[0-9A-Za-z_.\-/]*?(?:%s))[0-9A-Za-z_.\-/]++" % _SPLITS)


def splittable_words(text) -> Column:
    """Every word occurrence of `text` that comes apart."""
    return F.regexp_extract_all(_col(text), F.lit(_SPLITTABLE), F.lit(0))


def split_identifier(word) -> Column:
    """`getUserById` -> `[get, user, by, id]`."""
    spaced = F.regexp_replace(_col(word), r"[^0-9A-Za-z]+", " ")
    for boundary in BOUNDARIES:
        spaced = F.regexp_replace(spaced, boundary, " ")
    return F.filter(F.split(F.lower(F.trim(spaced)), " +", -1), lambda t: t != "")


def symbol_tokens(text) -> Column:
    """Distinct sorted parts of every word in `text` that comes apart."""
    words = F.array_distinct(splittable_words(text))
    parts = F.filter(F.transform(words, split_identifier), lambda p: F.size(p) > 1)
    return F.array_sort(F.array_distinct(F.flatten(parts)))


def symbols(text) -> Column:
    return F.array_join(symbol_tokens(text), " ")


# -- links ------------------------------------------------------------------

def wikilinks(text) -> Column:
    return F.transform(
        F.regexp_extract_all(_col(text), F.lit(WIKILINK), F.lit(1)), strip)


def inline_links(text) -> Column:
    return F.transform(
        F.regexp_extract_all(_col(text), F.lit("(?U)" + INLINE_LINK), F.lit(1)), strip)


# -- white space and chunks ---------------------------------------------------

def strip(text) -> Column:
    """Trim all Unicode white space, not only spaces."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def chunk_pieces(text, longest: int | None = None) -> Column:
    """Overlapping windows of the whole text, stripped, blanks dropped.

    `longest` leaves out what lies beyond so many characters; by default
    nothing is left out.

    Windows start every 900 characters and hold 1000; the last one reaches the
    end.  Text with a NUL in its head is not prose and gives none.
    """
    text = _col(text) if longest is None else F.substring(_col(text), 1, longest)
    step = CHUNK_CHARS - CHUNK_OVERLAP
    last = F.greatest(F.length(text) - F.lit(CHUNK_OVERLAP + 1), F.lit(0))
    windows = F.transform(
        F.sequence(F.lit(0), last, F.lit(step)),
        lambda start: strip(F.substring(text, start + F.lit(1), F.lit(CHUNK_CHARS))))
    return (F.when(text.isNull() | F.contains(F.substring(text, 1, HEAD), F.lit("\0")),
                   F.array().cast("array<string>"))
            .otherwise(F.filter(windows, lambda piece: piece != "")))
