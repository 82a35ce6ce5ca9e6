"""Text normalisation and tokenising as built-in column expressions.

The patterns name their character classes in full because Java and RE2 disagree on ``\\s`` and
``\\w``. Repeated groups are avoided so that long inputs cannot exhaust the regex stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from semblance.settings import CHUNK_OVERLAP, CHUNK_TOKENS, MAX_TEXT_BYTES, TextOptions

# The characters Python treats as white space, without the line feed.
BLANKS = r"\t\x0B\x0C\r\x1C-\x1F\x85\p{Z}"
# Letters, digits and underscore in any script.
WORD = r"\p{L}\p{N}_"
TOKEN_PATTERN = rf"([{WORD}]+|[^\n{BLANKS}{WORD}])"
TERM_PATTERN = rf"[{WORD}]{{2,}}"
DOCSTRING_PATTERN = r"""(?dm)^[ \t]*(?:\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3})"""
QUOTED_PATTERN = (
    r"\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}"
    r'|"(?:[^"\\\n]|\\[^\n])[^"\\\n]*(?:\\[^\n][^"\\\n]*)*"'
    r"|'(?:[^'\\\n]|\\[^\n])[^'\\\n]*(?:\\[^\n][^'\\\n]*)*'"
)
NUMBER_PATTERN = rf"(^|[^{WORD}.])[0-9][{WORD}]*(?:\.[0-9][{WORD}]*)?"


def is_nonblank(text: Column) -> Column:
    return text.rlike(rf"[^\n{BLANKS}]")


def size_error(text: Column, limit: int = MAX_TEXT_BYTES) -> Column:
    """NULL for a text within the limit, otherwise the reason it gets no features."""
    size = F.octet_length(text)
    return F.when(
        size > limit,
        F.concat(F.lit("too large: "), size.cast("string"), F.lit(f" > {limit} bytes")),
    )


def strip_comments(text: Column) -> Column:
    """Cut every line at its first ``#`` and drop string statements that open a line."""
    cut = F.regexp_replace(text, r"#[^\n]*", "")
    return F.regexp_replace(cut, DOCSTRING_PATTERN, "")


def normalize_ws(text: Column) -> Column:
    """Collapse blanks inside lines, trim lines and drop the blank ones."""
    collapsed = F.regexp_replace(text, rf"[{BLANKS}]+", " ")
    joined = F.regexp_replace(collapsed, r"[ \n]*\n[ \n]*", "\n")
    return F.regexp_replace(joined, r"^[ \n]+|[ \n]+$", "")


def anonymize_literals(text: Column) -> Column:
    """Non-empty strings become ``'STR'``; numbers and truth values become ``0``."""
    strings = F.regexp_replace(text, QUOTED_PATTERN, "'STR'")
    numbers = F.regexp_replace(strings, NUMBER_PATTERN, "$1" + "0")
    return F.regexp_replace(numbers, r"\b(?:True|False)\b", "0")


def preprocess(text: Column, options: TextOptions = TextOptions()) -> Column:
    if options.remove_comments:
        text = strip_comments(text)
    if options.normalize_whitespace:
        text = normalize_ws(text)
    if not options.preserve_literals:
        text = anonymize_literals(text)
    return text


def tokens(text: Column) -> Column:
    """Words and single punctuation marks, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(1))


def terms(text: Column) -> Column:
    """Lower-case words of two or more characters, the unit of the TF-IDF weights."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0))


def characters(text: Column) -> Column:
    # A cut at nothing gives the characters without a search; of an empty text it would give one.
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def line_tokens(text: Column) -> Column:
    """One token array per line; flattening it gives the token sequence of the text."""
    return F.transform(F.split(text, "\n"), tokens)


def content_hash(text: Column) -> Column:
    """The first 16 hexadecimal digits of the MD5 of the UTF-8 bytes."""
    return F.substring(F.md5(text), 1, 16)


def chunk_starts(n_tokens: Column, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Offsets of the token windows; a last window inside its predecessor is left out."""
    step = size - overlap
    offsets = F.sequence(F.lit(0), F.greatest(n_tokens - 1, F.lit(0)), F.lit(step))
    return F.filter(offsets, lambda i: (i == 0) | (n_tokens - i > overlap))
