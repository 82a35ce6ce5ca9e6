"""Source-code tokens and their shape classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.functions.text import BLANKS, WORD
from semblance.settings import PYTHON_KEYWORDS

STRING_PATTERN = (
    r"\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}"
    r'|"[^"\\\n]*(?:\\[^\n][^"\\\n]*)*"'
    r"|'[^'\\\n]*(?:\\[^\n][^'\\\n]*)*'"
)
# Strings, numbers, names, two-character operators, line feeds, then any other visible sign.
CODE_TOKEN_PATTERN = (
    rf"{STRING_PATTERN}|[0-9][{WORD}]*(?:\.[0-9][{WORD}]*)?"
    rf"|[{WORD}]+"
    r"|\*\*|//|==|!=|<=|>=|->|<<|>>|\n"
    rf"|[^\n{BLANKS}{WORD}]"
)
# Signs counted as operators.
OPERATORS = [
    "+", "-", "*", "/", "//", "%", "**", "<<", ">>", "|", "^", "&", "@", "~",
    "==", "!=", "<", "<=", ">", ">=",
]
# Statement keywords counted as control flow.
CONTROL_FLOW = {"if": "If", "elif": "If", "for": "For", "while": "While", "try": "Try"}


# Text, strings and comments, which tile a source text.
PIECE_PATTERN = rf"{STRING_PATTERN}|#[^\n]*|[^\"'#]+|[\"']"
HIDDEN, CONTINUED = "\x01", "\x02"


def hide_strings(code: Column) -> Column:
    """A source text with the content of its strings replaced, line by line.

    The first line of a string keeps its place with ``HIDDEN`` in it; its later lines begin with
    ``CONTINUED``. Line feeds stay, so lines keep their numbers.
    """
    pieces = F.regexp_extract_all(code, F.lit(PIECE_PATTERN), F.lit(0))

    def shown(piece: Column) -> Column:
        hidden = F.regexp_replace(piece, r"[^\n]+", HIDDEN)
        return F.when(is_string(piece), F.regexp_replace(hidden, f"\n{HIDDEN}?", f"\n{CONTINUED}")).otherwise(piece)

    return F.array_join(F.transform(pieces, shown), "")


def without_comments(code: Column) -> Column:
    """A source text without its comments; a ``#`` inside a string stays."""
    pieces = F.regexp_extract_all(code, F.lit(PIECE_PATTERN), F.lit(0))
    return F.array_join(F.filter(pieces, lambda piece: ~F.startswith(piece, F.lit("#"))), "")


def code_tokens(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(CODE_TOKEN_PATTERN), F.lit(0))


def with_neighbours(toks: Column) -> Column:
    """Each token ``t`` with the one before it, ``b``, and the one after it, ``a``."""
    n = F.size(toks)
    none = F.array(F.lit(None).cast("string"))
    return F.arrays_zip(
        toks.alias("t"), F.slice(F.concat(none, toks), 1, n).alias("b"), F.slice(toks, 2, n).alias("a")
    )


def explode_tokens(df: DataFrame, tokens_col: str) -> DataFrame:
    """One row per token with its neighbours, built without a window."""
    kept = [c for c in df.columns if c != tokens_col]
    rows = df.select(*kept, F.explode(with_neighbours(F.col(tokens_col))).alias("z"))
    return rows.select(
        *kept, F.col("z.t").alias("token"), F.col("z.b").alias("before"), F.col("z.a").alias("after")
    )


def _first(token: Column) -> Column:
    return F.substring(token, 1, 1)


def is_string(token: Column) -> Column:
    return _first(token).isin('"', "'") & (F.length(token) > 1)


def _begins(token: Column, first: str, last: str) -> Column:
    """Whether a token begins with one of some neighbouring ASCII characters, seen from its order."""
    return (token >= first) & (token < chr(ord(last) + 1))


def is_number(token: Column) -> Column:
    return _begins(token, "0", "9") | token.isin("True", "False")


def is_name(token: Column) -> Column:
    plain = _begins(token, "a", "z") | _begins(token, "A", "Z") | _begins(token, "_", "_")
    # Only other scripts need a pattern.
    return (plain | (token >= "\x80") & token.rlike(rf"^[{WORD}]")) & ~_begins(token, "0", "9") & ~token.isin(PYTHON_KEYWORDS)


def is_call(token: Column, before: Column, after: Column) -> Column:
    defines = F.coalesce(before.isin("def", "class"), F.lit(False))
    return F.coalesce(after == "(", F.lit(False)) & ~defines & is_name(token)


def starts_statement(before: Column) -> Column:
    return before.isNull() | before.isin("\n", ";")


def shape(token: Column, before: Column, after: Column, preserve_names: bool = False) -> Column:
    """Literals and, unless preserved, names lose their identity; keywords and signs stay."""
    literal = F.when(is_string(token), "STR").when(is_number(token), "0")
    if preserve_names:
        return literal.otherwise(token)
    defines = F.coalesce(before.isin("def", "class"), F.lit(False))
    called = F.coalesce(after == "(", F.lit(False)) & ~defines
    return literal.when(is_name(token), F.when(called, "CALL").otherwise("W")).otherwise(token)
