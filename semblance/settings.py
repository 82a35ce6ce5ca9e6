"""Limits, defaults and fixed lists used by the jobs."""

from __future__ import annotations

from dataclasses import dataclass

# Limits, lifetimes and defaults that results depend on.
MAX_TEXT_BYTES = 5 * 1024 * 1024
# A row of a combined submission holds about so much text; larger ones come in several parts.
PART_BYTES = 16 * 1024 * 1024
PART_BORDER = "\n\n"
BUFFER_TTL_SECONDS = 3600
CHUNK_TOKENS = 512
CHUNK_OVERLAP = 50
TOP_K = 10
BLOCK_THRESHOLD = 0.6
MIN_TOKENS = 10
MAX_BLOCK_MATCHES = 20
MAX_TOKEN_MATCHES = 10
MATCHED_TEXT_CHARS = 500
MESSAGE_LIMIT = 500
SHAPE_GRAM = 3
# Fixed value: the line between the code cells of a notebook.
NOTEBOOK_SEPARATOR = "\n\n# === CELL SEPARATOR ===\n\n"

# How many ways a join key is split when one key may hold a large share of all rows: one part per
# so many shuffle partitions.
PARTITIONS_PER_SALT = 32
MIN_SALTS = 2
# A key with more rows, or bytes of text, than this is split into parts of about this size.
ROWS_PER_PART = 100_000
BYTES_PER_PART = 64 * 1024 * 1024
# A pair whose text lengths multiply to more than this is scored tile by tile, in tiles of so many
# characters on each side.
CELLS_PER_CALL = 1 << 36
TILE_CHARS = 1 << 18
# Cells of a vector index, learned in so many rounds on at most so many vectors.
CELLS = 256
CELL_SAMPLE = 8_192
CELL_ROUNDS = 10
# Largest table that may be broadcast, in rows and in bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024
# Largest table of target blocks whose grams every task holds, at 16 bytes a token.
FORM_BYTES = 4 * 1024 * 1024
# Most frequent terms that are broadcast where all of them are too many.
BROADCAST_TERMS = 100_000
# Texts whose counts are sorted where they are made go to so many tasks per split of the input.
PIECES_PER_SPLIT = 4

# Junk left by operating systems, always filtered.
OS_JUNK_PATTERNS = [
    ".DS_Store", "._*", "__MACOSX", "Thumbs.db", "desktop.ini", "$RECYCLE.BIN", ".Trash-*",
]
# Patterns excluded unless the user chooses others.
DEFAULT_IGNORE_PATTERNS = ["*.xlsx", "*.pdf", "*.git", "__pycache__"]

# Hosts whose pages are read as articles.
ARTICLE_HOSTS = [
    "medium.com", ".medium.com", "towardsdatascience.com", "betterprogramming.pub",
    "levelup.gitconnected.com", "blog.devgenius.io", "javascript.plainenglish.io",
    "python.plainenglish.io", "aws.plainenglish.io",
]

# Python's reserved words.
PYTHON_KEYWORDS = [
    "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class",
    "continue", "def", "del", "elif", "else", "except", "finally", "for", "from", "global",
    "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass", "raise", "return",
    "try", "while", "with", "yield",
]


@dataclass(frozen=True)
class TextOptions:
    """Which normalisation steps a preprocessing job applies."""

    remove_comments: bool = True
    normalize_whitespace: bool = True
    preserve_variable_names: bool = False
    preserve_literals: bool = False
