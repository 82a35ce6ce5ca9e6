"""URL, file-name and path expressions."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from semblance.functions.text import BLANKS, WORD
from semblance.settings import ARTICLE_HOSTS

# Scheme, then at least one host character or %hh escape, then everything up to a blank.
URL_PATTERN = rf"(?i)https?://(?:[-{WORD}.]|%[0-9a-f]{{2}})[^\n{BLANKS}]*"


def find_urls(content: Column) -> Column:
    """All URLs of a message in order; trailing punctuation stays part of the URL."""
    return F.regexp_extract_all(content, F.lit(URL_PATTERN), F.lit(0))


def fetch_url(url: Column) -> Column:
    """The address to download: a file view of a code host becomes its raw file."""
    is_view = url.contains("github.com") & url.contains("/blob/") & ~is_article(url)
    raw = F.replace(
        F.replace(url, F.lit("github.com"), F.lit("raw.githubusercontent.com")),
        F.lit("/blob/"),
        F.lit("/"),
    )
    return F.when(is_view, raw).otherwise(url)


def is_article(url: Column) -> Column:
    lowered = F.lower(url)
    return reduce(lambda a, b: a | b, [lowered.contains(host) for host in ARTICLE_HOSTS])


def url_kind(url: Column) -> Column:
    """``article``, ``repo`` or ``file``; the order of the tests matters."""
    target = fetch_url(url)
    is_repo = (
        target.contains("github.com")
        & ~target.contains("raw.githubusercontent.com")
        & ~target.contains("/blob/")
        & ~target.contains("/tree/")
    )
    return F.when(is_article(url), "article").when(is_repo, "repo").otherwise("file")


def last_segment(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def url_filename(url: Column, disposition: Column | None = None) -> Column:
    """File name of a download; a name in the Content-Disposition header wins."""
    from_url = F.substring_index(last_segment(url), "?", 1)
    if disposition is None:
        return from_url
    header = F.regexp_extract(disposition, r'filename="?([^"]+)"?', 1)
    return F.coalesce(F.nullif(header, F.lit("")), from_url)


def repo_name(url: Column) -> Column:
    return F.replace(last_segment(url), F.lit(".git"), F.lit(""))


def clean_name(name: Column) -> Column:
    """Keep letters, digits, underscore, blanks and hyphen; at most 100 characters."""
    kept = F.regexp_replace(name, rf"[^{WORD}\n{BLANKS}-]", "")
    return F.substring(F.regexp_replace(kept, rf"^[\n{BLANKS}]+|[\n{BLANKS}]+$", ""), 1, 100)


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def parse_url_box(text: Column) -> Column:
    """The non-blank, trimmed lines of a text box."""
    lines = F.transform(
        F.split(text, "\n"), lambda x: F.regexp_replace(x, rf"^[{BLANKS}]+|[{BLANKS}]+$", "")
    )
    return F.filter(lines, lambda x: x != "")


def merge_urls(new: Column, old: Column) -> Column:
    """New URLs first, then the old ones not among them; repeats inside a list survive."""
    return F.concat(new, F.filter(old, lambda x: ~F.array_contains(new, x)))


def urls_changed(old: Column, new: Column) -> Column:
    """Whether two lists differ when order is ignored."""
    return F.array_sort(old) != F.array_sort(new)


def glob_regex(pattern: str) -> str:
    """The whole-name regex of a shell pattern, in Java's dialect."""
    return r"\A" + fnmatch.translate(pattern).replace(r"\Z", r"\z")


def matches_patterns(name: Column, patterns: Sequence[str]) -> Column:
    """A name matches if a shell pattern fits it or contains its star-less start somewhere."""
    tests = [
        name.rlike(glob_regex(p)) | name.contains(p.lstrip("*"))
        for p in patterns
    ]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def keeps_member(path: Column, patterns: Sequence[str], exclude: bool = True) -> Column:
    """Archive rule: the whole member path is tested; directory entries never count as members."""
    return (matches_patterns(path, patterns) != F.lit(exclude)) & ~path.endswith("/")


def keeps_file(path: Column, patterns: Sequence[str], exclude: bool = True) -> Column:
    """Folder rule: the file name is tested and, when excluding, every parent folder as well."""
    keep = matches_patterns(last_segment(path), patterns) != F.lit(exclude)
    if exclude:
        parents = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
        keep = keep & ~F.exists(parents, lambda folder: matches_patterns(folder, patterns))
    return keep
