"""Article fields from HTML with built-in expressions."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from semblance.functions.text import BLANKS, normalize_ws

# A character reference, other text, or a lone ampersand; they tile a text.
REFERENCE_PATTERN = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});?|[^&]+|&"
BETWEEN, AFTER = "\x1e", "\x1f"


def _table(pairs: dict[str, str]) -> Column:
    """A map as one literal."""
    return F.str_to_map(F.lit(BETWEEN.join(f"{k}{AFTER}{v}" for k, v in pairs.items())), F.lit(BETWEEN), F.lit(AFTER))


def _numbered(number: Column) -> Column:
    """The character of a code point; those that browsers read as Windows-1252 are read so."""
    old = {str(c): bytes([c]).decode("cp1252", "replace") for c in range(0x80, 0xA0)}
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.coalesce(F.try_element_at(_table(old), number.cast("string")), F.when(valid, char), F.lit("\ufffd"))


def decode_entities(text: Column) -> Column:
    """All numeric and named character references; what is none stays as it is."""

    def decoded(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^&#([0-9]+);?$", 1)
        hexed = F.regexp_extract(piece, r"^&#[xX]([0-9a-fA-F]+);?$", 1)
        named = F.try_element_at(_table(html5), F.substr(piece, F.lit(2)))
        return (
            F.when(~F.startswith(piece, F.lit("&")) | (piece == "&"), piece)
            .when(digits != "", _numbered(digits.cast("bigint")))
            .when(hexed != "", _numbered(F.conv(hexed, 16, 10).cast("bigint")))
            .otherwise(F.coalesce(named, piece))
        )

    pieces = F.regexp_extract_all(text, F.lit(REFERENCE_PATTERN), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


# A tag: a sign between quotes does not end it, an equals sign without a closed quote is plain.
# Outside quotes it holds no second angle, so that text full of open tags is read once.
TAG_PATTERN = r"""<[/!?]?[A-Za-z][^<>=]*+(?:=(?:\s*+(?:"[^"]*"|'[^']*'))?[^<>=]*+)*+>"""
# One attribute inside a tag, its value with quotes.
ATTRIBUTE_PATTERN = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+))?"""
BLOCK_TAGS = (
    "address|blockquote|body|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|h[1-6]|header|hr|li|main|ol|p|pre|"
    "section|table|tbody|thead|tr|ul"
)
ARTICLE, HEADER = "A", "H"
# Elements that decide what belongs to the article: each has its sign on the stack of open ones.
# Small letters are silent; a header is silent outside an article only.
HOMES = {"article": ARTICLE, "header": HEADER} | {
    tag: chr(ord("a") + i)
    for i, tag in enumerate(("aside", "nav", "footer", "dialog", "menu", "template", "noscript", "title", "select", "textarea", "svg"))
}
OUTSIDE, INSIDE, SILENT = "o", "i", "s"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _trimmed(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, rf"^[\n{BLANKS}]+|[\n{BLANKS}]+$", ""), F.lit(""))


def _without_hidden(html: Column) -> Column:
    return F.regexp_replace(html, r"(?i)<script\b[\s\S]*?</script\s*>|<style\b[\s\S]*?</style\s*>|<!--[\s\S]*?-->", "")


def _attributes(tag: Column) -> Column:
    """``(name, value)`` of each attribute of a tag, names in small letters."""
    inner = F.regexp_replace(tag, r"^<[A-Za-z][^\s/>]*|>$", "")
    part = lambda group: F.regexp_extract_all(inner, F.lit(ATTRIBUTE_PATTERN), F.lit(group))
    return F.zip_with(
        part(1), part(2),
        lambda name, value: F.struct(F.lower(name).alias("name"), F.regexp_replace(value, r"""^["']|["']$""", "").alias("value")),
    )


def _meta(html: Column) -> Column:
    """``(key, content)`` of each meta element, whatever the order and quotes of its attributes."""
    tags = F.regexp_extract_all(_without_hidden(html), F.lit(r"(?i)(?=<meta[\s/])" + TAG_PATTERN), F.lit(0))

    def described(attributes: Column) -> Column:
        keys = F.filter(attributes, lambda a: a["name"].isin("name", "property", "itemprop"))
        contents = F.filter(attributes, lambda a: a["name"] == "content")
        return F.struct(
            F.transform(keys, lambda a: F.lower(a["value"])).alias("keys"),
            _trimmed(_let(F.get(contents, F.lit(0))["value"], decode_entities)).alias("content"),
        )

    return F.filter(F.transform(tags, lambda tag: _let(_attributes(tag), described)), lambda m: m["content"].isNotNull())


def _under(meta: Column, key: str) -> Column:
    return F.filter(meta, lambda m: F.array_contains(m["keys"], key))


def _contents(html: Column, *keys: str) -> Column:
    """What the page's meta elements say under these keys, the first key first."""
    def under(meta: Column) -> Column:
        each = [_under(meta, key) for key in keys]
        return F.transform(F.concat(*each), lambda m: m["content"])

    return _let(_meta(html), under)


def page_title(html: Column) -> Column:
    """The title element, else what meta elements give, else the first headline."""
    visible = _without_hidden(html)
    inner = lambda tag: F.regexp_extract(visible, rf"(?i)<{tag}(?:\s[^>]*)?>([\s\S]*?)</{tag}\s*>", 1)
    text = lambda tag: _trimmed(_let(F.regexp_replace(inner(tag), TAG_PATTERN, ""), decode_entities))
    return F.coalesce(text("title"), F.get(_contents(html, "og:title"), F.lit(0)), text("h1"))


def page_authors(html: Column) -> Column:
    """All authors the page names, each once; an address of a profile is no name."""
    named = F.filter(_contents(html, "author", "article:author", "dc.creator"), lambda a: ~a.rlike("(?i)^https?://"))
    return F.nullif(F.array_join(F.array_distinct(named), ", "), F.lit(""))


def page_date(html: Column) -> Column:
    return F.get(_contents(html, "article:published_time", "datepublished", "dc.date"), F.lit(0))


def _homes(pieces: Column) -> Column:
    """For each piece, one sign: inside an article, outside of all, or silent.

    A fold with a stack: an opening tag is pushed, a closing tag closes all that was opened after
    its own opening, and one that closes nothing is passed over. Both the stack and the result are
    texts of one sign per tag, so long pages cost little.
    """
    signs = _table(HOMES)

    def step(state: Column, piece: Column) -> Column:
        sign = F.try_element_at(signs, F.lower(F.regexp_extract(piece, r"^</?([A-Za-z]+)", 1)))
        still = F.length(state["open"]) - F.length(F.call_function("substring_index", state["open"], sign, F.lit(-1))) - 1
        opened = (
            F.when(sign.isNull(), state["open"])
            .when(~F.startswith(piece, F.lit("</")), F.concat(state["open"], sign))
            .when(F.contains(state["open"], sign), F.left(state["open"], still))
            .otherwise(state["open"])
        )

        def placed(now: Column) -> Column:
            home = (
                F.when(now.rlike(f"[a-z]|^[^{ARTICLE}]*{HEADER}"), SILENT)
                .when(F.contains(now, F.lit(ARTICLE)), INSIDE).otherwise(OUTSIDE)
            )
            return F.struct(now.alias("open"), F.concat(state["homes"], home).alias("homes"))

        return _let(opened, placed)

    start = F.struct(F.lit("").alias("open"), F.lit("").alias("homes"))
    return F.aggregate(pieces, start, step, lambda state: state["homes"])


def _plain(markup: Column) -> Column:
    lines = F.regexp_replace(markup, rf"(?i)(?=</?(?:{BLOCK_TAGS})[\s/>])" + TAG_PATTERN, "\n")
    cells = F.regexp_replace(lines, r"(?i)(?=</?t[dh][\s/>])" + TAG_PATTERN, " ")
    bare = F.regexp_replace(cells, TAG_PATTERN, "")
    return F.nullif(normalize_ws(_let(bare, decode_entities)), F.lit(""))


def page_text(html: Column) -> Column:
    """The text of the page's articles as plain lines, one per block.

    All articles count, without their asides, menus and footers. A page without text in an article
    gives all that lies in no silent element.
    """
    border = "(?i)(?=</?(?:" + "|".join(HOMES) + r")[\s/>])"

    def text(pieces: Column) -> Column:
        def chosen(homes: Column) -> Column:
            of = lambda home: _plain(F.array_join(
                F.array_compact(F.zip_with(pieces, F.split(homes, ""), lambda p, h: F.when(h == home, p))), "\n"))
            return F.coalesce(of(INSIDE), of(OUTSIDE))

        return _let(_homes(pieces), chosen)

    return _let(F.split(_without_hidden(html), border), text)
