"""Text operators as native column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .norm import col, text_list

#: Line ends as Python's splitlines knows them.
_LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
_WIKILINK = r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"

# Markup and what it leaves, in the order of application.
# A link between pages takes two steps, as a replacement cannot fall back from an empty group to another.
PLAIN_STEPS = (
    (r"(?i)<br\s*/?>", " "),
    (r"\[\[[^\]|#]+(?:#[^\]|]+)?\|([^\]]+)\]\]", "$1"),
    (r"\[\[([^\]|#]+)(?:#[^\]|]+)?\]\]", "$1"),
    (r"\[([^\]]+)\]\([^\)]+\)", "$1"),
    (r"`([^`\n]+)`", "$1"),
    (r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", "$2"),
    (r"~~(?=\S)(.+?)(?<=\S)~~", "$1"),
    (r"(?<!\*)\*(?=\S)(.+?)(?<=\S)\*(?!\*)", "$1"),
    (r"(?<![\w_])_(?=\S)(.+?)(?<=\S)_(?![\w_])", "$1"),
    (r"(?m)^\s{0,3}#{1,6}\s+", ""),
    (r"(?m)^\s*>\s?", ""),
    (r"\s+", " "),
)
#: The steps that need neither look-around nor back-reference.
SIMPLE_STEPS = tuple(s for s in PLAIN_STEPS if "(?=" not in s[0] and "(?<" not in s[0])


def lines(x: Column | str) -> Column:
    """Lines of a text; one final line end makes no further line."""
    parts = F.split(col(x), _LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _as_in_python(pattern: str) -> str:
    """The pattern for Java with the blanks, word letters and line ends that Python's re knows."""
    pattern = pattern.replace(r"[\w_]", r"[\p{L}\p{N}_]").replace(r"\s", r"[\s\x1c-\x1f]").replace(r"\S", r"[^\s\x1c-\x1f]")
    return f"(?Ud){pattern}"


def plain_text(x: Column | str, steps=PLAIN_STEPS) -> Column:
    """Text without markup, blanks collapsed; null stays null."""
    c = col(x)
    for pattern, left in steps:
        c = F.regexp_replace(c, _as_in_python(pattern), left)
    return F.trim(c)


def heading_fragment(x: Column | str) -> Column:
    """Anchor of a heading: letters and digits joined by -, 'section' if none is left."""
    c = F.regexp_replace(F.lower(plain_text(x)), r"[`*_~]", "")
    c = F.regexp_replace(c, "[^0-9a-z가-힣]+", "-")
    c = F.regexp_replace(c, "^-+|-+$", "")
    return F.when(c == "", "section").otherwise(c)


def wiki_targets(x: Column | str) -> Column:
    """Link targets of an array of texts, in order; a text without a link is itself one unless a URL."""

    def one(v: Column) -> Column:
        found = F.transform(F.regexp_extract_all(v, F.lit(_WIKILINK), F.lit(1)), lambda v: F.trim(v))
        own = F.when(v.rlike(r"(?i)^https?://"), F.array().cast("array<string>")).otherwise(F.array(v))
        return F.when(F.size(found) > 0, found).otherwise(own)

    return F.flatten(F.transform(text_list(x), one))


def claim_marker(x: Column | str) -> Column:
    """Claim id at the end of a block text, '' if there is none."""
    return F.regexp_extract(col(x), r"(?:^|\s)\^([a-z][a-z0-9-]{0,63})\s*$", 1)


def without_marker(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"(?:^|\s)\^[a-z][a-z0-9-]{0,63}\s*$", "")


def html_escape(x: Column | str) -> Column:
    c = col(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def slug(title: Column | str, key: Column | str, length: int = 48) -> Column:
    """Readable part in ASCII and the first 8 hex digits of the key's SHA-256."""
    c = F.regexp_replace(F.lower(col(title)), "[^a-z0-9]+", "-")
    c = F.regexp_replace(F.substring(c, 1, length), "^-+|-+$", "")
    return F.concat_ws("-", F.nullif(c, F.lit("")), F.substring(F.sha2(col(key), 256), 1, 8))


def accents() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by decomposition."""
    pairs = []
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(c))[0]
        if base != chr(c) and base.isalpha() and chr(c).lower() == chr(c):
            pairs.append((chr(c), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def search_hay(x: Column | str) -> Column:
    """Index terms of a text, each between blanks, two blanks apart; null gives none.

    Lower case, accents of Latin letters removed, letters and digits only.
    """
    accented, base = accents()
    c = F.lower(F.coalesce(col(x), F.lit("")))
    marked = F.translate(F.regexp_replace(c, r"\p{Mn}+", ""), accented, base)
    c = F.when(c.rlike(r"[\u00C0-\u024F\u1E00-\u1EFF]|\p{Mn}"), marked).otherwise(c)
    return F.regexp_replace(F.concat(F.lit(" "), c, F.lit(" ")), r"[^\p{L}\p{N}\p{Co}]+", "  ")


def search_tokens(x: Column | str) -> Column:
    """Index terms of a text in order."""
    return F.filter(F.split(search_hay(x), "  "), lambda t: t != "")


def support_labels(x: Column | str, groups: dict[str, tuple[str, ...]], default: str) -> Column:
    """Labels of an array of texts: of each the first group with a needle in it; distinct, in order."""

    def label(v: Column) -> Column:
        c = F.lit(default)
        for name, needles in reversed(groups.items()):
            hit = F.lit(False)
            for n in needles:
                hit = hit | F.contains(v, F.lit(n))
            c = F.when(hit, F.lit(name)).otherwise(c)
        return c

    return F.array_distinct(F.transform(text_list(x), label))


def toc_entries(html: Column | str) -> Column:
    """id and label of the second- to fourth-level headings of an HTML text, in order."""
    pattern = r"(?s)<h[2-4][^>]*\sid=\"([^\"]*)\"[^>]*>(.*?)</h[2-4]>"
    ids = F.regexp_extract_all(col(html), F.lit(pattern), F.lit(1))
    labels = F.transform(
        F.regexp_extract_all(col(html), F.lit(pattern), F.lit(2)), lambda v: F.trim(F.regexp_replace(v, "<[^>]*>", ""))
    )
    return F.arrays_zip(ids.alias("id"), labels.alias("label"))


def body_sections(message: Column | str) -> Column:
    """Names of the lines 'Name:' of a message, in order."""
    return F.regexp_extract_all(F.coalesce(col(message), F.lit("")), F.lit(r"(?m)^([A-Za-z가-힣][\w가-힣 -]*):"), F.lit(1))


def decision_number(x: Column | str) -> Column:
    """A decision's number without remarks in brackets and blanks, '' if there is none."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"\([^)]*\)", ""), r"(?U)\s+", "")
