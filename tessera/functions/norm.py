"""Column helpers that carry the null semantics of all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentinels of the data model.
OPEN_END = "9999-12-31"
UNKNOWN_START = "1900-01-01"
#: Day number that stands for an open end; later than any real date.
OPEN_DAY = 4_000_000

_BLANKS = " \t\n\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def scalar_text(x: Column | str) -> Column:
    """Trimmed text; null gives ''."""
    return F.coalesce(F.trim(col(x)), F.lit(""))


def first_text(*xs: Column | str) -> Column:
    """First value that is neither null nor blank, else ''."""
    return F.coalesce(*[F.nullif(F.trim(col(x)), F.lit("")) for x in xs], F.lit(""))


def text_list(x: Column | str) -> Column:
    """Array of trimmed non-blank elements in their order; null gives an empty array."""
    return F.coalesce(F.filter(F.transform(col(x), scalar_text), lambda v: v != ""), F.array().cast("array<string>"))


def ordered_distinct(x: Column | str) -> Column:
    """Distinct non-blank elements, each at its first place."""
    return F.array_distinct(text_list(x))


def reference_key(x: Column | str) -> Column:
    """Reference in lower case without surrounding blanks of any kind; null stays null."""
    return F.btrim(F.lower(col(x)), F.lit(_BLANKS))


def normalized_ref(x: Column | str) -> Column:
    """Page reference: forward slashes, no leading ./ or /, no .md, lower case."""
    p = F.regexp_replace(F.trim(col(x)), r"\\", "/")
    p = F.regexp_replace(p, r"^\./", "")
    p = F.regexp_replace(p, r"^/+", "")
    return F.lower(F.regexp_replace(p, r"(?i)\.md$", ""))


def basename(x: Column | str) -> Column:
    return F.regexp_extract(col(x), r"([^/]*)$", 1)


def strict_date(x: Column | str) -> Column:
    """DATE if the text has the form YYYY-MM-DD and names an existing day, else null."""
    c = col(x)
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}\z") & ~c.startswith("0000"), c.try_cast("date"))


def day_number(x: Column | str) -> Column:
    """Days since 1970-01-01 of a strict date, else null."""
    return F.unix_date(strict_date(x))


def is_open_end(x: Column | str) -> Column:
    c = col(x)
    return c.isNull() | (c == "") | (c == OPEN_END)


def end_day(x: Column | str, inclusive: bool) -> Column:
    """First day after the interval; OPEN_DAY for an open end; null for no date."""
    return F.when(is_open_end(x), F.lit(OPEN_DAY)).otherwise(day_number(x) + F.lit(1 if inclusive else 0))


def day_text(x: Column | str) -> Column:
    return F.date_from_unix_date(col(x).cast("int")).cast("string")


def percent_encode(x: Column | str) -> Column:
    """Percent-encoding with no safe characters beyond letters, digits and _.-~"""
    c = F.replace(F.url_encode(col(x)), F.lit("+"), F.lit("%20"))
    c = F.replace(c, F.lit("*"), F.lit("%2A"))
    return F.replace(c, F.lit("%7E"), F.lit("~"))


def claim_node(entity: Column | str, claim: Column | str) -> Column:
    return F.concat(F.lit("claim:"), percent_encode(entity), F.lit("#"), percent_encode(claim))


def evidence_node(entity: Column | str, evidence: Column | str) -> Column:
    return F.concat(F.lit("evidence:"), percent_encode(entity), F.lit("#"), percent_encode(evidence))


def source_node(source: Column | str) -> Column:
    return F.concat(F.lit("source:"), percent_encode(source))


def edge_id(source: Column | str, relation: Column | str, target: Column | str) -> Column:
    nul = F.lit("\0")
    joined = F.concat(col(source), nul, col(relation), nul, col(target))
    return F.concat(F.lit("edge-"), F.substring(F.sha2(joined, 256), 1, 16))
