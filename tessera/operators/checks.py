"""Rules over raw records: presence, type, emptiness, uniqueness and reference of fields.

Raw records keep three states apart: a key that is absent, one that is null,
and one that is empty.  A record is a VARIANT; ``schema_of_variant`` tells the
type of what is present.  Every rule gives rows of the issue form (severity,
code, path, field, message).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import page_parts
from ..functions.norm import normalized_ref, reference_key
from ..session import broadcast_if_small, lookup_join
from .graph import issue
from .resolve import duplicates

#: Kinds that a field may be required to have, by the type name of a variant.
KINDS = {"text": ("STRING",), "list": ("ARRAY",), "map": ("OBJECT",), "int": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "bool": ("BOOLEAN",)}


@dataclass(frozen=True)
class Field:
    """What a field of a record has to be."""

    name: str
    kind: str = "text"
    required: bool = False
    blank_allowed: bool = True
    null_allowed: bool = False


def _kind(v: Column) -> Column:
    """Type name of a variant: STRING, BIGINT, ARRAY, OBJECT, VOID (null) ...; null if absent."""
    return F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)


def field_issues(records: DataFrame, record: str, path: str, fields: list[Field], prefix: str, closed: bool = True) -> DataFrame:
    """Issues of records with a VARIANT column: <prefix>_FIELD_MISSING, _FIELD_TYPE, _FIELD_BLANK, _FIELD_UNKNOWN.

    A record that is no object gives <prefix>_ITEM_TYPE only.
    """
    top = F.col(record)
    base = records.withColumn("__k", _kind(top))
    objects = base.where("__k = 'OBJECT'")
    parts = [base.where("__k is null or __k != 'OBJECT'").select(*issue("high", f"{prefix}_ITEM_TYPE", path, "", F.lit("no mapping")))]
    rules = []
    for f in fields:
        value = F.try_variant_get(top, f"$.{f.name}", "variant")
        kind = _kind(value)
        present = F.array_contains(F.map_keys(F.try_variant_get(top, "$", "map<string,variant>")), f.name)
        wrong = present & ~F.coalesce(kind, F.lit("VOID")).isin(*KINDS[f.kind], *(["VOID"] if f.null_allowed else []))
        blank = F.trim(F.try_variant_get(top, f"$.{f.name}", "string")) == ""
        rules.append(F.when(F.lit(f.required) & ~present, F.struct(F.lit("MISSING").alias("what"), F.lit(f.name).alias("name"))))
        rules.append(F.when(wrong, F.struct(F.lit("TYPE").alias("what"), F.lit(f.name).alias("name"))))
        if f.kind == "text" and not f.blank_allowed:
            rules.append(F.when(F.coalesce(blank, F.lit(False)) & (kind == "STRING"), F.struct(F.lit("BLANK").alias("what"), F.lit(f.name).alias("name"))))
    found = F.array_compact(F.array(*rules))
    if closed:
        keys = F.map_keys(F.try_variant_get(top, "$", "map<string,variant>"))
        unknown = F.transform(F.array_except(keys, F.array(*[F.lit(f.name) for f in fields])), lambda k: F.struct(F.lit("UNKNOWN").alias("what"), k.alias("name")))
        found = F.concat(found, unknown)
    each = objects.select(F.col(path).alias("path"), F.explode(found).alias("r"))
    parts.append(
        each.select(
            F.lit("high").alias("severity"), F.concat(F.lit(f"{prefix}_FIELD_"), "r.what").alias("code"), "path",
            F.col("r.name").alias("field"), F.concat(F.lower("r.what"), F.lit(": "), "r.name").alias("message"),
        )
    )
    return reduce(DataFrame.unionByName, parts)


def list_issues(df: DataFrame, column: str, path: str, code: str) -> DataFrame:
    """Issues of array columns: blank elements, and repeated elements (<code>_BLANK, <code>_DUPLICATE)."""
    blank = F.exists(column, lambda x: x.isNull() | (F.trim(x) == ""))
    repeat = F.size(F.array_distinct(column)) < F.size(column)
    return df.where(blank).select(*issue("high", f"{code}_BLANK", path, column, F.lit("blank element"))).unionByName(
        df.where(repeat).select(*issue("medium", f"{code}_DUPLICATE", path, column, F.lit("repeated element")))
    )


def vocabulary_issues(df: DataFrame, columns: dict[str, str], path: str, vocab: DataFrame, code: str = "VOCAB_INVALID") -> DataFrame:
    """Values outside their vocabulary; ``columns``: column and vocabulary field.

    A vocabulary is a curated list; it is broadcast only while its estimate is small.
    """
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(f).alias("field"), F.col(c).cast("string").alias("value")) for c, f in columns.items()])
    values = df.select(F.col(path).alias("path"), F.explode(each).alias("e")).select("path", "e.*").where("trim(coalesce(value, '')) != ''")
    wrong = values.join(broadcast_if_small(vocab.select("field", "value").distinct()), ["field", "value"], "left_anti")
    return wrong.select(*issue("high", code, "path", "", F.col("value"))[:3], F.col("column").alias("field"), F.col("value").alias("message"))


def unique_issues(df: DataFrame, keys: list[str], path: str, code: str, severity: str = "critical") -> DataFrame:
    """One issue per row whose key several rows have; keys are counted first, so a hot key forms no group."""
    some = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    hit = lookup_join(df.where(some).select(path, *keys), duplicates(df.where(some), keys), keys, [path])
    return hit.select(*issue(severity, code, F.col(path).cast("string"), keys[0], F.concat(F.col("n_rows").cast("string"), F.lit(" rows"))))


def reference_issues(df: DataFrame, column: str, path: str, known: DataFrame, code: str, severity: str = "critical") -> DataFrame:
    """Non-blank references that no known id (column ``id``) equals."""
    refs = df.select(path, F.col(column).alias("value"), reference_key(column).alias("__key")).where("__key is not null and __key != ''")
    ids = known.select(reference_key("id").alias("__key")).where("__key is not null").distinct()
    lost = lookup_join(refs, ids, ["__key"], [path], "left_anti")
    return lost.select(*issue(severity, code, F.col(path).cast("string"), column, F.col("value")))


def page_link_issues(pages: DataFrame) -> DataFrame:
    """page, reference, code of links that lead nowhere: BROKEN_REFERENCE, BROKEN_FRAGMENT, REFERENCE_ESCAPE, ROOT_ABSOLUTE_REFERENCE.

    ``pages``: page (relative path), refs, ids (see ``markup.page_parts``).
    Links to other hosts and data, mail and telephone links are no concern;
    a folder means its index.html.
    """
    refs = pages.select("page", F.explode("refs").alias("reference")).where(
        ~F.col("reference").rlike(r"(?i)^(https?:|mailto:|tel:|data:|//)") & (F.col("reference") != "")
    )
    refs = refs.withColumn("path", F.url_decode(F.regexp_extract("reference", r"^([^#?]*)", 1))).withColumn(
        "fragment", F.url_decode(F.regexp_extract("reference", r"#(.*)$", 1))
    )
    folder = F.regexp_replace("page", r"[^/]*$", "")
    # Segments folded one by one: '.' stays, '..' drops the last, and a step above the root is kept as '..'.
    fold = F.aggregate(
        F.split(F.concat(folder, "path"), "/"),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s.isin("", "."), done)
        .when((s == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(s))),
    )
    joined = F.array_join(fold, "/")
    is_folder = F.col("path").rlike(r"(^|/)$|(^|/)\.{1,2}$")
    target = F.when(F.col("path") == "", F.col("page")).when(is_folder, F.ltrim(F.concat(joined, F.lit("/index.html")), F.lit("/"))).otherwise(joined)
    refs = refs.withColumn("target", target)
    known = pages.select(F.col("page").alias("target"), F.col("ids").alias("__ids"))
    found = lookup_join(refs, known, ["target"], ["page", "reference"], "left")
    code = (
        F.when(F.col("path").startswith("/"), "ROOT_ABSOLUTE_REFERENCE")
        .when(F.startswith(F.col("target"), F.lit("..")), "REFERENCE_ESCAPE")
        .when(F.col("__ids").isNull(), "BROKEN_REFERENCE")
        .when((F.col("fragment") != "") & ~F.array_contains("__ids", F.col("fragment")), "BROKEN_FRAGMENT")
    )
    return found.select("page", "reference", code.alias("code")).where("code is not null")


# Schemes of links that lead elsewhere, and what a path on a disk begins with.
EXTERNAL_SCHEMES = ("http", "https", "mailto", "tel", "data")
LOCAL_PATH = r"(?i)(?<![a-z0-9])(?:[a-z]:[\\/]|file://)"


def page_issues(pages: DataFrame, lang: str = "ko") -> DataFrame:
    """page, code, detail of what is wrong with a page by itself.

    ``pages``: page (relative path), html.  Local file paths and unrendered
    diagrams in the text, another language than ``lang``, repeated ids, images
    without alternative text, not exactly one top heading (but in a folder
    ``aliases``), links of unsupported schemes.  A null page counts as empty.
    """
    text = F.coalesce("html", F.lit(""))
    parsed = pages.select("page", text.alias("html"), page_parts("html").alias("p"))
    scheme = lambda r: F.lower(F.regexp_extract(r, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    strange = F.filter("p.refs", lambda r: (scheme(r) != "") & ~scheme(r).isin(*EXTERNAL_SCHEMES))
    one = lambda condition, code, detail: F.when(condition, F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail")))
    repeated = F.filter(F.array_distinct("p.ids"), lambda i: F.size(F.filter("p.ids", lambda j: j == i)) > 1)
    found = F.array_compact(F.array(
        one(F.col("html").rlike(LOCAL_PATH), "LOCAL_PATH_LEAK", F.lit("")),
        one(F.contains("html", F.lit("language-mermaid")), "UNRENDERED_MERMAID", F.lit("")),
        one(F.col("p.lang") != lang, "LANG_MISSING", F.col("p.lang")),
        one(F.size(repeated) > 0, "DUPLICATE_ID", F.array_join(F.array_sort(repeated), ",")),
        one(F.col("p.images_without_alt") > 0, "IMAGE_ALT", F.col("p.images_without_alt")),
        one(~F.col("page").rlike("(^|/)aliases/") & (F.col("p.h1_count") != 1), "H1_COUNT", F.col("p.h1_count")),
        one(F.size(strange) > 0, "REFERENCE_SCHEME", F.array_join(F.array_sort(strange), ",")),
    ))
    return parsed.select("page", F.inline(found))


# What a log entry may say was done.
LOG_ACTIONS = (
    "CREATE", "UPDATE", "LINK", "DEPRECATE", "CONFLICT_REGISTER", "CONFLICT_RESOLVE", "LINT_RUN", "VERIFY", "INGEST",
    "MIGRATE", "ROUTE_RAW", "DEDUPE_RAW",
)


def log_issues(items: DataFrame, paths: DataFrame, aliases: DataFrame, actions: tuple[str, ...] = LOG_ACTIONS) -> DataFrame:
    """Issues of log entries: unknown actions, and targets that are neither a present path nor an alias of one.

    ``items``: file, line_no, action, targets (see ``readers.log_items``).
    ``paths``: path.  ``aliases``: alias, target.  Only targets that name a
    page of the wiki are looked up.
    """
    line = F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "))
    wrong = items.where((F.col("action") != "") & ~F.col("action").isin(*actions)).select(
        *issue("high", "LOG_ACTION_INVALID", "file", "Action", F.concat(line, "action"))
    )
    named = items.select("file", "line_no", F.explode("targets").alias("target"))
    named = named.where(F.lower("target").startswith("wiki/") & F.contains(F.lower("target"), F.lit(".md"))).withColumn("__key", normalized_ref("target"))
    present = paths.select(normalized_ref("path").alias("__key")).distinct()
    through = aliases.select(normalized_ref("alias").alias("__alias"), normalized_ref("target").alias("__key"))
    moved = lookup_join(through, present, ["__key"], ["__alias"], "left_semi").select(F.col("__alias").alias("__key"))
    lost = lookup_join(named, present.union(moved).distinct(), ["__key"], ["file", "line_no"], "left_anti")
    return wrong.unionByName(lost.select(*issue("low", "LOG_TARGET_UNRESOLVED", "file", "Target", F.concat(line, "target"))))
