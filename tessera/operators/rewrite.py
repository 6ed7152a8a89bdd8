"""Rewrites of records between the flat and the nested form, and reports of what they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.norm import OPEN_END, UNKNOWN_START, ordered_distinct, scalar_text, strict_date
from ..session import cut_lineage, lookup_join
from .resolve import numbered, resolve


def date_or_null(x: str) -> Column:
    """A date text without the sentinels and blanks that stand for none."""
    c = scalar_text(x)
    return F.when(~c.isin("", OPEN_END, UNKNOWN_START), c)


def nested_records(flat: DataFrame) -> DataFrame:
    """Flat records (see ``view.flat_records``) in the nested form: workflow, legal, verification, lists distinct.

    Blank texts and sentinel dates become null.
    """
    text = lambda c: F.nullif(scalar_text(c), F.lit(""))
    return flat.select(
        F.lit("1.4").alias("schema_version"), "id", "entity_type", text("title").alias("title"),
        ordered_distinct("id_aliases").alias("id_aliases"), ordered_distinct("aliases").alias("aliases"),
        F.struct(
            text("status").alias("editorial_status"), text("ingestion_status").alias("ingestion_status"),
            date_or_null("last_updated").alias("updated_on"),
            F.struct(text("review_cycle").alias("cycle"), date_or_null("last_checked").alias("checked_on")).alias("review"),
        ).alias("workflow"),
        F.struct(
            text("legal_status").alias("status"), date_or_null("as_of_date").alias("as_of"),
            F.struct(date_or_null("effective_from").alias("valid_from"), date_or_null("effective_to").alias("valid_until")).alias("validity"),
            text("superseded_by").alias("superseded_by"), date_or_null("superseded_date").alias("superseded_on"),
        ).alias("legal"),
        F.struct(date_or_null("last_verified").alias("verified_on"), F.col("verifiers").alias("verifier_ids")).alias("verification"),
    )


def located_sources(sources: DataFrame, strict: bool = True) -> DataFrame:
    """Sources whose location has one form: kind path or url and its value.

    Strict rewriting raises for a source without a location; otherwise its
    kind and value are null.
    """
    path, url = scalar_text("location.path"), scalar_text("location.url")
    missing = F.raise_error(F.concat(F.lit("no location: "), F.coalesce("source_id", F.lit("")))) if strict else F.lit(None)
    kind = F.when(path != "", "path").when(url != "", "url").otherwise(missing.cast("string"))
    return sources.withColumn("location", F.struct(kind.alias("kind"), F.when(path != "", path).when(url != "", url).alias("value")))


def mapped_verification(records: DataFrame, names: dict[str, str], column: str = "verified_by") -> DataFrame:
    """``records`` with mapped_ids (ids of the names known exactly) and unmapped (the rest, in order).

    The map is a fixed table of a few names; an id maps to itself.
    """
    table = F.create_map(*[F.lit(x) for kv in {**{v: v for v in names.values()}, **names}.items() for x in kv])
    own = ordered_distinct(column)
    hit = F.transform(own, lambda v: F.try_element_at(table, v))
    return records.withColumn("mapped_ids", F.array_distinct(F.array_compact(hit))).withColumn(
        "unmapped", F.filter(own, lambda v: F.try_element_at(table, v).isNull())
    )


def change_report(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, changed: the columns in which a record would change, as their JSON texts differ; unchanged records are left out."""
    a = before.select(key, *[F.to_json(F.struct(c), {"ignoreNullFields": "false"}).alias(f"__a_{c}") for c in columns])
    b = after.select(key, *[F.to_json(F.struct(c), {"ignoreNullFields": "false"}).alias(f"__b_{c}") for c in columns])
    changed = F.array_compact(F.array(*[F.when(~F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}")), F.lit(c)) for c in columns]))
    return a.join(b, key).select(key, changed.alias("changed")).where("size(changed) > 0")


#: What a link between two types of records means; any other link cites.
LINK_MEANS = {
    ("case", "rule"): "supports", ("law", "rule"): "establishes", ("interpretation", "rule"): "interprets",
    ("fact_pattern", "rule"): "applies", ("rule", "fact_pattern"): "illustrated_by",
}


def link_relation(source_type: str, target_type: str) -> Column:
    """Relation that an untyped link from one type of record to another stands for."""
    pair = F.concat_ws(">", source_type, target_type)
    table = F.create_map(*[F.lit(x) for (a, b), r in LINK_MEANS.items() for x in (f"{a}>{b}", r)])
    return F.coalesce(F.try_element_at(table, pair), F.lit("cites"))


def typed_links(links: DataFrame, names: DataFrame, types: DataFrame, row: str = "row") -> tuple[DataFrame, DataFrame]:
    """Relations that untyped links become, and links that name no single record.

    ``links``: ``row``, entity_id, target.  ``names``: key, entity_id (see
    ``resolve.name_table``).  ``types``: id, entity_type.  Relations: row,
    entity_id, relation_type, target_id, one per entity, type and target, the
    first row's.  Null and blank targets are in neither.
    """
    given = links.where("trim(coalesce(target, '')) != '' and entity_id is not null")
    found = cut_lineage(resolve(given, names, "target", [row]))
    kinds = types.select(F.col("id").alias("entity_id"), F.col("entity_type").alias("__from"))
    ends = types.select(F.col("id").alias("resolved_id"), F.col("entity_type").alias("__to"))
    known = lookup_join(lookup_join(found.where("resolved_id is not null"), ends, ["resolved_id"], [row]), kinds, ["entity_id"], [row], "left")
    typed = known.select("entity_id", link_relation("__from", "__to").alias("relation_type"), F.col("resolved_id").alias("target_id"), row)
    first = typed.groupBy("entity_id", "relation_type", "target_id").agg(F.min(row).alias(row))
    return first.select(row, "entity_id", "relation_type", "target_id"), found.where("resolved_id is null").select(row, "entity_id", "target")


def normalised_relations(relations: DataFrame, names: DataFrame, known: tuple[str, ...], row: str = "relation_row", renamed: dict[str, str] | None = None) -> DataFrame:
    """Relations of records in the nested form: ``row``, entity_id, relation_type, target_id, note, effective_on, resolved.

    Types outside ``known`` (after ``renamed``) become related_to; a target
    becomes the one record it names, else it stays as written; sentinel dates
    become null.  Relations that state a conflict are left out (see
    :func:`stated_conflicts`), as are those without a target; equal ones of a
    record come out once, in the first row's place.
    """
    given = relations.where("trim(coalesce(target_id, '')) != '' and coalesce(relation_type, '') != 'conflicts_with'")
    found = resolve(given, names, "target_id", [row])
    kind = scalar_text("relation_type")
    if renamed:
        table = F.create_map(*[F.lit(x) for kv in renamed.items() for x in kv])
        kind = F.coalesce(F.try_element_at(table, kind), kind)
    made = found.select(
        row, "entity_id", F.when(kind.isin(*known), kind).otherwise("related_to").alias("relation_type"),
        F.coalesce("resolved_id", F.trim("target_id")).alias("target_id"), scalar_text("note").alias("note"),
        date_or_null("effective_on").alias("effective_on"), F.col("resolved_id").isNotNull().alias("resolved"),
    )
    keys = ["entity_id", "relation_type", "target_id", "note", "effective_on"]
    return made.groupBy(*keys).agg(F.min(row).alias(row), F.max("resolved").alias("resolved")).select(row, *keys, "resolved")


def record_slug(x: Column, prefix: str) -> Column:
    """An id made from a text: prefix, and at most 80 small letters, digits and dashes, 'item' if none is left."""
    c = F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9-]+", "-"), F.lit("-"))
    return F.concat(F.lit(prefix), F.substring(F.when(c == "", "item").otherwise(c), 1, 80))


def stated_conflicts(relations: DataFrame, names: DataFrame, row: str = "relation_row", relation: str = "conflicts_with") -> DataFrame:
    """Conflict records that relations state: ``row``, entity_id, conflict_id, status, target_id, note.

    One per record and target, of the first row; without a resolution a conflict is pending.
    """
    given = relations.where((F.col("relation_type") == relation) & (scalar_text("target_id") != ""))
    found = resolve(given, names, "target_id", [row]).withColumn("target", F.coalesce("resolved_id", F.trim("target_id")))
    first = found.groupBy("entity_id", "target").agg(F.min_by(F.struct(row, scalar_text("note").alias("note")), row).alias("f"))
    name = record_slug(F.concat("entity_id", F.lit("-"), "target"), "conflict:")
    return first.select(F.col(f"f.{row}").alias(row), "entity_id", name.alias("conflict_id"), F.lit("pending").alias("status"), F.col("target").alias("target_id"), "f.note")


def unique_evidence(evidence: DataFrame, row: str = "evidence_row") -> DataFrame:
    """``evidence`` with unique_id: evidence ids made unique within a record; running it again changes nothing.

    The first row of an id keeps it; a later one gets a digest of record,
    place, source and locator behind its first 78 letters, a blank one an id
    from the record and its place.  Places count from 0 in the order of rows.
    """
    place = numbered(evidence.where("entity_id is not null"), "entity_id", [row], "__n")
    keyed = place.withColumn("__id", scalar_text("evidence_id"))
    first = keyed.where("__id != ''").groupBy("entity_id", "__id").agg(F.min(row).alias("__first"))
    both = lookup_join(keyed, first, ["entity_id", "__id"], [row], "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    index = (F.col("__n") - 1).cast("string")
    digest = F.substring(F.sha2(F.concat_ws("\0", "entity_id", index, text("source_id"), text("locator")), 256), 1, 10)
    later = F.concat(F.rtrim(F.substring("__id", 1, 78), F.lit("-")), F.lit("-"), digest)
    own = record_slug(F.concat("entity_id", F.lit("-"), index), "evidence:")
    unique = F.when(F.col("__id") == "", own).when(F.col(row) == F.col("__first"), F.col("__id")).otherwise(later)
    return both.select(*evidence.columns, unique.alias("unique_id"))


#: Types of records that need evidence to be verified, and ways of verifying that count.
AUTHORITY_TYPES = ("case", "law", "interpretation")


def verified_states(records: DataFrame, evidence: DataFrame, verifiers: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """id, editorial_status, ingestion_status, downgraded: verified only what has all that makes it so.

    ``records``: id, entity_type, status, ingestion_status, last_verified,
    verifier_ids, methods.  A verified record without a real date, a known
    verifier or a known method, and one of the authority types without
    evidence, goes back to review and linked; unknown states become these too.
    """
    asked = records.select("id", F.explode("verifier_ids").alias("verifier_id"))
    known = lookup_join(asked, verifiers.select("verifier_id").distinct(), ["verifier_id"], ["id"], "left_semi").select("id").distinct()
    some = evidence.select(F.col("entity_id").alias("id")).where("id is not null").distinct()
    joined = lookup_join(records, known.withColumn("__who", F.lit(True)), ["id"], ["id"], "left")
    joined = lookup_join(joined, some.withColumn("__what", F.lit(True)), ["id"], ["id"], "left")
    way = F.coalesce(F.exists("methods", lambda m: F.trim(m).isin(*methods)), F.lit(False))
    complete = strict_date("last_verified").isNotNull() & F.coalesce("__who", F.lit(False)) & way
    whole = complete & (~F.col("entity_type").isin(*AUTHORITY_TYPES) | F.coalesce("__what", F.lit(False)))
    claims = (F.col("status") == "verified") | (F.col("ingestion_status") == "verified")
    down = claims & ~F.coalesce(whole, F.lit(False))
    editorial = F.when(down | ~F.col("status").isin("draft", "review", "verified"), "review").otherwise(F.col("status"))
    ingestion = F.when(down | ~F.col("ingestion_status").isin("imported", "extracted", "linked", "verified"), "linked").otherwise(F.col("ingestion_status"))
    return joined.select("id", editorial.alias("editorial_status"), ingestion.alias("ingestion_status"), down.alias("downgraded"))


def verification_plan(records: DataFrame, names: dict[str, str], known_ids: tuple[str, ...], existing: str = "verification") -> DataFrame:
    """``records`` with what adding structured verification would do: mapped_ids, unknown, changed, conflict.

    Values known exactly are mapped (see :func:`mapped_verification`).  If all
    are known and the record has no structured ids yet, they are added
    (changed); if it has others, that is a conflict and nothing is rewritten.
    A value that is an id itself says nothing of how it was verified: without
    structured ids it counts as unknown.  A second run changes nothing.
    """
    mapped = mapped_verification(records, names).withColumn("__direct", F.filter("unmapped", lambda v: v.isin(*known_ids) if known_ids else F.lit(False)))
    have = ordered_distinct(f"{existing}.verifier_ids")
    empty = F.size(have) == 0
    unknown = F.when(empty, F.col("unmapped")).otherwise(F.array_except("unmapped", "__direct"))
    told = F.array_distinct(F.concat("mapped_ids", "__direct"))
    usable = (F.size(told) > 0) & (F.size(unknown) == 0)
    same = F.array_sort(told) == F.array_sort(have)
    return mapped.withColumns({"unknown": unknown, "changed": usable & empty, "conflict": usable & ~empty & ~same}).drop("unmapped", "__direct")
