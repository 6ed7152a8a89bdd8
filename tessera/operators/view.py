"""Normalising projections: nested and flat records in one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.norm import OPEN_END, ordered_distinct, scalar_text

#: Flat column and where it comes from in the nested record.
FLAT = {
    "status": "workflow.editorial_status",
    "ingestion_status": "workflow.ingestion_status",
    "last_updated": "workflow.updated_on",
    "review_cycle": "workflow.review.cycle",
    "last_checked": "workflow.review.checked_on",
    "legal_status": "legal.status",
    "as_of_date": "legal.as_of",
    "effective_from": "legal.validity.valid_from",
    "superseded_by": "legal.superseded_by",
    "superseded_date": "legal.superseded_on",
    "last_verified": "verification.verified_on",
    "enforcement_weight": "authority_profile.enforcement_weight",
}


def flat_records(entities: DataFrame) -> DataFrame:
    """One flat row per record; nested text is trimmed, null gives ''.

    An open end becomes the sentinel date; verifiers are the distinct
    non-blank ids of the verification, or of the flat list if it has none.
    """
    ids = ordered_distinct("verification.verifier_ids")
    return entities.select(
        "entity_row",
        "id",
        "entity_type",
        scalar_text("title").alias("title"),
        *[scalar_text(path).alias(name) for name, path in FLAT.items()],
        F.coalesce(F.nullif(scalar_text("legal.validity.valid_until"), F.lit("")), F.lit(OPEN_END)).alias("effective_to"),
        F.col("authority_profile.level").alias("authority_level"),
        F.when(F.size(ids) > 0, ids).otherwise(ordered_distinct("verified_by")).alias("verifiers"),
        ordered_distinct("aliases").alias("aliases"),
        ordered_distinct("id_aliases").alias("id_aliases"),
        "registered_at",
        "deleted_at",
        "exported_at",
    )


def latest_records(df: DataFrame, key: str = "id", order: tuple[str, ...] = ("exported_at", "entity_row")) -> DataFrame:
    """The last exported row of each key, by a partial aggregate; rows with a null key are left out."""
    rest = [c for c in df.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(newest.alias("__v")).select(key, "__v.*")


def source_location(location: str = "location") -> list[Column]:
    """location_kind and location_value: the path or the URL of a source, by what it has."""
    path, url = scalar_text(f"{location}.path"), scalar_text(f"{location}.url")
    return [
        F.when(path != "", "path").when(url != "", "url").otherwise("").alias("location_kind"),
        F.when(path != "", path).otherwise(url).alias("location_value"),
    ]


def search_text(parts: list[Column]) -> Column:
    """Distinct non-blank parts in their order, joined by blanks."""
    cleaned = F.filter(F.array(*[F.trim(F.coalesce(p, F.lit(""))) for p in parts]), lambda p: p != "")
    return F.array_join(F.array_distinct(cleaned), " ")


def authority_records(records: str, primary: str, supporting: str) -> Column:
    """Array of (target_id, role): the record's own array if it has one, else the primary and the other supporting ids."""
    first = scalar_text(primary)
    ids = F.concat(
        F.when(first != "", F.array(F.struct(first.alias("target_id"), F.lit("primary").alias("role")))).otherwise(F.array().cast("array<struct<target_id:string,role:string>>")),
        F.transform(F.array_except(ordered_distinct(supporting), F.array(first)), lambda x: F.struct(x.alias("target_id"), F.lit("supporting").alias("role"))),
    )
    own = F.transform(F.col(records), lambda r: F.struct(F.trim(r["target_id"]).alias("target_id"), r["role"].alias("role")))
    return F.when(F.col(records).isNotNull(), own).otherwise(ids)


def authority_target_ids(records: Column) -> Column:
    """Distinct non-blank targets of authority records, in order."""
    return ordered_distinct(F.transform(records, lambda r: r["target_id"]))


def conflict_records(records: str, kind: str, status: str, note: str) -> Column:
    """Array of (conflict_id, type, status, note); a flat conflict without an array is one record of its own."""
    one = F.struct(F.lit("legacy-conflict").alias("conflict_id"), scalar_text(kind).alias("type"), scalar_text(status).alias("status"), scalar_text(note).alias("note"))
    none = F.array().cast("array<struct<conflict_id:string,type:string,status:string,note:string>>")
    flat = F.when(scalar_text(kind) != "", F.array(one)).otherwise(none)
    return F.when(F.col(records).isNotNull(), F.filter(records, lambda r: r.isNotNull())).otherwise(flat)


#: Availability of the flat form and of the nested form.
AVAILABILITY = {"available": "complete", "partial": "partial", "unavailable_official": "official_unavailable"}


def availability(x: str) -> Column:
    """Availability in the nested form; other values mean not_applicable."""
    table = F.create_map(*[F.lit(v) for kv in AVAILABILITY.items() for v in kv])
    return F.coalesce(F.try_element_at(table, scalar_text(x)), F.lit("not_applicable"))


def source_ids(own: str, evidence: Column) -> Column:
    """The record's own source ids, or those of its evidence if it has none; distinct, in order."""
    mine = ordered_distinct(own)
    return F.when(F.size(mine) > 0, mine).otherwise(ordered_distinct(F.transform(evidence, lambda e: e["source_id"])))


def shadowed(df: DataFrame, attributes: str, columns: list[str]) -> DataFrame:
    """Flat columns overlaid by the attributes (a map) of the same name; only the named columns may be.

    Name resolution must read the columns before this, so that attributes
    cannot change what a reference means.
    """
    over = {c: F.coalesce(F.try_element_at(F.col(attributes), F.lit(c)), F.col(c)) for c in columns}
    return df.withColumns(over)


def archive_order(date: str = "sort_date", title: str = "title") -> list[Column]:
    """Order of archives: the latest first, then by title."""
    return [F.desc(date), F.asc(title)]


def type_rank(entity_type: str, order: list[str]) -> Column:
    """Place of a type in a fixed order; unknown types come last."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(entity_type))
    return F.when(at == 0, len(order) + 1).otherwise(F.coalesce(at, F.lit(len(order) + 1))).cast("int")


#: Ways to sort a list of records; the first is meant where none is named.
SORT_MODES = ("newest", "oldest", "title", "type")


def record_order(mode: str, types: list[str], collation: str = "ko", date: str = "sort_date", title: str = "title") -> list[Column]:
    """Order of a record list: by date, title or type, equal ones by title; titles in the order of a language."""
    by_title = F.collate(F.col(title), collation).asc()
    first = {"newest": [F.desc(date)], "oldest": [F.asc(date)], "title": [], "type": [type_rank("entity_type", types).asc()]}
    if mode not in first:
        raise ValueError(f"unknown sort mode {mode}")
    return [*first[mode], by_title]
