"""Rule families over the record tables; every rule gives rows of (severity, code, path, field, message).

A row predicate is one entry of an array that is exploded, so that a table is
scanned once per family however many rules it has.  Uniqueness and references
use counted keys and joins with hot keys split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.norm import reference_key, scalar_text, strict_date
from ..session import broadcast_if_small, lookup_join
from .graph import issue
from .resolve import duplicates, later_duplicates

Rule = tuple[str, str, str, Column, Column]  # severity, code, field, condition, message


def row_rules(df: DataFrame, name: str, row: str, rules: list[Rule]) -> DataFrame:
    """Issues of row predicates in one scan; a null condition is no issue, a null message ''."""
    each = F.array_compact(
        F.array(
            *[
                F.when(condition, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), F.lit(f).alias("field"), F.coalesce(m.cast("string"), F.lit("")).alias("message")))
                for s, c, f, condition, m in rules
            ]
        )
    )
    path = F.concat(F.lit(name + "/"), F.col(row).cast("string"))
    return df.select(path.alias("path"), F.explode(each).alias("i")).select("i.severity", "i.code", "path", "i.field", "i.message")


def _empty(c: str) -> Column:
    return scalar_text(c) == ""


def _bad_date(c: str) -> Column:
    return (scalar_text(c) != "") & strict_date(c).isNull()


def _blank_in(c: str) -> Column:
    return F.exists(c, lambda x: x.isNull() | (F.trim(x) == ""))


def _repeats_in(c: str) -> Column:
    return F.size(F.array_distinct(c)) < F.size(c)


def _none_in(c: str) -> Column:
    return F.coalesce(F.size(c) <= 0, F.lit(True))


def _unknown(refs: DataFrame, known: DataFrame, name: str, row: str, column: str, severity: str, code: str) -> DataFrame:
    """Issues of non-blank references (row, column) whose key is not in ``known`` (key)."""
    keyed = refs.select(row, column, reference_key(column).alias("key")).where("key is not null and key != ''")
    lost = lookup_join(keyed, known.select("key").distinct(), ["key"], [row], "left_anti")
    return lost.select(*issue(severity, code, F.concat(F.lit(name + "/"), F.col(row).cast("string")), column, F.col(column)))


def _outside(df: DataFrame, name: str, row: str, column: str, field: str, vocab: DataFrame, severity: str, code: str) -> DataFrame:
    """Issues of non-blank values outside a vocabulary (field, code)."""
    allowed = broadcast_if_small(vocab.where(F.col("field") == field).select(F.col("code").alias("value")).distinct())
    values = df.select(row, F.col(column).alias("value")).where("trim(coalesce(value, '')) != ''")
    lost = values.join(allowed, "value", "left_anti")
    return lost.select(*issue(severity, code, F.concat(F.lit(name + "/"), F.col(row).cast("string")), column.split(".")[-1], F.col("value")))


def _later(df: DataFrame, name: str, row: str, keys: list[str], field: str, severity: str, code: str) -> DataFrame:
    again = later_duplicates(df, keys, row)
    return again.select(*issue(severity, code, F.concat(F.lit(name + "/"), F.col(row).cast("string")), field, F.coalesce(F.col(field).cast("string"), F.lit(""))))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def evidence_rules(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Ids, sources, locators, supports and dates of evidence rows; sources are checked only if some are registered."""
    rows = row_rules(evidence, "evidence", "evidence_row", [
        ("high", "EVIDENCE_ID", "evidence_id", _empty("evidence_id"), F.lit("no id")),
        ("high", "EVIDENCE_SOURCE", "source_id", _empty("source_id"), F.lit("no source")),
        ("high", "EVIDENCE_LOCATOR", "locator", _empty("locator"), F.lit("no locator")),
        ("high", "EVIDENCE_SUPPORTS", "supports", _none_in("supports") | _blank_in("supports"), F.lit("no claim")),
        ("high", "EVIDENCE_SUPPORTS_DUPLICATE", "supports", _repeats_in("supports"), F.lit("repeated claim")),
        ("high", "DATE_INVALID", "verified_on", _bad_date("verified_on"), F.col("verified_on")),
    ])
    known = sources.select(reference_key("source_id").alias("key"))
    again = _later(evidence.where("trim(coalesce(evidence_id, '')) != ''"), "evidence", "evidence_row", ["entity_id", "evidence_id"], "evidence_id", "high", "EVIDENCE_ID_DUPLICATE")
    parts = [rows, again]
    if not known.where("key != ''").isEmpty():  # without any registered source there is nothing to check against
        parts.append(_unknown(evidence, known, "evidence", "evidence_row", "source_id", "high", "EVIDENCE_SOURCE_UNKNOWN"))
    return _all(parts)


def relation_rules(relations: DataFrame, targets: DataFrame, vocab: DataFrame) -> DataFrame:
    """Types, targets, repeats and dates of relation rows; ``targets``: key of every known name."""
    rows = row_rules(relations, "relations", "relation_row", [
        ("high", "RELATION_TARGET", "target_id", _empty("target_id"), F.lit("no target")),
        ("high", "DATE_INVALID", "effective_on", _bad_date("effective_on"), F.col("effective_on")),
    ])
    keyed = relations.withColumn("key", reference_key("target_id"))
    again = _later(keyed.where("key != ''"), "relations", "relation_row", ["entity_id", "relation_type", "key"], "target_id", "medium", "RELATION_DUPLICATE")
    return _all([
        rows, again, _unknown(relations, targets, "relations", "relation_row", "target_id", "critical", "RELATION_TARGET_BROKEN"),
        _outside(relations, "relations", "relation_row", "relation_type", "relation_type", vocab, "high", "VOCAB_RELATION"),
    ])


def source_rules(sources: DataFrame, vocab: DataFrame) -> DataFrame:
    """Ids, fields, levels and locations of registered sources."""
    path, url = scalar_text("location.path"), scalar_text("location.url")
    rows = row_rules(sources, "sources", "source_row", [
        ("high", "SOURCE_ID_FORMAT", "source_id", ~F.coalesce(F.col("source_id").rlike(r"^[a-z0-9][a-z0-9-]*\z"), F.lit(False)), F.col("source_id")),
        *[("high", "SOURCE_FIELD", f, _empty(f), F.lit("no value")) for f in ("title", "publisher", "source_type", "jurisdiction")],
        ("high", "SOURCE_AUTHORITY_LEVEL", "authority_level", F.coalesce(~F.col("authority_level").between(1, 7), F.lit(True)), F.col("authority_level")),
        ("high", "SOURCE_LOCATION", "location", ((path != "") == (url != "")), F.lit("exactly one of path and url")),
        ("critical", "SOURCE_PATH_ESCAPE", "location", path.rlike(r"(^|/)\.\.(/|\z)") | path.startswith("/"), path),
        ("high", "SOURCE_URL_INVALID", "location", (url != "") & ~url.rlike(r"^https?://[^/\s]+"), url),
    ])
    placed = sources.select("source_row", "source_id", path.alias("place")).where("place != ''")
    first = placed.groupBy("place").agg(F.count_distinct("source_id").alias("n")).where("n > 1")
    shared = lookup_join(placed, first, ["place"], ["source_row"])
    return _all([
        rows, _outside(sources, "sources", "source_row", "source_type", "source_type", vocab, "high", "SOURCE_TYPE"),
        _later(sources, "sources", "source_row", ["source_id"], "source_id", "critical", "SOURCE_ID_DUPLICATE"),
        shared.select(*issue("critical", "SOURCE_PATH_DUPLICATE", F.concat(F.lit("sources/"), F.col("source_row").cast("string")), "location", F.col("place"))),
    ])


def qa_rules(qa: DataFrame, targets: DataFrame) -> DataFrame:
    """Ids, dates, texts and required references of QA cases; ``targets``: key, entity_id, entity_type."""
    ids = ("required_authority_ids", "required_rule_ids")
    rows = row_rules(qa, "qa", "qa_row", [
        ("high", "QA_ID", "id", _empty("id"), F.lit("no id")),
        ("high", "QA_AS_OF", "as_of", strict_date("as_of").isNull(), F.col("as_of")),
        *[("high", "QA_TEXT", f, _empty(f), F.lit("no text")) for f in ("question", "expected")],
        *[("high", "QA_ID_LIST", f, F.col(f).isNull() | _blank_in(f), F.lit("no list of ids")) for f in ids],
        ("high", "QA_FORBIDDEN_CLAIMS", "forbidden_claims", F.col("forbidden_claims").isNull() | _blank_in("forbidden_claims"), F.lit("no list of texts")),
    ])
    each = _all([qa.select("qa_row", F.lit(f).alias("field"), F.explode(f).alias("ref")) for f in ids])
    each = each.withColumn("key", reference_key("ref")).where("key is not null and key != ''")
    found = lookup_join(each, targets.select("key", "entity_type"), ["key"], ["qa_row", "field", "ref"], "left")
    path = F.concat(F.lit("qa/"), F.col("qa_row").cast("string"))
    code = (
        F.when(F.col("entity_type").isNull() & (F.col("field") == ids[0]), "QA_UNKNOWN_AUTHORITY_ID")
        .when(F.col("entity_type").isNull(), "QA_UNKNOWN_RULE_ID")
        .when((F.col("field") == ids[1]) & (F.col("entity_type") != "rule"), "QA_REQUIRED_ID_NOT_RULE")
    )
    severity = F.when(code.startswith("QA_UNKNOWN"), "critical").otherwise("high")
    wrong = found.select(severity.alias("severity"), code.alias("code"), path.alias("path"), "field", F.col("ref").alias("message")).where("code is not null")
    again = _later(qa.where("trim(coalesce(id, '')) != ''"), "qa", "qa_row", ["id"], "id", "high", "QA_ID_DUPLICATE")
    return _all([rows, wrong, again])


def identity_rules(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Ids, titles and aliases of records, and the alias table beside them.

    Re-exports of one record (same id) count once; an alias collides if it is
    another record's id or if several records or entries claim it.
    """
    rows = row_rules(entities, "entities", "entity_row", [
        ("critical", "ID_MISSING", "id", _empty("id"), F.lit("no id")),
        ("critical", "ID_INVALID", "id", F.col("id").rlike(r"\s|^(claim|evidence|source|conflict):"), F.col("id")),
        ("high", "TITLE_MISSING", "title", _empty("title"), F.lit("no title")),
        ("medium", "DUPLICATE_LIST_VALUE", "aliases", _repeats_in("aliases"), F.lit("repeated alias")),
        ("high", "FIELD_TYPE", "aliases", _blank_in("aliases"), F.lit("blank alias")),
    ])
    ids = entities.select("id").where("trim(coalesce(id, '')) != ''").distinct()
    own = entities.select(F.explode("id_aliases").alias("alias"), F.col("id").alias("owner"))
    listed = aliases.select(F.col("alias_id").alias("alias"), F.col("canonical_id").alias("owner"))
    claims = own.unionByName(listed).where("trim(coalesce(alias, '')) != '' and owner is not null").distinct()
    shared = duplicates(claims, ["alias"]).select(*issue("critical", "ID_ALIAS_COLLISION", "alias", "id_aliases", F.concat(F.col("n_rows").cast("string"), F.lit(" records"))))
    taken = claims.join(ids, claims["alias"] == ids["id"]).where("alias != owner").select(*issue("critical", "ID_ALIAS_IS_ID", "alias", "id_aliases", F.col("owner")))
    broken = listed.where("trim(coalesce(alias, '')) != ''").distinct().join(ids, F.col("owner") == ids["id"], "left_anti").select(
        *issue("critical", "ID_ALIAS_CANONICAL_BROKEN", "alias", "canonical_id", F.coalesce("owner", F.lit("")))
    )
    drift = own.distinct().where("trim(coalesce(alias, '')) != ''").join(listed.distinct(), ["alias", "owner"], "left_anti").select(
        *issue("high", "ID_ALIAS_MAP_DRIFT", "alias", "id_aliases", F.coalesce("owner", F.lit("")))
    )
    again = duplicates(entities.where("trim(coalesce(id, '')) != ''"), ["id"]).select(*issue("critical", "DUPLICATE_ID", "id", "id", F.concat(F.col("n_rows").cast("string"), F.lit(" rows"))))
    return _all([rows, again, shared, taken, broken, drift])


def temporal_rules(chunks: DataFrame, rules: DataFrame) -> DataFrame:
    """Dates and their order in section versions and rule periods; an open end is no date."""
    start, end = strict_date("valid_from"), strict_date("valid_until")
    sections = row_rules(chunks, "chunks", "chunk_row", [
        ("high", "DATE_REQUIRED", "valid_from", _empty("valid_from"), F.lit("no start")),
        ("high", "DATE_INVALID", "valid_from", _bad_date("valid_from"), F.col("valid_from")),
        ("high", "DATE_INVALID", "valid_until", _bad_date("valid_until"), F.col("valid_until")),
        ("high", "TEMPORAL_ORDER", "valid_until", start > end, F.concat("valid_from", F.lit(" > "), "valid_until")),
    ])
    a, b = strict_date("applicable_from"), strict_date("applicable_to")
    periods = row_rules(rules, "temporal", "temporal_row", [
        ("high", "RULE_TEMPORAL_DATE", "applicable_from", a.isNull(), F.col("applicable_from")),
        ("high", "RULE_TEMPORAL_DATE", "applicable_to", _bad_date("applicable_to"), F.col("applicable_to")),
        ("high", "RULE_TEMPORAL_ORDER", "applicable_to", a > b, F.concat("applicable_from", F.lit(" > "), "applicable_to")),
        ("high", "RULE_TEMPORAL_VERSION", "rule_version", ~F.coalesce(F.col("rule_version").rlike(r"^\d+(\.\d+)*\z"), F.lit(False)), F.col("rule_version")),
    ])
    return _all([sections, periods])


def verification_rules(entities: DataFrame, verifiers: DataFrame, vocab: DataFrame) -> DataFrame:
    """Verifier ids, methods, note and dates of the verification of records.

    A date, a method or a note wants a verifier, a date or a verifier wants a
    method, and a cross check wants a note.  A verification without a field
    ``note`` has no note.
    """
    ids, methods = "verification.verifier_ids", "verification.methods"
    dated = scalar_text("verification.verified_on") != ""
    some_in = lambda c: F.coalesce(F.exists(c, lambda x: F.trim(x) != ""), F.lit(False))
    with_note = "note" in entities.schema["verification"].dataType.names
    noted = scalar_text("verification.note") != "" if with_note else F.lit(False)
    crossed = F.coalesce(F.array_contains(methods, "source_cross_check"), F.lit(False))
    odd = F.filter(ids, lambda v: (F.trim(v) != "") & ~v.rlike(r"^[a-z][a-z0-9-]{0,63}\z"))
    rows = row_rules(entities, "entities", "entity_row", [
        ("medium", "VERIFIER_ID_DUPLICATE", "verifier_ids", _repeats_in(ids), F.lit("repeated verifier")),
        ("medium", "VERIFICATION_METHOD_DUPLICATE", "methods", _repeats_in(methods), F.lit("repeated method")),
        ("high", "VERIFIER_IDS_TYPE", "verifier_ids", _blank_in(ids), F.lit("blank verifier")),
        ("high", "VERIFICATION_METHODS_TYPE", "methods", _blank_in(methods), F.lit("blank method")),
        ("high", "VERIFICATION_DATE_INVALID", "verified_on", _bad_date("verification.verified_on"), F.col("verification.verified_on")),
        ("high", "VERIFIER_ID_INVALID", "verifier_ids", F.size(odd) > 0, F.array_join(odd, ", ")),
        ("high", "VERIFICATION_VERIFIER_MISSING", "verifier_ids", (dated & _none_in(ids)) | ((some_in(methods) | noted) & ~some_in(ids)), F.lit("no verifier")),
        ("high", "VERIFICATION_METHOD_MISSING", "methods", (dated & _none_in(methods)) | (some_in(ids) & ~some_in(methods)), F.lit("no method")),
        ("high", "VERIFICATION_NOTE_MISSING", "note", crossed & ~noted, F.lit("a cross check without a note")),
    ])
    path = F.concat(F.lit("entities/"), F.col("entity_row").cast("string"))

    def unknown(column: str, known: DataFrame, code: str) -> DataFrame:
        each = entities.select("entity_row", F.explode(column).alias("value")).where("trim(coalesce(value, '')) != ''")
        lost = lookup_join(each, known, ["value"], ["entity_row"], "left_anti")
        return lost.select(*issue("high", code, path, column.split(".")[1], F.col("value")))

    people = verifiers.select(F.col("verifier_id").alias("value")).distinct()
    allowed = vocab.where("field = 'verification_method'").select(F.col("code").alias("value")).distinct()
    return _all([rows, unknown(ids, people, "VERIFIER_UNKNOWN"), unknown(methods, allowed, "VERIFICATION_METHOD_INVALID")])
