"""Queries of the general data problems (p1, p2, p6) with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, hanging, intervals
from ..session import table

REF_COLUMNS = ("table_name", "field", "row_id", "ref_id", "recorded_at", "kind")


def all_references(spark: SparkSession, d: str) -> DataFrame:
    qa = table(spark, d, "qa_regression")

    def part(df: DataFrame, name: str, field: str, row: str, ref, kind: str) -> DataFrame:
        return df.select(
            F.lit(name).alias("table_name"),
            F.lit(field).alias("field"),
            F.col(row).alias("row_id"),
            ref.alias("ref_id"),
            "recorded_at",
            F.lit(kind).alias("kind"),
        )

    parts = [
        part(table(spark, d, "relations"), "relations", "target_id", "relation_row", F.col("target_id"), "entity"),
        part(table(spark, d, "evidence"), "evidence", "source_id", "evidence_row", F.col("source_id"), "source"),
        *[
            part(qa, "qa_regression", f, "qa_row", F.explode(f), "entity")
            for f in ("required_authority_ids", "required_rule_ids")
        ],
    ]
    return reduce(DataFrame.unionByName, parts)


def _parents(spark: SparkSession, d: str) -> DataFrame:
    names = hanging.entity_targets(table(spark, d, "entities"), table(spark, d, "id_aliases"))
    sources = hanging.source_targets(table(spark, d, "sources"))
    return (
        names.drop("entity_id").withColumn("kind", F.lit("entity")).unionByName(sources.withColumn("kind", F.lit("source")))
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hanging.hanging_references(all_references(spark, d), _parents(spark, d)).drop("recorded_at")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    refs = all_references(spark, d)
    return hanging.orphan_report(refs, hanging.hanging_references(refs, _parents(spark, d)))


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    chunks = intervals.day_intervals(table(spark, d, "chunks"), "entity_id", "valid_from", "valid_until", False)
    rules = intervals.day_intervals(table(spark, d, "temporal"), "rule_id", "applicable_from", "applicable_to", True)
    return chunks.select(F.lit("chunks").alias("table_name"), "*").unionByName(
        rules.select(F.lit("temporal").alias("table_name"), "*")
    )


_KEYS = ("table_name", "entity_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.period_gaps(intervals.merged_periods(_intervals(spark, d), _KEYS), _KEYS)


def p2_periods(spark: SparkSession, d: str) -> DataFrame:
    return intervals.period_table(intervals.merged_periods(_intervals(spark, d), _KEYS), _KEYS)


def _events(spark: SparkSession, d: str) -> DataFrame:
    targets = hanging.entity_targets(table(spark, d, "entities"), table(spark, d, "id_aliases"))
    return asof.required_entities(
        table(spark, d, "qa_regression"), targets, ["required_authority_ids", "required_rule_ids"]
    )


def _first_sections(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    return chunks.where(F.col("chunk_id") == F.concat("entity_id", F.lit("::section-001")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    history = asof.attribute_history(_first_sections(spark, d), ["legal_status"])
    known = asof.as_known(_events(spark, d), history, ["legal_status"], "qa_row")
    return known.select("qa_row", "entity_id", F.col("legal_status_row").alias("chunk_row"))


def p6_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Several attributes, each from its own history: null values of an attribute are no change of it."""
    names = ["legal_status", "status", "heading"]
    sections = _first_sections(spark, d)
    history = asof.attribute_history(sections, names).where("value is not null and value != ''")
    known = asof.as_known(_events(spark, d), history, names, "qa_row")
    return known.select("qa_row", "entity_id", F.date_from_unix_date("day").cast("string").alias("as_of"), *names)


_DAY = r"(regexp_full_match({0}, '\d{{4}}-\d{{2}}-\d{{2}}') and left({0}, 4) <> '0000' and try_cast({0} as date) is not null)"
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)"
_KEY = f"lower(trim({{0}}, {_BLANKS}))"

_TARGETS = f"""
ids as (
  select {_KEY.format("id")} as key, min(id) as entity_id, bool_and(deleted_at is not null) as gone,
         min(registered_at) as since
  from entities where id is not null group by 1),
via as (
  select a.key, i.entity_id, i.gone, i.since,
         row_number() over (partition by a.key order by i.gone, i.since, i.entity_id) as place
  from (select distinct {_KEY.format("alias_id")} as key, {_KEY.format("canonical_id")} as canon from id_aliases) a
  join ids i on i.key = a.canon where a.key not in (select key from ids)),
names as (
  select key, entity_id, gone, since from ids
  union all select key, entity_id, gone, since from via where place = 1)"""

_REFS = """
refs as (
  select 'relations' as table_name, 'target_id' as field, relation_row as row_id, target_id as ref_id, recorded_at, 'entity' as kind from relations
  union all select 'evidence', 'source_id', evidence_row, source_id, recorded_at, 'source' from evidence
  union all select 'qa_regression', 'required_authority_ids', qa_row, unnest(required_authority_ids), recorded_at, 'entity' from qa_regression
  union all select 'qa_regression', 'required_rule_ids', qa_row, unnest(required_rule_ids), recorded_at, 'entity' from qa_regression)"""

_HANGING = f"""
with {_REFS.strip()}, {_TARGETS.strip()},
parents as (
  select 'entity' as kind, key, gone, since from names
  union all
  select 'source', {_KEY.format("source_id")}, bool_and(deleted_at is not null), min(registered_at)
  from sources group by 1, 2),
hung as (
  select r.table_name, r.field, r.row_id, r.ref_id, r.recorded_at,
         case when p.key is null then 'missing' when p.gone then 'deleted'
              when p.since > r.recorded_at then 'late' end as reason
  from refs r left join parents p on p.kind = r.kind and p.key = {_KEY.format("r.ref_id")}
  where r.ref_id is not null and {_KEY.format("r.ref_id")} <> '')"""

_PERIODS = f"""
with spans as (
  select 'chunks' as table_name, entity_id, valid_from as a, valid_until as b, 0 as more from chunks
  union all select 'temporal', rule_id, applicable_from, applicable_to, 1 from temporal),
days as (
  select distinct table_name, entity_id, cast(a as date) as first,
         case when b is null or b = '' or b = '9999-12-31' then date '9999-12-31' + 1 else cast(b as date) + more end as stop
  from (select * from spans where entity_id is not null and {_DAY.format("a")}
        and (b is null or b = '' or {_DAY.format("b")}))),
marked as (
  select *, max(stop) over (partition by table_name, entity_id order by first, stop rows between unbounded preceding and 1 preceding) as reach
  from days where stop > first),
labelled as (
  select *, sum(case when reach is null or first > reach then 1 else 0 end)
              over (partition by table_name, entity_id order by first, stop rows unbounded preceding) as island
  from marked),
periods as (
  select table_name, entity_id, island, min(first) as first, max(stop) as stop, count(distinct first) as n_starts
  from labelled group by 1, 2, 3)"""

_EVENTS = f"""
asks as (
  select distinct r.qa_row, n.entity_id, r.as_of, cast(r.as_of as date) as day
  from (select qa_row, as_of, unnest(required_authority_ids) as ref from qa_regression where {_DAY.format("as_of")}
        union all select qa_row, as_of, unnest(required_rule_ids) from qa_regression where {_DAY.format("as_of")}) r
  join names n on n.key = {_KEY.format("r.ref")}),
versions as (
  select entity_id, chunk_row, legal_status, status, heading, indexed_at, cast(valid_from as date) as first,
         case when valid_until is null or valid_until = '' or valid_until = '9999-12-31' then null else cast(valid_until as date) end as stop
  from (select * from chunks where chunk_id = entity_id || '::section-001' and {_DAY.format("valid_from")}
        and (valid_until is null or valid_until = '' or {_DAY.format("valid_until")}))),
seen as (
  select a.qa_row, a.entity_id, a.as_of, v.*
  from asks a join versions v on v.entity_id = a.entity_id and v.first <= a.day
    and (v.stop is null or a.day < v.stop) and cast(v.indexed_at as date) <= a.day)"""


def _latest(attribute: str) -> str:
    return (
        f"(array_agg({attribute} order by first desc, indexed_at desc, chunk_row desc) "
        f"filter ({attribute} is not null and {attribute} <> ''))[1]"
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_periods": p2_periods,
    "p6_found": p6_found,
    "p6_attributes": p6_attributes,
}

SQL = {
    "p1_found": _HANGING + "\nselect table_name, field, row_id, ref_id, reason from hung where reason is not null",
    "p1_report": _HANGING
    + """
select table_name, field, coalesce(strftime(recorded_at, '%Y-%m'), 'unknown') as month, count(*) as n_refs,
       count(*) filter (reason = 'missing') as n_missing, count(*) filter (reason = 'deleted') as n_deleted,
       count(*) filter (reason = 'late') as n_late
from hung group by 1, 2, 3""",
    "p2_found": _PERIODS
    + """
select table_name, entity_id, cast(stop as varchar) as gap_from, cast(next_first - 1 as varchar) as gap_to
from (select *, lead(first) over (partition by table_name, entity_id order by first) as next_first from periods)
where next_first is not null""",
    "p2_periods": _PERIODS
    + """
select table_name, entity_id, cast(first as varchar) as period_from,
       case when stop <= date '9999-12-31' then cast(stop - 1 as varchar) end as period_to, n_starts
from periods""",
    "p6_found": f"with {_TARGETS.strip()}, {_EVENTS.strip()}"
    + """
select qa_row, entity_id, chunk_row from (
  select qa_row, entity_id, chunk_row, row_number() over (
    partition by qa_row, entity_id order by first desc, indexed_at desc, chunk_row desc) as place from seen)
where place = 1""",
    "p6_attributes": f"with {_TARGETS.strip()}, {_EVENTS.strip()}"
    + f"""
select * from (
  select qa_row, entity_id, as_of, {_latest("legal_status")} as legal_status, {_latest("status")} as status,
         {_latest("heading")} as heading
  from seen group by 1, 2, 3)
where legal_status is not null or status is not null or heading is not null""",
}
