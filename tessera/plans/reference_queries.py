"""Queries over the record tables: facets, resolution, graph, search, checks, comparisons."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, text
from ..functions.norm import claim_node, evidence_node, reference_key, scalar_text, source_node, strict_date
from ..operators import graph, quality, record_rules, resolve, rewrite, search, temporal, view
from ..operators.hanging import entity_targets
from ..session import lookup_join, shared_folder, table
from ..sinks import writers
from ..sources import frontmatter

DAY = "2024-06-30"
EARLIER = "2018-01-01"


# --- records -----------------------------------------------------------------


def _flat(spark: SparkSession, d: str) -> DataFrame:
    return view.latest_records(view.flat_records(table(spark, d, "entities")))


_LATEST = """
latest as (
  select * from (select *, row_number() over (partition by id order by exported_at desc nulls last, entity_row desc) as rn
                 from entities where id is not null) where rn = 1),
flat as (
  select entity_row, id, entity_type, coalesce(trim(title), '') as title,
         coalesce(trim(workflow.editorial_status), '') as status,
         coalesce(trim(workflow.ingestion_status), '') as ingestion_status,
         coalesce(trim(workflow.updated_on), '') as last_updated,
         coalesce(trim(workflow.review.cycle), '') as review_cycle,
         coalesce(trim(workflow.review.checked_on), '') as last_checked,
         coalesce(trim(legal.status), '') as legal_status,
         coalesce(trim(legal.validity.valid_from), '') as effective_from,
         coalesce(nullif(coalesce(trim(legal.validity.valid_until), ''), ''), '9999-12-31') as effective_to,
         coalesce(trim(legal.superseded_by), '') as superseded_by,
         coalesce(trim(verification.verified_on), '') as last_verified,
         authority_profile.level as authority_level, exported_at
  from latest)"""


def _date(x: str) -> str:
    real = rf"regexp_full_match({x}, '\d{{4}}-\d{{2}}-\d{{2}}') and left({x}, 4) <> '0000'"
    return f"(case when {real} then try_cast({x} as date) end)"


def flat_view(spark, d):
    return _flat(spark, d).select(
        "entity_row", "id", "entity_type", "title", "status", "ingestion_status", "last_updated", "review_cycle",
        "last_checked", "legal_status", "effective_from", "effective_to", "superseded_by", "last_verified", "authority_level",
    )


def status_facets(spark, d):
    return _flat(spark, d).groupBy("entity_type", "status", "legal_status").agg(F.count(F.lit(1)).alias("n_rows"))


def facet_grouping_sets(spark, d):
    sets = [["entity_type"], ["status"], ["legal_status"], []]
    sets = [[F.col(c) for c in s] for s in sets]
    return _flat(spark, d).groupingSets(sets, "entity_type", "status", "legal_status").agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n_rows")
    )


def facet_table(spark, d):
    return quality.facet_counts(_flat(spark, d), ["entity_type", "status", "legal_status", "review_cycle"])


def verified_current(spark, d):
    flat = _flat(spark, d).where("status = 'verified' and legal_status = 'current'")
    return temporal.as_of(flat, DAY, "effective_from", "effective_to").select(
        "id", "title", "effective_from", "effective_to"
    )


def review_queue(spark, d):
    late = temporal.review_overdue("review_cycle", "last_checked", DAY)
    return _flat(spark, d).where(F.col("status").isin("draft", "review") | late).select(
        "id", "status", "review_cycle", "last_checked", late.alias("overdue")
    )


def future_records(spark, d):
    return _flat(spark, d).where(strict_date("effective_from") > F.lit(DAY).cast("date")).select("id", "effective_from")


def ingestion_queue(spark, d):
    return _flat(spark, d).where("ingestion_status != 'verified'").select("id", "ingestion_status", "last_updated")


def infer_legal_status(spark, d):
    flat = _flat(spark, d)
    status = temporal.legal_status_on(
        strict_date("effective_from"), strict_date("effective_to"), F.col("superseded_by") != "",
        F.col("legal_status") == "overruled", DAY,
    )
    return flat.select("id", "legal_status", status.alias("inferred"))


def recent_records(spark, d):
    return search.top_ranked(_flat(spark, d).select("id", "last_updated", "title"), 20, [F.desc("last_updated"), "title", "id"])


def type_numbering(spark, d):
    numbered = resolve.numbered(_flat(spark, d).select("id", "entity_type", "title"), "entity_type", [F.lower("title"), "id"])
    label = F.concat(F.upper(F.substring("entity_type", 1, 2)), F.lit("-"), F.lpad(F.col("number").cast("string"), 4, "0"))
    return numbered.select("id", "entity_type", F.col("number").cast("bigint").alias("number"), label.alias("label"))


def paginate(spark, d):
    return search.page(_flat(spark, d).select("id", "title"), 3, 10, ["title", "id"])


def record_slugs(spark, d):
    return _flat(spark, d).select("id", text.slug("title", "id").alias("slug"), text.html_escape("title").alias("safe_title"))


def record_search_text(spark, d):
    flat = _flat(spark, d)
    parts = ["id", "title", "entity_type", "status", "legal_status"]
    return flat.select("id", view.search_text([F.col(p) for p in parts] + [F.array_join("aliases", " ")]).alias("search_text"))


# --- names and references ------------------------------------------------------


def _names(spark, d) -> DataFrame:
    own = resolve.name_table(table(spark, d, "entities"), "id", ["id", "title"], ["aliases", "id_aliases"])
    extra = table(spark, d, "id_aliases").select(F.col("canonical_id").alias("entity_id"), "alias_id")
    known = table(spark, d, "entities").select(F.col("id").alias("entity_id")).distinct()
    listed = resolve.name_table(extra.join(known, "entity_id", "left_semi"), "entity_id", ["alias_id"], [])
    return own.unionByName(listed).distinct()


def _resolved(spark, d) -> DataFrame:
    relations = table(spark, d, "relations").select("relation_row", "entity_id", "relation_type", "target_id", "note")
    return resolve.resolve(relations, _names(spark, d), "target_id", ["relation_row"])


def resolve_references(spark, d):
    return _resolved(spark, d).select("relation_row", "target_id", "n_matches", "resolved_id")


def broken_references(spark, d):
    return _resolved(spark, d).where("n_matches = 0 and trim(coalesce(target_id, '')) != ''").select("relation_row", "target_id")


def ambiguous_references(spark, d):
    """References that several records answer to: targets of relations, and other names that records give."""
    own = table(spark, d, "entities").select("entity_row", F.explode("aliases").alias("ref"))
    names = _names(spark, d)
    listed = resolve.resolve(own, names, "ref", ["entity_row"]).select(F.lit("entities").alias("table_name"), F.col("entity_row").alias("row"), "ref", "n_matches")
    related = _resolved(spark, d).select(F.lit("relations").alias("table_name"), F.col("relation_row").alias("row"), F.col("target_id").alias("ref"), "n_matches")
    return listed.unionByName(related).where("n_matches > 1")


_NORM = (
    r"lower(regexp_replace(regexp_replace(regexp_replace(replace(trim({0}), '\', '/'), '^\./', ''), '^/+', ''), "
    r"'\.[mM][dD]$', ''))"
)
_BASE = r"regexp_extract({0}, '([^/]*)$', 1)"
_NAMES = f"""
spelled as (
  select id as entity_id, unnest(list_concat([id, title], coalesce(aliases, []), coalesce(id_aliases, []))) as name from entities
  union all select canonical_id, alias_id from id_aliases where canonical_id in (select id from entities)),
keyed as (select entity_id, {_NORM.format("name")} as key from spelled where trim(name) <> '' and entity_id is not null),
names as (
  select distinct key, entity_id from (
    select key, entity_id from keyed union all select {_NORM.format(_BASE.format("key"))}, entity_id from keyed) where key <> ''),
counts as (select key, count(*) as n_matches, case when count(*) = 1 then min(entity_id) end as entity_id from names group by 1),
asked as (select *, {_NORM.format("coalesce(target_id, '')")} as key from relations),
resolved as (
  select a.relation_row, a.entity_id, a.relation_type, a.ordinal, a.target_id, a.note,
         coalesce(f.n_matches, b.n_matches, 0) as n_matches,
         case when f.key is not null then f.entity_id else b.entity_id end as resolved_id
  from asked a left join counts f on f.key = a.key
  left join counts b on b.key = {_NORM.format(_BASE.format("a.key"))})"""


def _targets(spark, d) -> DataFrame:
    return entity_targets(table(spark, d, "entities"), table(spark, d, "id_aliases"))


def _qa_refs(spark, d) -> DataFrame:
    qa = table(spark, d, "qa_regression")
    parts = [
        qa.select("qa_row", F.lit(f).alias("field"), F.posexplode(f).alias("pos", "ref_id"))
        for f in ("required_authority_ids", "required_rule_ids")
    ]
    refs = reduce(DataFrame.unionByName, parts).withColumn("key", F.coalesce(reference_key("ref_id"), F.lit("")))
    targets = _targets(spark, d).select("key", "entity_id")
    types = view.latest_records(table(spark, d, "entities").select("id", "entity_type", "exported_at", "entity_row"))
    found = lookup_join(refs, targets, ["key"], ["qa_row", "pos"], "left")
    types = types.select(F.col("id").alias("entity_id"), "entity_type")
    return lookup_join(found, types, ["entity_id"], ["qa_row", "pos"], "left")


def qa_reference_resolution(spark, d):
    return _qa_refs(spark, d).select("qa_row", "field", "pos", "ref_id", "entity_id", "entity_type")


#: Types that a field or a relation may point to.
_EXPECTED = {
    "required_rule_ids": ("rule",), "required_authority_ids": ("law", "case", "interpretation", "guide"), "illustrated_by": ("fact_pattern",),
    "overrules": ("case",), "amends": ("law",), "interprets": ("rule", "law"),
}


def type_mismatch_references(spark, d):
    """References to records of another type than their field or relation is meant for."""
    cases = _qa_refs(spark, d).select(F.lit("qa_regression").alias("table_name"), F.col("qa_row").alias("row"), "field", "pos", "entity_id", "entity_type")
    types = view.latest_records(table(spark, d, "entities").select("id", "entity_type", "exported_at", "entity_row"))
    types = types.select(F.col("id").alias("resolved_id"), "entity_type")
    related = lookup_join(_resolved(spark, d), types, ["resolved_id"], ["relation_row"]).select(
        F.lit("relations").alias("table_name"), F.col("relation_row").alias("row"), F.col("relation_type").alias("field"),
        F.lit(0).alias("pos"), F.col("resolved_id").alias("entity_id"), "entity_type",
    )
    wrong = reduce(lambda c, kv: c.when(F.col("field") == kv[0], ~F.col("entity_type").isin(*kv[1])), _EXPECTED.items(), F.when(F.lit(False), F.lit(False)))
    return cases.unionByName(related).where(wrong)


def duplicate_ids(spark, d):
    return resolve.duplicates(table(spark, d, "entities"), ["id"])


def duplicate_relations(spark, d):
    relations = table(spark, d, "relations").withColumn("key", reference_key("target_id"))
    return resolve.later_duplicates(relations, ["entity_id", "relation_type", "key"], "relation_row").select(
        "relation_row", "entity_id", "relation_type", "target_id"
    )


def orphan_entities(spark, d):
    """Records that no relation starts from, and whether one leads to them."""
    flat = _flat(spark, d).select("id", "title", "entity_type")
    starts = table(spark, d, "relations").select(F.col("entity_id").alias("id")).where("id is not null").distinct()
    ends = _resolved(spark, d).select(F.col("resolved_id").alias("id")).where("id is not null").distinct()
    bare = lookup_join(flat, starts, ["id"], ["id"], "left_anti")
    found = lookup_join(bare, ends.withColumn("named", F.lit(True)), ["id"], ["id"], "left")
    return found.select("id", "title", "entity_type", F.coalesce("named", F.lit(False)).alias("is_target"))


def vocab_violations(spark, d):
    entities, relations = table(spark, d, "entities"), table(spark, d, "relations")
    each = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(c).alias("value"))
            for f, c in (
                ("entity_type", "entity_type"), ("status", "workflow.editorial_status"),
                ("legal_status", "legal.status"), ("review_cycle", "workflow.review.cycle"),
            )
        ]
    )
    values = entities.select(F.explode(each).alias("e")).select("e.field", "e.value").unionByName(
        relations.select(F.lit("relation_type").alias("field"), F.col("relation_type").alias("value"))
    ).unionByName(table(spark, d, "chunks").select(F.lit("legal_status").alias("field"), F.col("legal_status").alias("value"))).unionByName(
        entities.select(F.lit("verification_method").alias("field"), F.explode("verification.methods").alias("value"))
    )
    counted = values.where("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_rows"))
    vocab = table(spark, d, "vocab").select("field", F.col("code").alias("value"))
    return counted.join(vocab, ["field", "value"], "left_anti")


_REQUIRED = {
    "title": "title", "jurisdiction": "jurisdiction", "verified_on": "verification.verified_on",
    "checked_on": "workflow.review.checked_on", "valid_from": "legal.validity.valid_from", "as_of": "legal.as_of",
}


def missing_fields(spark, d):
    each = F.array(*[F.struct(F.lit(n).alias("field"), scalar_text(c).alias("value")) for n, c in _REQUIRED.items()])
    return (
        table(spark, d, "entities").select("entity_row", "id", F.explode(each).alias("e")).where("e.value = ''")
        .select("entity_row", "id", "e.field")
    )


def alias_closure(spark, d):
    links = table(spark, d, "id_aliases").select(F.col("alias_id").alias("alias"), F.col("canonical_id").alias("target"))
    return resolve.alias_closure(links, spark)


def alias_parity(spark, d):
    """Aliases that only the records or only the alias table have."""
    own = table(spark, d, "entities").select(F.explode("id_aliases").alias("alias")).where("trim(alias) != ''").distinct()
    listed = table(spark, d, "id_aliases").select(F.col("alias_id").alias("alias")).distinct()
    return own.withColumn("a", F.lit(1)).join(listed.withColumn("b", F.lit(1)), "alias", "full").where(
        "a is null or b is null"
    ).select("alias", F.when(F.col("a").isNull(), "records").otherwise("table").alias("missing_in"))


# --- time --------------------------------------------------------------------------


def asof_effective(spark, d):
    return temporal.as_of(table(spark, d, "chunks"), "2020-06-30", "valid_from", "valid_until").select(
        "chunk_row", "entity_id", "valid_from", "valid_until"
    )


def temporal_order_check(spark, d):
    chunks = table(spark, d, "chunks").select(F.col("chunk_row").alias("row"), F.col("valid_from").alias("a"), F.col("valid_until").alias("b"))
    rules = table(spark, d, "temporal").select(F.col("temporal_row").alias("row"), F.col("applicable_from").alias("a"), F.col("applicable_to").alias("b"))
    both = chunks.withColumn("table_name", F.lit("chunks")).unionByName(rules.withColumn("table_name", F.lit("temporal")))
    return both.where(strict_date("a") > strict_date("b")).select("table_name", "row", "a", "b")


def review_deadlines(spark, d):
    return _flat(spark, d).groupBy("review_cycle").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(temporal.review_overdue("review_cycle", "last_checked", DAY)).alias("n_overdue"),
    )


def supersession_check(spark, d):
    """Diagnostics of replaced records; where none names its successor, that of its relation counts."""
    newer = _resolved(spark, d).where("relation_type = 'supersedes'").select(F.coalesce("resolved_id", "target_id").alias("id"), "entity_id")
    newer = newer.where("id is not null").groupBy("id").agg(F.min("entity_id").alias("__by"))
    flat = lookup_join(_flat(spark, d), newer, ["id"], ["id"], "left").withColumn("superseded_by", F.coalesce(F.nullif("superseded_by", F.lit("")), "__by", F.lit("")))
    flat = flat.withColumn("superseded_date", F.coalesce(F.nullif("superseded_date", F.lit("")), F.when(F.col("superseded_by") != "", F.col("last_updated")), F.lit("")))
    return temporal.supersession_issues(flat, _targets(spark, d)).select("severity", "code", "path", "field", "message")


# --- graph --------------------------------------------------------------------------


def _claims() -> Column:
    return F.filter(F.transform(F.coalesce("supports", F.array().cast("array<string>")), lambda c: F.trim(c)), lambda c: c != "")


def graph_nodes(spark, d):
    flat = _flat(spark, d)
    entities = flat.select("id", F.lit("entity").alias("node_type"), "title", F.lit(None).cast("string").alias("owner_id"))
    evidence = table(spark, d, "evidence")
    claims = (
        evidence.select("entity_id", F.explode(_claims()).alias("claim")).distinct()
        .select(claim_node("entity_id", "claim").alias("id"), F.lit("claim").alias("node_type"),
                F.col("claim").alias("title"), F.col("entity_id").alias("owner_id"))
    )
    sources = table(spark, d, "sources").groupBy("source_id").agg(F.min("title").alias("title"))
    sources = sources.select(source_node("source_id").alias("id"), F.lit("source").alias("node_type"), "title")
    return graph.union_nodes([entities, claims, sources])


_LISTS = ["origin", "note", "evidence_ref", "claim_ref", "link"]


def _edge_rows(spark, d) -> DataFrame:
    """Rows of edges: relations, and of each piece of evidence what it asserts and what supports that."""
    nothing = F.lit(None).cast("string")
    relations = _resolved(spark, d).select(
        F.col("entity_id").alias("source"), F.col("relation_type").alias("relation"),
        F.coalesce("resolved_id", F.trim("target_id")).alias("target"), F.lit("relations").alias("origin"),
        F.col("note"), nothing.alias("evidence_ref"), nothing.alias("claim_ref"), nothing.alias("link"),
        F.struct(F.col("relation_row").alias("row"), F.lit(0).alias("pos")).alias("ord"),
    )
    source = source_node(reference_key("source_id"))
    ref = evidence_node("entity_id", F.trim("evidence_id"))
    claims = F.transform(_claims(), lambda c: claim_node("entity_id", c))

    def edge(a, relation: str, b, claim, note) -> Column:
        return F.struct(a.alias("source"), F.lit(relation).alias("relation"), b.alias("target"), claim.alias("claim_ref"), note.alias("note"))

    entity, locator = F.col("entity_id"), F.col("locator")
    of_claim = F.flatten(F.transform("claims", lambda c: F.array(
        edge(entity, "asserts", c, c, nothing), edge(c, "supported_by", F.col("node"), c, locator), edge(entity, "supported_by", F.col("node"), c, locator)
    )))
    alone = F.array(edge(entity, "supported_by", F.col("node"), nothing, locator))
    key = F.coalesce(reference_key("source_id"), F.lit(""))
    evidence = table(spark, d, "evidence").select(
        "entity_id", "locator", "evidence_row", ref.alias("ref"), F.when(key != "", source).alias("node"), claims.alias("claims")
    )
    each = evidence.select("ref", "evidence_row", F.posexplode(F.when(F.size("claims") > 0, of_claim).otherwise(alone)).alias("pos", "e"))
    return relations.unionByName(each.select(
        "e.source", "e.relation", "e.target", F.lit("evidence").alias("origin"), "e.note", F.col("ref").alias("evidence_ref"), "e.claim_ref",
        graph.evidence_link("ref", "e.note", "e.claim_ref").alias("link"), F.struct(F.col("evidence_row").alias("row"), "pos").alias("ord"),
    ))


def graph_edges(spark, d):
    edges = graph.merge_edges(_edge_rows(spark, d), _LISTS)
    links = F.transform(graph.evidence_links("link"), lambda x: F.concat_ws("~", x["evidence_ref"], x["locator"], x["claim_ref"]))
    lists = [F.array_join(c, "|").alias(c) for c in _LISTS[:-1]]
    return graph.ordered_edges(edges.select("id", "source", "relation", "target", "n_rows", *lists, F.array_join(links, "|").alias("evidence_links")))


def graph_integrity(spark, d):
    return graph.edge_issues(graph_nodes(spark, d), graph.merge_edges(_edge_rows(spark, d), ["origin"]))


def graph_stats(spark, d):
    """Nodes by type and edges by relation, with how many have evidence."""
    nodes = graph_nodes(spark, d).groupBy(F.lit("node").alias("part"), F.col("node_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("n_with_evidence"))
    edges = graph.merge_edges(_edge_rows(spark, d), ["evidence_ref"])
    counted = edges.groupBy(F.lit("edge").alias("part"), F.col("relation").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("evidence_ref") > 0).alias("n_with_evidence")
    )
    return nodes.unionByName(counted)


def related_entities(spark, d):
    edges = graph.merge_edges(_edge_rows(spark, d).where("origin = 'relations'"), ["origin"])
    return graph.related(edges).select("entity_id", "other_id", F.array_join("relations", "|").alias("relations"))


def decision_path(spark, d):
    """fact pattern, its first rule, and that rule's first law."""
    edges = _resolved(spark, d).where("resolved_id is not null").select(
        F.col("entity_id").alias("source"), F.col("relation_type").alias("relation"), F.col("resolved_id").alias("target"), F.col("relation_row").alias("ord")
    )
    types = _flat(spark, d).select("id", F.col("entity_type").alias("node_type"))
    order = ["applies", "implements", "cites"]
    rule = graph.first_related(edges, types, "rule", order).withColumnRenamed("target", "rule_id")
    law = graph.first_related(edges, types, "law", order).select(F.col("source").alias("rule_id"), F.col("target").alias("law_id"))
    facts = types.where("node_type = 'fact_pattern'").select(F.col("id").alias("source"))
    of_facts = lookup_join(rule, facts, ["source"], ["source"], "left_semi")
    found = lookup_join(of_facts, law, ["rule_id"], ["source"])  # many facts may meet in one rule
    return found.select(F.col("source").alias("fact_id"), "rule_id", "law_id")


def order_path(spark, d):
    """Four-hop path order, customer, nation, region with the orders of each end."""
    path = (
        table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return path.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_orders"))


def evidence_supports(spark, d):
    evidence = table(spark, d, "evidence")
    each = evidence.select("entity_id", "evidence_row", F.posexplode("supports").alias("pos", "claim"))
    each = each.withColumn("ord", F.struct("evidence_row", "pos"))
    listed = graph.ordered_items(each, ["entity_id"], "claim", "ord")
    return listed.select("entity_id", F.array_join("items", "|").alias("claims"), F.size("items").cast("bigint").alias("n_claims"))


def claim_plan(spark, d):
    """Anchors by the scanner of Markdown lines; ids of an entity's headings, in any of its chunks, and of pages are taken."""
    chunks = table(spark, d, "chunks")
    section = F.when(~F.trim("heading").isin("", markup.DEFAULT_HEADING) & ~F.trim("heading").eqNullSafe(F.trim("title")), text.heading_fragment("heading"))
    heads = F.concat(F.coalesce(markup.heading_ids("content", "title"), F.array()), F.array_compact(F.array(section)))
    marks = F.transform(markup.claim_anchors("content").getField("accepted"), lambda a: F.struct(a["claim_id"], a["text"], F.lit(False).alias("reserved")))
    taken = F.transform(heads, lambda h: F.struct(h.alias("claim_id"), F.lit("").alias("text"), F.lit(True).alias("reserved")))
    anchors = chunks.select("entity_id", F.inline(F.concat(marks, taken))).where(
        F.col("claim_id").rlike("^[a-z][a-z0-9-]{0,63}$") & ~F.col("claim_id").isin(*markup.PAGE_IDS)
    )
    supports = table(spark, d, "evidence").select("entity_id", "evidence_id", F.explode("supports").alias("claim_id")).where("trim(claim_id) != ''")
    return graph.claim_plan(anchors, supports)


# --- text and search --------------------------------------------------------------


def claim_anchors(spark, d):
    found = table(spark, d, "chunks").select("chunk_row", markup.claim_anchors("content").alias("a"))
    return found.select("chunk_row", F.explode("a.accepted").alias("x")).select("chunk_row", "x.claim_id", "x.line", "x.text")


def section_list(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.posexplode(markup.section_list("text")).alias("pos", "s"))
    return found.select("doc_id", "pos", "s.heading", F.length("s.content").alias("n_chars"), F.sha2("s.content", 256).alias("digest"))


def heading_sections(spark, d):
    """Sections by heading lines in native expressions: number, heading line and size of each."""
    marked = F.regexp_replace("text", r"(^|\n)(#{1,6} )", "$1\u0001$2")
    parts = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split(marked, "\u0001")).alias("section_no", "part"))
    return parts.where("trim(part) != ''").select(
        "doc_id", "section_no", F.regexp_extract("part", "^#{1,6} ([^\r\n]*)", 1).alias("heading"), F.length("part").alias("n_chars")
    )


def summaries(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", markup.summary_text("text").alias("summary"))


def plain_text(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.sha2(text.plain_text("text"), 256).alias("digest"))


def heading_anchors(spark, d):
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    heads = lines.where(F.col("line").rlike(r"^#{1,6} +[^ \r]"))
    return heads.select("doc_id", "pos", text.heading_fragment(F.regexp_replace("line", r"^#{1,6} +", "")).alias("anchor"))


def term_postings(spark, d):
    return search.term_counts(table(spark, d, "chunks"), "chunk_row", list(_WEIGHTS))


_QUERY, _WEIGHTS = "야간근로수당 OR 별지 OR standby", {"title": 2.0, "heading": 1.0, "content": 1.0}


def _index(spark, d) -> search.Index:
    """The postings of the sections, written to the shared folder at a session's first search in ``d``."""
    root = f"{shared_folder(spark)}/sections-{hashlib.sha256(d.encode()).hexdigest()[:16]}"
    if root not in _WRITTEN:
        writers.write_postings(table(spark, d, "chunks"), root)
        _WRITTEN.add(root)
    return search.open_index(spark, root)


_WRITTEN: set[str] = set()


def _ranked(spark, d, *columns: str) -> DataFrame:
    """Ranks of the matching sections from the index, with further columns of these sections."""
    ranked = search.search_index(_index(spark, d), _QUERY, _WEIGHTS).withColumn("rank", F.round("rank", 9))
    return table(spark, d, "chunks").select("chunk_row", *columns).join(ranked, "chunk_row") if columns else ranked


def bm25_topk(spark, d):
    return search.top_ranked(_ranked(spark, d), 50, ["rank", "chunk_row"])


def search_filtered(spark, d):
    ranked = _ranked(spark, d, "entity_id", "status", "legal_status", "valid_from", "valid_until")
    found = temporal.as_of(ranked.where("status in ('verified', 'review') and legal_status = 'current'"), DAY, "valid_from", "valid_until")
    return search.top_ranked(found.select("chunk_row", "entity_id", "rank"), 20, ["rank", "chunk_row"])


def match_language(spark, d):
    """Rows per query of the match language: AND, OR, NOT, phrase, prefix, field, NEAR."""
    chunks, fields = search.tokenised(table(spark, d, "chunks").select(*_WEIGHTS), list(_WEIGHTS))
    queries = {
        "and": "야간근로수당 별지", "not": "별지 NOT 통신보조비", "phrase": '"지급 내역은"', "prefix": "야간*",
        "field": "heading: 근거자료", "near": "NEAR(내역은 표와, 4)", "group": "(standby OR meal) AND employer",
        "not_of_both": "별지 표와 NOT 통신보조비 내역은", "not_and": "별지 AND 표와 NOT 통신보조비", "nots": "별지 NOT 통신보조비 NOT 내역은 OR standby",
        "fields": "{title heading}: 근거자료", "outside": "- content: 근거자료", "start": "heading: ^ 근거자료", "joined": "지급 + 내역은",
    }
    counts = [F.count_if(search.matches(search.parse_match(q), fields)).alias(n) for n, q in queries.items()]
    return chunks.agg(*counts)


def snippets(spark, d):
    top = search.top_ranked(_ranked(spark, d), 50, ["rank", "chunk_row"])
    texts = table(spark, d, "chunks").select("chunk_row", "content").join(F.broadcast(top), "chunk_row")  # 50 rows
    return texts.select("chunk_row", search.snippet(F.col("content"), _QUERY).alias("snippet"))


def additive_relevance(spark, d):
    body = text.plain_text(markup.without_claim_marks("text"))
    parts = {c: F.col(c) for c in ("title", "source", "entity_type")}
    parts |= {"summary": markup.summary_text("text"), "whole": view.search_text([*parts.values(), body])}
    # Out of a generator: the filter below would fold again.
    folded = F.inline(F.array(F.struct(*[F.coalesce(markup.folded(c), F.lit("")).alias(n) for n, c in parts.items()])))
    docs = table(spark, d, "documents").select("doc_id", folded)
    score = search.additive_score(search.fold_query("수당 지급"), *[F.col(c) for c in ("title", "source", "summary", "entity_type", "whole")])
    return docs.select("doc_id", score.alias("score")).where("score >= 0")


def recent_documents(spark, d):
    return search.top_ranked(table(spark, d, "documents").select("doc_id", "title", "collected_at"), 4, [F.desc("collected_at"), "doc_id"])


# --- comparisons ----------------------------------------------------------------------


def source_labels(spark, d):
    host = F.regexp_extract("location_value", r"^https?://([^/]+)", 1)
    located = table(spark, d, "sources").select("source_row", "source_id", *view.source_location())
    return located.select("source_row", "source_id", "location_kind", "location_value", host.alias("host"))


def content_manifest(spark, d):
    files = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    return quality.manifest(files)


def manifest_diff(spark, d):
    def state(day: str) -> DataFrame:
        known = table(spark, d, "chunks").where(F.col("indexed_at") < F.to_timestamp_ntz(F.lit(day + " 00:00:00")))
        hashed = known.select("chunk_id", "indexed_at", "chunk_row", F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha"))
        return hashed.groupBy("chunk_id").agg(F.max_by("sha", F.struct("indexed_at", "chunk_row")).alias("sha"))

    return quality.diff(state(EARLIER), state(DAY), "chunk_id", "sha")


def set_digests(spark, d):
    return quality.set_digest(table(spark, d, "relations"), ["entity_id", "relation_type", "target_id"], ["relation_type"])


def baseline_verdicts(spark, d):
    relations = table(spark, d, "relations")
    columns, by = ["entity_id", "relation_type", "target_id"], ["relation_type"]
    early = relations.where(F.col("recorded_at") < F.to_timestamp_ntz(F.lit("2025-06-30 00:00:00")))
    return quality.compare_baseline(quality.set_digest(relations, columns, by), quality.set_digest(early, columns, by), by)


def _issues(spark, d) -> DataFrame:
    entities = table(spark, d, "entities")
    path = F.concat(F.lit("entities/"), F.col("entity_row").cast("string"))
    dup = resolve.duplicates(entities.where("id is not null"), ["id"])
    parts = [
        dup.select(*graph.issue("critical", "DUPLICATE_ID", "id", "id", F.col("n_rows").cast("string"))),
        entities.where("coalesce(trim(title), '') = ''").select(*graph.issue("high", "TITLE_MISSING", path, "title", F.lit("no title"))),
        entities.where("size(array_distinct(aliases)) < size(aliases)").select(
            *graph.issue("medium", "DUPLICATE_LIST_VALUE", path, "aliases", F.lit("repeated alias"))
        ),
        broken_references(spark, d).select(
            *graph.issue("critical", "BROKEN_REFERENCE", F.concat(F.lit("relations/"), F.col("relation_row").cast("string")), "target_id", F.col("target_id"))
        ),
        temporal_order_check(spark, d).select(
            *graph.issue("high", "TEMPORAL_ORDER", F.concat("table_name", F.lit("/"), F.col("row").cast("string")), "period", F.concat("a", F.lit(" > "), "b"))
        ),
        table(spark, d, "evidence").where("coalesce(trim(locator), '') = ''").select(
            *graph.issue("high", "EVIDENCE_LOCATOR", F.concat(F.lit("evidence/"), F.col("evidence_row").cast("string")), "locator", F.lit("no locator"))
        ),
    ]
    return quality.union_issues(parts)


def issue_report(spark, d):
    return quality.ordered_issues(_issues(spark, d))


def top_issues(spark, d):
    """The hundred worst issues, in order."""
    return quality.ordered_issues(_issues(spark, d)).limit(100)


def severity_gate(spark, d):
    return quality.severity_counts(spark, _issues(spark, d))


def migration_plan(spark, d):
    """What a rewrite of old records would change, by schema version: dates to null, lists without repeats."""
    e = table(spark, d, "entities")
    open_end = F.col("legal.validity.valid_until") == "9999-12-31"
    repeats = F.size(F.array_distinct("id_aliases")) < F.size("id_aliases")
    blank = F.exists("aliases", lambda x: x.isNull() | (F.trim(x) == ""))
    old = F.col("schema_version") != "1.4"
    flag = lambda c: F.coalesce(c, F.lit(False))
    change = old | flag(open_end) | flag(repeats) | flag(blank)
    return e.groupBy("schema_version").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(change).alias("n_changes"), F.count_if(open_end).alias("n_open_ends"),
        F.count_if(blank).alias("n_blank_aliases"),
    )


def frontmatter_roundtrip(spark, d):
    """Records rendered as front-mattered documents, parsed again and compared."""
    e = table(spark, d, "entities").select("entity_row", F.to_json(F.struct("id", "entity_type", "title", "aliases", "workflow", "legal", "authority_profile"), {"ignoreNullFields": "false"}).alias("header"), F.lit("Body\n").alias("body"))
    rendered = frontmatter.render_documents(e).select("entity_row", F.col("header").alias("original"), F.col("rendered").alias("text"))
    parsed = frontmatter.parse_documents(rendered)
    same = F.parse_json("original").cast("string") == F.parse_json("header").cast("string")
    return parsed.select("entity_row", F.coalesce(same, F.lit(False)).alias("same"), F.coalesce("error", F.lit("")).alias("error"))


# --- rule families ------------------------------------------------------------------------


def evidence_rules(spark, d):
    return record_rules.evidence_rules(table(spark, d, "evidence"), table(spark, d, "sources"))


def relation_rules(spark, d):
    return record_rules.relation_rules(table(spark, d, "relations"), _targets(spark, d), table(spark, d, "vocab"))


def source_rules(spark, d):
    return record_rules.source_rules(table(spark, d, "sources"), table(spark, d, "vocab"))


def qa_rules(spark, d):
    types = table(spark, d, "entities").groupBy(F.col("id").alias("entity_id")).agg(F.max("entity_type").alias("entity_type"))
    targets = lookup_join(_targets(spark, d).select("key", "entity_id"), types, ["entity_id"], ["key"])
    return record_rules.qa_rules(table(spark, d, "qa_regression"), targets)


def identity_rules(spark, d):
    return record_rules.identity_rules(table(spark, d, "entities"), table(spark, d, "id_aliases"))


def temporal_rules(spark, d):
    return record_rules.temporal_rules(table(spark, d, "chunks"), table(spark, d, "temporal"))


def verification_rules(spark, d):
    return record_rules.verification_rules(table(spark, d, "entities"), table(spark, d, "verifiers"), table(spark, d, "vocab"))


def rule_summary(spark, d):
    """Issues of all families by code and severity."""
    families = (evidence_rules, relation_rules, source_rules, qa_rules, identity_rules, temporal_rules, verification_rules)
    every = quality.union_issues([f(spark, d) for f in families])
    return every.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n_issues"))


# --- rewrites -------------------------------------------------------------------------------


def rewrite_changes(spark, d):
    """What bringing records into the nested form changes in them: per part the number of records."""
    e = view.latest_records(table(spark, d, "entities"))
    old = e.select(
        "id", "schema_version", "aliases", "id_aliases",
        F.struct("workflow.editorial_status", "workflow.ingestion_status", "workflow.updated_on",
                 F.struct("workflow.review.cycle", "workflow.review.checked_on").alias("review")).alias("workflow"),
        F.struct("legal.status", "legal.as_of", "legal.validity", "legal.superseded_by", "legal.superseded_on").alias("legal"),
    )
    new = rewrite.nested_records(view.flat_records(e))
    found = rewrite.change_report(old, new, "id", ["schema_version", "aliases", "id_aliases", "workflow", "legal"])
    return found.select(F.explode("changed").alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n_records"))


def source_locations(spark, d):
    return rewrite.located_sources(table(spark, d, "sources"), strict=False).select("source_row", "location.kind", "location.value")


def event_actions(spark, d):
    """Log actions per day."""
    return table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 4).alias("total")
    )


QUERIES = {
    f.__name__: f
    for f in (
        flat_view, status_facets, facet_grouping_sets, facet_table, verified_current, review_queue, future_records,
        ingestion_queue, infer_legal_status, recent_records, type_numbering, paginate, record_slugs, record_search_text,
        resolve_references, broken_references, ambiguous_references, qa_reference_resolution, type_mismatch_references,
        duplicate_ids, duplicate_relations, orphan_entities, vocab_violations, missing_fields, alias_closure, alias_parity,
        asof_effective, temporal_order_check, review_deadlines, supersession_check, graph_nodes, graph_edges,
        graph_integrity, graph_stats, related_entities, decision_path, order_path, evidence_supports, claim_plan, claim_anchors,
        section_list, heading_sections, summaries, plain_text, heading_anchors, term_postings, bm25_topk, search_filtered,
        match_language, snippets, additive_relevance, recent_documents, source_labels, content_manifest, manifest_diff,
        set_digests, baseline_verdicts, issue_report, top_issues, severity_gate, migration_plan, frontmatter_roundtrip, event_actions,
        evidence_rules, relation_rules, source_rules, qa_rules, identity_rules, temporal_rules, verification_rules,
        rule_summary, rewrite_changes, source_locations,
    )
}
