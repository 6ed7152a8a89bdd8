"""Queries of single projections, texts, rules and orders, each beside its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import flowchart, markup, text, values
from ..functions.norm import reference_key
from ..operators import checks, claims, graph, quality, resolve, rewrite, search, temporal, view
from ..session import lookup_join, table
from ..sources import frontmatter, readers
from .problem_queries import _TARGETS
from .reference_queries import _LATEST, _NAMES, DAY, _date, _flat, _names, _resolved, frontmatter_roundtrip, section_list, summaries

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_L, _N = f"with {_LATEST.strip()}", f"with {_NAMES.strip()}"

# --- projections ------------------------------------------------------------------


@_query(f"""select chunk_row, case when {_date("effective_from")} is not null then 'effective' when {_date("valid_from")} is not null then 'valid' end as label,
       coalesce(case when {_date("effective_from")} is not null then effective_from end, case when {_date("valid_from")} is not null then valid_from end) as day,
       case when regexp_full_match(valid_from, '\\d{{4}}-\\d{{2}}-\\d{{2}}') then left(valid_from, 4) || '. ' || cast(substr(valid_from, 6, 2) as int) || '. ' || cast(substr(valid_from, 9, 2) as int) || '.'
         else valid_from end as shown from chunks""")
def first_dates(spark, d):
    """The first real date of each section and how it was named, and the start as it is shown."""
    chunks = table(spark, d, "chunks")
    first = temporal.first_valid_date([("effective", F.col("effective_from")), ("valid", F.col("valid_from"))])
    return chunks.select("chunk_row", first.alias("f"), values.dotted_date("valid_from").alias("shown")).select("chunk_row", "f.label", "f.day", "shown")


_GROUPS = {"pay": ("bonus", "wage", "meal"), "time": ("shift", "standby", "holiday")}


@_query("""with e as (select evidence_row, generate_subscripts(supports, 1) as pos, unnest(supports) as s from evidence),
       l as (select evidence_row, case when s like '%bonus%' or s like '%wage%' or s like '%meal%' then 'pay'
         when s like '%shift%' or s like '%standby%' or s like '%holiday%' then 'time' else 'other' end as label, min(pos) as pos from e where trim(coalesce(s, '')) <> '' group by 1, 2)
       select r.evidence_row, coalesce(string_agg(label, '|' order by pos), '') as labels from evidence r left join l using (evidence_row) group by 1""")
def support_labels(spark, d):
    """Labels of what evidence supports, in the order of the claims."""
    return table(spark, d, "evidence").select("evidence_row", F.array_join(text.support_labels("supports", _GROUPS, "other"), "|").alias("labels"))


@_query("""with s as (select source_row, lower(regexp_extract(coalesce(location.url, ''), '^https?://(?:[^/@]*@)?([^/:?#]+)', 1)) as host from sources)
       select source_row, case when host = 'archive-0.example' or host like '%.archive-0.example' then 'first archive'
         when host = 'example' or host like '%.example' then 'archive' else 'none' end as label from s""")
def host_labels(spark, d):
    labels = {"archive-0.example": "first archive", "example": "archive"}
    return table(spark, d, "sources").select("source_row", values.host_label(F.col("location.url"), labels, "none").alias("label"))


def _authorities(spark, d) -> DataFrame:
    """Records with the flat form of authorities: the first that establishes them, and those they cite."""
    relations = table(spark, d, "relations").where("trim(coalesce(target_id, '')) != '' and entity_id is not null")
    by = relations.groupBy("entity_id", "relation_type", "target_id").agg(F.min("relation_row").alias("row"))
    primary = F.min_by("target_id", F.when(F.col("relation_type") == "establishes", F.col("row")))
    cited = F.array_sort(F.collect_list(F.when(F.col("relation_type") == "cites", F.struct("row", "target_id"))))
    flat = by.groupBy("entity_id").agg(primary.alias("primary"), F.transform(cited, lambda c: c["target_id"]).alias("supporting"))
    own = F.lit(None).cast("array<struct<target_id:string,role:string>>")
    return flat.select("entity_id", "primary", "supporting", own.alias("own"))


@_query("""with r as (select entity_id, relation_type, trim(target_id) as t, min(relation_row) as row from relations where trim(coalesce(target_id, '')) <> '' and entity_id is not null group by 1, 2, target_id),
       p as (select entity_id, arg_min(t, row) as t from r where relation_type = 'establishes' group by 1),
       s as (select entity_id, t from r where relation_type = 'cites' group by 1, 2)
       select entity_id, t as target_id, 'primary' as role from p
       union all select s.entity_id, s.t, 'supporting' from s left join p on p.entity_id = s.entity_id and p.t = s.t where p.t is null""")
def authority_view(spark, d):
    """Authorities of records in one form: target and role."""
    found = _authorities(spark, d).select("entity_id", F.explode(view.authority_records("own", "primary", "supporting")).alias("a"))
    return found.select("entity_id", "a.target_id", "a.role")


@_query("""with r as (select entity_id, relation_type, trim(target_id) as t from relations where trim(coalesce(target_id, '')) <> '' and entity_id is not null),
       p as (select entity_id, arg_min(trim(target_id), relation_row) as t from relations where relation_type = 'establishes' and trim(coalesce(target_id, '')) <> '' and entity_id is not null group by 1)
       select e.entity_id, (select count(distinct t) from (select t from r where r.entity_id = e.entity_id and relation_type = 'cites' union select t from p where p.entity_id = e.entity_id)) as n_targets
       from (select distinct entity_id from r) e""")
def authority_targets(spark, d):
    records = view.authority_records("own", "primary", "supporting")
    return _authorities(spark, d).select("entity_id", F.size(view.authority_target_ids(records)).cast("bigint").alias("n_targets"))


@_query("""select source_row, case when trim(coalesce(location.path, '')) <> '' then 'complete' when trim(coalesce(location.url, '')) <> '' then 'partial' else 'not_applicable' end as availability from sources""")
def source_availability(spark, d):
    have = F.when(F.trim(F.coalesce("location.path", F.lit(""))) != "", "available").when(F.trim(F.coalesce("location.url", F.lit(""))) != "", "partial").otherwise("unknown")
    return table(spark, d, "sources").select("source_row", have.alias("have")).select("source_row", view.availability("have").alias("availability"))


@_query("""with s as (select entity_id, trim(source_id) as s, min(evidence_row) as o from evidence where trim(coalesce(source_id, '')) <> '' and entity_id is not null group by 1, 2)
       select entity_id, string_agg(s, '|' order by o) as source_ids from s group by 1""")
def record_sources(spark, d):
    """Sources of records by their evidence, each at its first place."""
    evidence = table(spark, d, "evidence").where("entity_id is not null and trim(coalesce(source_id, '')) != ''")
    # Repeats are reduced first: a record's list is as long as it has sources.
    one = evidence.groupBy("entity_id", F.trim("source_id").alias("source_id")).agg(F.min("evidence_row").alias("row"))
    listed = one.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("row", "source_id"))).alias("evidence"))
    none = listed.withColumn("own", F.array().cast("array<string>"))
    return none.select("entity_id", F.array_join(view.source_ids("own", F.col("evidence")), "|").alias("source_ids"))


@_query(f"""{_N} select relation_row, 'legacy-conflict' as conflict_id, relation_type as type, case when resolved_id is null then 'open' else 'active' end as status, coalesce(trim(note), '') as note
       from resolved where relation_type in ('distinguishes', 'exception_to', 'overrules')""")
def conflict_view(spark, d):
    """Flat conflicts, as relations state them, in the form of conflict records."""
    kind = F.when(F.col("relation_type").isin("distinguishes", "exception_to", "overrules"), F.col("relation_type"))
    flat = _resolved(spark, d).select(
        "relation_row", kind.alias("kind"), F.when(F.col("resolved_id").isNull(), "open").otherwise("active").alias("state"), "note",
        F.lit(None).cast("array<struct<conflict_id:string,type:string,status:string,note:string>>").alias("own"),
    )
    return flat.select("relation_row", F.explode(view.conflict_records("own", "kind", "state", "note")).alias("c")).select("relation_row", "c.*")


_TYPES = ["law", "case", "interpretation", "rule", "guide"]


@_query(f"""{_L} select id, case entity_type when 'law' then 1 when 'case' then 2 when 'interpretation' then 3 when 'rule' then 4 when 'guide' then 5 else 6 end as type_rank from flat""")
def type_ranks(spark, d):
    return _flat(spark, d).select("id", view.type_rank("entity_type", _TYPES).alias("type_rank"))


@_query(f"""{_L} select id, title, last_updated from flat order by last_updated desc, title, id limit 30""")
def archive_list(spark, d):
    """The thirty latest records as archives list them."""
    flat = _flat(spark, d).select("id", "title", "last_updated")
    return search.top_ranked(flat, 30, [*view.archive_order("last_updated", "title"), "id"])


@_query()
def record_sorting(spark, d):
    """The first records of each sort mode, titles in Korean order."""
    flat = _flat(spark, d).select("id", "title", "entity_type", F.col("last_updated").alias("sort_date"))
    parts = [
        search.top_ranked(flat, 20, [*view.record_order(mode, _TYPES), "id"]).select(F.lit(mode).alias("mode"), "id", "title")
        for mode in view.SORT_MODES
    ]
    return reduce(DataFrame.unionByName, parts)


# --- dashboard views ------------------------------------------------------------------


@_query(f"""{_N}, {_LATEST.strip()} select id, title from flat f where entity_type = 'rule' and not exists (
       select 1 from resolved r where r.resolved_id = f.id and r.relation_type in ('establishes', 'supports', 'interprets'))""")
def rules_without_authority(spark, d):
    given = _resolved(spark, d).where(F.col("relation_type").isin("establishes", "supports", "interprets")).select(F.col("resolved_id").alias("id"))
    rules = _flat(spark, d).where("entity_type = 'rule'").select("id", "title")
    return lookup_join(rules, given.where("id is not null").distinct(), ["id"], ["id"], "left_anti")


@_query(f"""{_L} select id, status, last_checked from flat f where entity_type = 'case' and not exists (
       select 1 from evidence e where e.entity_id = f.id and lower(trim(e.source_id)) in (select lower(trim(source_id)) from sources))""")
def case_source_gaps(spark, d):
    """Cases none of whose evidence has a registered source."""
    known = table(spark, d, "sources").select(reference_key("source_id").alias("key")).where("key is not null").distinct()
    evidence = table(spark, d, "evidence").select(F.col("entity_id").alias("id"), reference_key("source_id").alias("key"))
    backed = lookup_join(evidence, known, ["key"], ["id"], "left_semi").select("id").distinct()
    return lookup_join(_flat(spark, d).where("entity_type = 'case'").select("id", "status", "last_checked"), backed, ["id"], ["id"], "left_anti")


@_query(f"""{_N} select entity_id, relation_type as type, count(*) as n_conflicts, max(coalesce(effective_on, '')) as latest from (
       select r.*, x.effective_on from resolved r join relations x using (relation_row)) where relation_type in ('distinguishes', 'exception_to', 'overrules') and resolved_id is not null group by 1, 2""")
def active_conflicts(spark, d):
    active = conflict_view(spark, d).where("status = 'active'").select("relation_row", "type")
    rows = table(spark, d, "relations").select("relation_row", "entity_id", F.coalesce("effective_on", F.lit("")).alias("on"))
    return active.join(rows, "relation_row").groupBy("entity_id", "type").agg(F.count(F.lit(1)).alias("n_conflicts"), F.max("on").alias("latest"))


# --- texts --------------------------------------------------------------------------


@_query(r"""select relation_row, array_to_string(list_transform(regexp_extract_all('[[' || entity_id || '|x]] and [[' || target_id || '#y]]', '\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]', 1), lambda x: trim(x)), ' ; ') as targets
       from relations where entity_id is not null and target_id is not null""")
def wiki_links(spark, d):
    """Targets of the links in a text made of a relation's ends."""
    linked = F.concat(F.lit("[["), "entity_id", F.lit("|x]] and [["), "target_id", F.lit("#y]]"))
    rows = table(spark, d, "relations").where("entity_id is not null and target_id is not null")
    return rows.select("relation_row", F.array_join(text.wiki_targets(F.array(linked)), " ; ").alias("targets"))


_FRAGMENT = r"""coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(heading), '[`*_~]', '', 'g'), '[^0-9a-z가-힣]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section')"""


@_query(f"select chunk_row, case when heading is not null then {_FRAGMENT} end as fragment from chunks")
def section_fragments(spark, d):
    return table(spark, d, "chunks").select("chunk_row", text.heading_fragment("heading").alias("fragment"))


@_query(f"""select chunk_row, {_FRAGMENT} as id, trim(regexp_replace(replace(replace(replace(replace(replace(heading, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;'), '<[^>]*>', '', 'g')) as label
       from chunks where heading is not null""")
def toc(spark, d):
    """Table of contents of the page that a section's heading makes."""
    html = F.concat(F.lit('<h1 id="top">x</h1><h2 class="s" id="'), text.heading_fragment("heading"), F.lit('">'), text.html_escape("heading"), F.lit("</h2>"))
    return table(spark, d, "chunks").where("heading is not null").select("chunk_row", F.inline(text.toc_entries(html)))


@_query()
def heading_ids(spark, d):
    """Fragments of the headings of each document, those in fenced blocks and the title left out."""
    found = table(spark, d, "documents").select("doc_id", F.posexplode(markup.heading_ids("text", F.coalesce("title", F.lit("")))).alias("pos", "fragment"))
    return found


@_query("""select relation_row, source, target from (select relation_row, trim(entity_id) as source, trim(target_id) as target from relations)
       where regexp_full_match(source, '[A-Za-z][\\w가-힣-]*') and regexp_full_match(target, '[A-Za-z][\\w가-힣-]*') and source <> target""")
def flowchart_edges(spark, d):
    """Edges of the flowcharts that relations make; charts that cannot be read give none."""
    chart = F.concat(F.lit("flowchart TD\n  "), "entity_id", F.lit(" -->|"), "relation_type", F.lit("| "), "target_id", F.lit("\n"))
    parsed = table(spark, d, "relations").select("relation_row", flowchart.flowchart_edges(chart).alias("c"))
    return parsed.select("relation_row", F.inline("c.edges")).select("relation_row", "source", "target")


@_query("""with recursive e as (select distinct entity_id as a, target_id as b from relations where relation_type = 'supersedes' and entity_id < target_id),
       walk(node, depth) as (select a, 0 from e where a not in (select b from e) union select e.b, w.depth + 1 from walk w join e on e.a = w.node)
       select node, max(depth) as depth from walk group by 1""")
def successor_layers(spark, d):
    """Longest chain of replacements above each record, over the relations that lead to a later id."""
    edges = table(spark, d, "relations").where("relation_type = 'supersedes' and entity_id < target_id").select(F.col("entity_id").alias("source"), F.col("target_id").alias("target"))
    return graph.layers(edges)


@_query("""select doc_id from documents where trim(coalesce(title, '')) <> '' and contains(lower(regexp_replace(text, '\\s', '', 'g')), lower(regexp_replace(title, '\\s', '', 'g')))""")
def title_mentions(spark, d):
    """Documents whose text has their title in it, blanks and case aside."""
    return resolve.needle_links(table(spark, d, "documents").select("doc_id", "title", "text"), ["title"], "text").select("doc_id")


# --- comparisons and rules --------------------------------------------------------------


@_query("""with p as (select source_row, source_id, location.path as path from sources where trim(coalesce(location.path, '')) <> ''),
       known as (select path, arg_max(source_id, source_row) as id from p where coalesce(source_id, '') <> '' group by 1)
       select path, coalesce(k.id, 'raw-' || left(sha256(path), 12)) as source_id, count(*) as n_rows from p left join known k using (path) group by all""")
def manifest_sources(spark, d):
    """Registered files with the id they have in a manifest."""
    located = table(spark, d, "sources").select("source_row", "source_id", F.col("location.path").alias("path")).where("trim(coalesce(path, '')) != ''")
    files = quality.manifest(located.select("path", F.lit("").alias("content")))
    named = quality.with_source_ids(files, located.select("path", "source_id", F.col("source_row").alias("ordinal")))
    return named.groupBy("path", "source_id").agg(F.count(F.lit(1)).alias("n_rows"))


@_query("""with h as (select id, arg_min(entity_type, entity_row) as path from entities where id is not null and registered_at < timestamp '2024-01-01 00:00:00' group by 1),
       n as (select id, min(entity_type) as path from entities where id is not null and deleted_at is null group by 1),
       a as (select distinct unnest(id_aliases) as id from entities where id is not null and registered_at < timestamp '2024-01-01 00:00:00')
       select coalesce(h.id, n.id) as id, case when h.id is null then 'missing' when n.id is null then 'removed' else 'path changed' end as verdict
       from h full join n on n.id = h.id where h.path is distinct from n.path and not (n.id is null and h.id in (select id from a where id is not null))""")
def registry_changes(spark, d):
    """What a registry of ids kept since early 2024 lacks and has too much, against the records that live."""
    entities = table(spark, d, "entities").where("id is not null")
    early = entities.where(F.col("registered_at") < F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    registry = early.groupBy("id").agg(F.min_by("entity_type", "entity_row").alias("path"), F.min_by("id_aliases", "entity_row").alias("aliases"))
    current = entities.where("deleted_at is null").select("id", F.col("entity_type").alias("path"))
    return quality.registry_drift(registry, current)


@_query(f"""{_L}, e as (select v.evidence_row, v.verified_on, {_date("v.verified_on")} as day, f.status, {_date("f.last_verified")} as last from evidence v left join flat f on f.id = v.entity_id)
       select 'high' as severity, 'EVIDENCE_VERIFIED_IN_FUTURE' as code, 'evidence/' || evidence_row as path, 'verified_on' as field, verified_on as message from e where day > date '{DAY}'
       union all select 'high', 'EVIDENCE_AFTER_LAST_VERIFIED', 'evidence/' || evidence_row, 'verified_on', verified_on from e where status = 'verified' and day > last
       union all select 'high', 'VERIFICATION_AFTER_CHECK', id, 'last_checked', last_checked from flat where status = 'verified' and {_date("last_verified")} > {_date("last_checked")}
       union all select 'medium', 'INGESTION_VERIFIED_EVIDENCE_MISSING', id, 'evidence', entity_type from flat f where status <> 'verified' and ingestion_status = 'verified'
         and entity_type in ('case', 'law', 'interpretation') and not exists (select 1 from evidence v where v.entity_id = f.id)""")
def verification_timeline(spark, d):
    return temporal.verification_timeline(_flat(spark, d), table(spark, d, "evidence"), DAY)


def _pages(spark, d) -> DataFrame:
    return table(spark, d, "chunks").select(F.col("entity_id").alias("page"), F.col("chunk_row").alias("part"), "title", F.col("content").alias("body"))


@_query()
def claim_rules(spark, d):
    """Issues of the claim marks in all sections and of the evidence that names claims."""
    named = table(spark, d, "evidence").select(F.col("entity_id").alias("page"), F.explode("supports").alias("claim_id"))
    return claims.claim_rules(_pages(spark, d), named)


@_query(r"""with l as (select chunk_row, unnest(string_split_regex(content, '\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]')) as line from chunks where content is not null)
       select chunk_row, count(*) as n_marks from l where regexp_matches(line, '(^|[\t-\r ])\^[^ \t-\r^]+[\t-\r ]*$') group by 1""")
def marks_per_section(spark, d):
    """Claim marks of each section, wherever they stand; there are no fenced blocks with marks."""
    return claims.marks(_pages(spark, d)).groupBy(F.col("part").alias("chunk_row")).agg(F.count(F.lit(1)).alias("n_marks"))


@_query("""with paths as (select distinct lower(regexp_replace(path, '\\.md$', '')) as p from chunks where path is not null),
       t as (select relation_row, 'wiki/pages/' || target_id || '.md' as target from relations where trim(coalesce(target_id, '')) <> '' and not contains(target_id, ';'))
       select 'high' as severity, 'LOG_ACTION_INVALID' as code, 'logs/events.md' as path, 'Action' as field, 'line ' || event_id || ': ' || upper(event_type) as message from events
       union all select 'low', 'LOG_TARGET_UNRESOLVED', 'logs/relations.md', 'Target', 'line ' || relation_row || ': ' || target from t
         where not exists (select 1 from chunks c where c.path is not null and lower(trim(target)) = 'wiki/pages/' || lower(regexp_extract(c.path, '([^/]*)$', 1)))""")
def log_rules(spark, d):
    """Issues of log lines made of events (actions) and relations (targets); pages have moved into folders by type."""
    done = table(spark, d, "events").select(F.lit("logs/events.md").alias("file"), F.col("event_id").alias("line_no"), F.concat(F.lit("Action: "), F.upper("event_type")).alias("text"))
    named = table(spark, d, "relations").where("trim(coalesce(target_id, '')) != '' and not contains(target_id, ';')").select(
        F.lit("logs/relations.md").alias("file"), F.col("relation_row").alias("line_no"), F.concat(F.lit("Target: wiki/pages/"), "target_id", F.lit(".md")).alias("text")
    )
    paths = table(spark, d, "chunks").select("path").where("path is not null").distinct()
    moved = paths.select(F.concat(F.lit("wiki/pages/"), F.regexp_extract("path", "([^/]*)$", 1)).alias("alias"), F.col("path").alias("target"))
    return checks.log_issues(readers.log_items(done.unionByName(named)), paths, moved)


def _html(spark, d) -> DataFrame:
    """A page per section: title, heading, a link to the next page's top and a picture."""
    lang = F.when(F.col("entity_type") == "case", "ko").otherwise("en")
    html = F.concat(
        F.lit('<html lang="'), lang, F.lit('"><h1>'), text.html_escape(F.coalesce("title", F.lit(""))), F.lit('</h1><h2 id="'),
        F.coalesce(text.heading_fragment("heading"), F.lit("section")), F.lit('">x</h2><a href="'), (F.col("chunk_row") + 1).cast("string"),
        F.lit('.html#section">next</a><img src="x.png"></html>'),
    )
    return table(spark, d, "chunks").select(F.concat(F.lit("pages/"), F.col("chunk_row").cast("string"), F.lit(".html")).alias("page"), html.alias("html"))


@_query("""select 'pages/' || chunk_row || '.html' as page, 'IMAGE_ALT' as code, '1' as detail from chunks
       union all select 'pages/' || chunk_row || '.html', 'LANG_MISSING', 'en' from chunks where entity_type is distinct from 'case'""")
def page_rules(spark, d):
    return checks.page_issues(_html(spark, d))


@_query(f"""with p as (select chunk_row, coalesce({_FRAGMENT}, 'section') as id from (select chunk_row, heading from chunks))
       select 'pages/' || a.chunk_row || '.html' as page, (a.chunk_row + 1) || '.html#section' as reference, case when b.id is null then 'BROKEN_REFERENCE' else 'BROKEN_FRAGMENT' end as code
         from p a left join p b on b.chunk_row = a.chunk_row + 1 where b.id is null or b.id <> 'section'
       union all select 'pages/' || chunk_row || '.html', 'x.png', 'BROKEN_REFERENCE' from p""")
def page_links(spark, d):
    parts = _html(spark, d).select("page", markup.page_parts("html").alias("p")).select("page", "p.refs", "p.ids")
    return checks.page_link_issues(parts)


# --- rewrites -------------------------------------------------------------------------------


@_query(f"""{_N}, {_LATEST.strip()}, t as (
       select r.entity_id, case when a.entity_type = 'case' and b.entity_type = 'rule' then 'supports' when a.entity_type = 'law' and b.entity_type = 'rule' then 'establishes'
           when a.entity_type = 'interpretation' and b.entity_type = 'rule' then 'interprets' when a.entity_type = 'fact_pattern' and b.entity_type = 'rule' then 'applies'
           when a.entity_type = 'rule' and b.entity_type = 'fact_pattern' then 'illustrated_by' else 'cites' end as relation_type, r.resolved_id as target_id, r.relation_row
       from resolved r left join latest a on a.id = r.entity_id join latest b on b.id = r.resolved_id where r.entity_id is not null and trim(coalesce(r.target_id, '')) <> '')
       select min(relation_row) as row, entity_id, relation_type, target_id from t group by 2, 3, 4""")
def typed_relations(spark, d):
    """What relations would be if only their ends were known: the type follows from the types of both records."""
    links = table(spark, d, "relations").select(F.col("relation_row").alias("row"), "entity_id", F.col("target_id").alias("target"))
    types = view.latest_records(table(spark, d, "entities").select("id", "entity_type", "exported_at", "entity_row"))
    return rewrite.typed_links(links, _names(spark, d), types)[0]


@_query(f"""{_N}, n as (select r.entity_id, case when r.relation_type in ('applies', 'cites', 'supports', 'amends') then r.relation_type else 'related_to' end as relation_type,
         coalesce(r.resolved_id, trim(r.target_id)) as target_id, coalesce(trim(r.note), '') as note,
         case when coalesce(trim(x.effective_on), '') not in ('', '9999-12-31', '1900-01-01') then trim(x.effective_on) end as effective_on, r.relation_row, r.resolved_id is not null as resolved
       from resolved r join relations x using (relation_row) where trim(coalesce(r.target_id, '')) <> '' and coalesce(r.relation_type, '') <> 'conflicts_with')
       select min(relation_row) as relation_row, entity_id, relation_type, target_id, note, effective_on, bool_or(resolved) as resolved from n group by 2, 3, 4, 5, 6""")
def nested_relations(spark, d):
    return rewrite.normalised_relations(table(spark, d, "relations"), _names(spark, d), ("applies", "cites", "supports", "amends"))


@_query(f"""{_N} select min(relation_row) as relation_row, entity_id, 'conflict:' || left(trim(regexp_replace(lower(entity_id || '-' || target_id), '[^a-z0-9-]+', '-', 'g'), '-'), 80) as conflict_id,
         'pending' as status, target_id, arg_min(coalesce(trim(note), ''), relation_row) as note from (
       select *, coalesce(resolved_id, trim(r.target_id)) as t from resolved r where relation_type = 'overrules' and trim(coalesce(r.target_id, '')) <> '') q(
         relation_row, entity_id, relation_type, ordinal, ref, note, n_matches, resolved_id, target_id) group by 2, 3, 5""")
def conflict_rewrite(spark, d):
    """Relations that overrule, as conflict records of their own."""
    return rewrite.stated_conflicts(table(spark, d, "relations"), _names(spark, d), relation="overrules")


@_query("""with e as (select evidence_row, entity_id, coalesce(trim(evidence_id), '') as id, source_id, locator,
         row_number() over (partition by entity_id order by evidence_row) - 1 as n from evidence where entity_id is not null),
       f as (select *, min(evidence_row) over (partition by entity_id, id) as first from e)
       select evidence_row, entity_id, case when id = '' then 'evidence:' || left(trim(regexp_replace(lower(entity_id || '-' || n), '[^a-z0-9-]+', '-', 'g'), '-'), 80) when evidence_row = first then id
         else rtrim(left(id, 78), '-') || '-' || left(sha256(entity_id || chr(0) || n || chr(0) || coalesce(source_id, 'None') || chr(0) || coalesce(locator, 'None')), 10) end as unique_id from f""")
def evidence_ids(spark, d):
    return rewrite.unique_evidence(table(spark, d, "evidence")).select("evidence_row", "entity_id", "unique_id")


@_query(f"""{_L}, r as (select f.id, f.entity_type, f.status, f.ingestion_status, {_date("f.last_verified")} as day,
         exists (select 1 from (select unnest(l.verification.verifier_ids) as v) where v in (select verifier_id from verifiers)) as who,
         len(list_filter(coalesce(l.verification.methods, []), lambda m: trim(m) in ('official_source_review', 'source_cross_check', 'citation_trace'))) > 0 as way,
         exists (select 1 from evidence e where e.entity_id = f.id) as what from flat f join latest l on l.id = f.id),
       s as (select *, (status = 'verified' or ingestion_status = 'verified') and not (day is not null and who and way and (entity_type not in ('case', 'law', 'interpretation') or what)) as down from r)
       select id, case when down or status not in ('draft', 'review', 'verified') then 'review' else status end as editorial_status,
         case when down or ingestion_status not in ('imported', 'extracted', 'linked', 'verified') then 'linked' else ingestion_status end as ingestion_status, down as downgraded from s""")
def verified_downgrades(spark, d):
    latest = view.latest_records(table(spark, d, "entities").select("id", "verification", "exported_at", "entity_row"))
    own = latest.select("id", "verification.verifier_ids", "verification.methods")
    records = lookup_join(_flat(spark, d).select("id", "entity_type", "status", "ingestion_status", "last_verified"), own, ["id"], ["id"])
    return rewrite.verified_states(records, table(spark, d, "evidence"), table(spark, d, "verifiers"), ("official_source_review", "source_cross_check", "citation_trace"))


_PEOPLE = {"렉소린": "lexorin", "위즈린트": "wagelint", "쿼럼킷": "quorumkit", "lexorin-bot": "lexorin"}


@_query()
def verification_plan(spark, d):
    """What adding structured verification would change, by outcome; names known exactly only."""
    known = tuple(sorted(set(_PEOPLE.values())))
    plan = rewrite.verification_plan(table(spark, d, "entities").select("entity_row", "verified_by", "verification"), _PEOPLE, known)
    return plan.groupBy("changed", "conflict", (F.size("unknown") > 0).alias("has_unknown")).agg(F.count(F.lit(1)).alias("n_records"))


# --- what must hold of results that SQL cannot compute -------------------------------------


@_query("select count(*) as n_texts, 0 as n_blank, 0 as n_numbers_off, 0 as n_repeated from documents where text is not null")
def chunks_sound(spark, d):
    """Search chunks of all documents: none blank, numbered without holes, ids unique."""
    documents = table(spark, d, "documents").where("text is not null")
    records = documents.select(F.col("doc_id").cast("string").alias("id"), "title", "entity_type", "text")
    made = search.section_chunks(records, "text")
    by = made.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.substring_index("chunk_id", "-", -1).cast("int")).alias("last"),
        F.count_if(F.trim("content") == "").alias("blank"), F.count_distinct("chunk_id").alias("ids"),
    )
    both = records.select(F.col("id").alias("entity_id")).join(by, "entity_id", "left")
    return both.agg(
        F.count(F.lit(1)).alias("n_texts"), F.coalesce(F.sum("blank"), F.lit(0)).alias("n_blank"),
        F.count_if(F.col("n") != F.col("last")).alias("n_numbers_off"), F.count_if(F.col("n") != F.col("ids")).alias("n_repeated"),
    )


@_query("select count(*) as n_texts, 0 as n_too_long, 0 as n_with_line_ends from documents where text is not null")
def summaries_sound(spark, d):
    found = summaries(spark, d)
    return found.agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if(F.length("summary") > 161).alias("n_too_long"),
        F.count_if(F.contains("summary", F.lit("\n"))).alias("n_with_line_ends"),
    )


@_query("select count(*) as n_records, 0 as n_changed, 0 as n_errors from entities")
def roundtrip_sound(spark, d):
    return frontmatter_roundtrip(spark, d).agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(~F.col("same")).alias("n_changed"), F.count_if(F.col("error") != "").alias("n_errors")
    )


@_query("select 0 as n_empty, 0 as n_numbers_off")
def sections_sound(spark, d):
    by = section_list(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"), F.count_if(F.col("n_chars") == 0).alias("empty"))
    return by.agg(F.coalesce(F.sum("empty"), F.lit(0)).alias("n_empty"), F.count_if(F.col("n") != F.col("last") + 1).alias("n_numbers_off"))
