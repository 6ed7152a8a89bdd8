"""SQL of the record queries."""

from __future__ import annotations

from ..functions.text import accents
from .problem_queries import _KEY, _TARGETS
from .reference_queries import _BASE, _LATEST, _NAMES, _NORM, _REQUIRED, DAY, EARLIER, _date

_L = f"with {_LATEST.strip()}"
_N = f"with {_NAMES.strip()}"
_T = f"with {_TARGETS.strip()}"
_OVERDUE = f"""coalesce(date_diff('day', {_date("last_checked")}, date '{DAY}') >
  case review_cycle when 'monthly' then 31 when 'quarterly' then 92 when 'annual' then 366 end, false)"""


def _as_of(day: str, start: str, end: str) -> str:
    return (
        f"{_date(start)} <= date '{day}' and ({end} is null or {end} in ('', '9999-12-31') or date '{day}' < {_date(end)})"
    )


def _tokens(x: str) -> str:
    a, b = accents()
    folded = rf"translate(regexp_replace(lower(coalesce({x}, '')), '\p{{Mn}}+', '', 'g'), '{a}', '{b}')"
    return rf"list_filter(string_split_regex({folded}, '[^\p{{L}}\p{{N}}\p{{Co}}]+'), lambda t: t <> '')"


_ENC = "url_encode({0})"
_CLAIM = f"'claim:' || {_ENC.format('entity_id')} || '#' || {_ENC.format('claim')}"
_REF = f"'evidence:' || {_ENC.format('entity_id')} || '#' || {_ENC.format('trim(evidence_id)')}"
_EDGE = f"""
claims as (select *, pos * 3 as p from (
  select *, unnest(cs) as claim, generate_subscripts(cs, 1) - 1 as pos from (
    select *, list_filter(list_transform(coalesce(supports, []), lambda x: trim(x)), lambda x: x <> '') as cs, {_KEY.format("source_id")} as key, {_REF} as ref from evidence))),
edge_rows as (
  select entity_id as source, relation_type as relation, coalesce(resolved_id, trim(target_id)) as target,
         'relations' as origin, note, cast(null as varchar) as evidence_ref, cast(null as varchar) as claim_ref, relation_row as r, 0 as p from resolved
  union all select entity_id, 'asserts', {_CLAIM}, 'evidence', null, ref, {_CLAIM}, evidence_row, p from claims
  union all select {_CLAIM}, 'supported_by', 'source:' || {_ENC.format('key')}, 'evidence', locator, ref, {_CLAIM}, evidence_row, p + 1 from claims where key <> ''
  union all select entity_id, 'supported_by', 'source:' || {_ENC.format('key')}, 'evidence', locator, ref, {_CLAIM}, evidence_row, p + 2 from claims where key <> ''
  union all select entity_id, 'supported_by', 'source:' || {_ENC.format('key')}, 'evidence', locator, ref, null, evidence_row, 0
    from (select *, {_KEY.format("source_id")} as key, {_REF} as ref from evidence where len(list_filter(coalesce(supports, []), lambda x: trim(x) <> '')) = 0) where key <> ''),
edge_keys as (select source, relation, target, count(*) as n_rows from edge_rows
              where coalesce(source, '') <> '' and coalesce(target, '') <> '' group by all)"""


def _joined(item: str) -> str:
    return f"""(select source, relation, target, string_agg(item, '|' order by o, item) as items from (
      select source, relation, target, {item} as item, min(struct_pack(r := r, p := p)) as o from edge_rows
      where trim(coalesce({item}, '')) <> '' and coalesce(source, '') <> '' and coalesce(target, '') <> '' group by all) group by all)"""


_EDGE_JOIN = "{0}.source = k.source and {0}.relation is not distinct from k.relation and {0}.target = k.target"
_LINK = "evidence_ref || '~' || coalesce(note, '') || '~' || coalesce(claim_ref, '')"
_EDGES = f"""
select 'edge-' || left(sha256(k.source || chr(0) || k.relation || chr(0) || k.target), 16) as id, k.source, k.relation, k.target, k.n_rows,
       coalesce(a.items, '') as origin, coalesce(b.items, '') as note, coalesce(c.items, '') as evidence_ref,
       coalesce(x.items, '') as claim_ref, coalesce(y.items, '') as evidence_links
from edge_keys k left join {_joined("origin")} a on {_EDGE_JOIN.format("a")}
left join {_joined("note")} b on {_EDGE_JOIN.format("b")} left join {_joined("evidence_ref")} c on {_EDGE_JOIN.format("c")}
left join {_joined("claim_ref")} x on {_EDGE_JOIN.format("x")} left join {_joined(_LINK)} y on {_EDGE_JOIN.format("y")}"""
_NODES = f"""
nodes as (
  select id, 'entity' as node_type, title, cast(null as varchar) as owner_id from flat
  union all select {_CLAIM}, 'claim', claim, entity_id from (select distinct entity_id, trim(claim) as claim from (select entity_id, unnest(supports) as claim from evidence) where trim(claim) <> '')
  union all select 'source:' || {_ENC.format('source_id')}, 'source', min(title), null from sources group by source_id)"""

_BM = f"""
tok as (
  select *, {_tokens("title")} as t1, {_tokens("heading")} as t2, {_tokens("content")} as t3 from chunks),
cnt as (
  select *, len(t1) + len(t2) + len(t3) as size,
    {", ".join(f"2 * len(list_filter(t1, lambda x: x = '{q}')) + len(list_filter(t2, lambda x: x = '{q}')) + len(list_filter(t3, lambda x: x = '{q}')) as f{k}" for k, q in enumerate(("야간근로수당", "별지", "standby")))}
  from tok),
stat as (select count(*) as n, avg(size) as mean, count(*) filter (f0 > 0) as n0, count(*) filter (f1 > 0) as n1, count(*) filter (f2 > 0) as n2 from cnt),
ranked as (
  select c.*, round(-({" + ".join(f"greatest(1e-6, ln((n - n{k} + 0.5) / (n{k} + 0.5))) * (f{k} * 2.2) / (f{k} + 1.2 * (1 - 0.75 + 0.75 * size / mean))" for k in range(3))}), 9) as rank
  from cnt c, stat where f0 + f1 + f2 > 0)"""

_MISSING = " union all ".join(
    f"select entity_row, id, '{n}' as field from entities where coalesce(trim({c}), '') = ''" for n, c in _REQUIRED.items()
)
_WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


_ISSUES = f"""
issues as (
  select 'critical' as severity, 'DUPLICATE_ID' as code, id as path, 'id' as field, cast(count(*) as varchar) as message from entities where id is not null group by id having count(*) > 1
  union all select 'high', 'TITLE_MISSING', 'entities/' || entity_row, 'title', 'no title' from entities where coalesce(trim(title), '') = ''
  union all select 'medium', 'DUPLICATE_LIST_VALUE', 'entities/' || entity_row, 'aliases', 'repeated alias' from entities
    where len(list_distinct(aliases)) + (case when list_contains(list_transform(aliases, lambda x: x is null), true) then 1 else 0 end) < len(aliases)
  union all select 'critical', 'BROKEN_REFERENCE', 'relations/' || relation_row, 'target_id', target_id from resolved where n_matches = 0 and trim(coalesce(target_id, '')) <> ''
  union all select 'high', 'TEMPORAL_ORDER', 'chunks/' || chunk_row, 'period', valid_from || ' > ' || valid_until from chunks where {_date("valid_from")} > {_date("valid_until")}
  union all select 'high', 'TEMPORAL_ORDER', 'temporal/' || temporal_row, 'period', applicable_from || ' > ' || applicable_to from temporal where {_date("applicable_from")} > {_date("applicable_to")}
  union all select 'high', 'EVIDENCE_LOCATOR', 'evidence/' || evidence_row, 'locator', 'no locator' from evidence where coalesce(trim(locator), '') = '')"""

_QA = f"""
asked as (
  select qa_row, 'required_authority_ids' as field, unnest(required_authority_ids) as ref_id, generate_subscripts(required_authority_ids, 1) - 1 as pos from qa_regression
  union all select qa_row, 'required_rule_ids', unnest(required_rule_ids), generate_subscripts(required_rule_ids, 1) - 1 from qa_regression),
qa_refs as (
  select a.*, n.entity_id, l.entity_type from asked a left join names n on n.key = coalesce({_KEY.format("ref_id")}, '')
  left join latest l on l.id = n.entity_id)"""


def _state(day: str) -> str:
    return f"""(select chunk_id, sha256(coalesce(content, '')) as sha from (
      select *, row_number() over (partition by chunk_id order by indexed_at desc nulls last, chunk_row desc) as rn
      from chunks where indexed_at < timestamp '{day} 00:00:00') where rn = 1)"""


def _digest(where: str = "") -> str:
    return f"""(
  select relation_type, sum(n) as n_keys, sha256(string_agg(d, chr(10) order by b)) as digest from (
    select relation_type, left(h, 4) as b, count(*) as n, sha256(string_agg(h, chr(10) order by h)) as d from (
      select distinct relation_type, sha256(coalesce(entity_id, '') || chr(9) || coalesce(relation_type, '') || chr(9) || coalesce(target_id, '')) as h from relations {where})
    group by 1, 2) group by 1)"""


def _first(wanted: str) -> str:
    return f"""(select source, arg_min(target, (pr, ord, target)) as target from (
    select e.*, case relation when 'applies' then 1 when 'implements' then 2 when 'cites' then 3 else 4 end as pr
    from (select entity_id as source, relation_type as relation, resolved_id as target, relation_row as ord from resolved where resolved_id is not null) e
    where source <> target and target in (select id from flat where entity_type = '{wanted}')) group by source)"""


def _hay(x: str) -> str:
    return f"'  ' || array_to_string({_tokens(x)}, '  ') || '  '"


def _e(c: str) -> str:
    return f"coalesce(trim({c}), '') = ''"


def _bad(c: str) -> str:
    return f"coalesce(trim({c}), '') <> '' and {_date(c)} is null"


def _none(c: str) -> str:
    return f"coalesce(len({c}), 0) = 0"


def _some(c: str) -> str:
    return f"coalesce(len(list_filter({c}, lambda x: trim(x) <> '')) > 0, false)"


_ODD_IDS = "list_filter(verification.verifier_ids, lambda v: trim(v) <> '' and not regexp_full_match(v, '[a-z][a-z0-9-]{0,63}'))"


def _blank(c: str) -> str:
    return f"len(list_filter({c}, lambda x: x is null or trim(x) = '')) > 0"


def _rep(c: str) -> str:
    some_null = f"(case when list_count({c}) < len({c}) then 1 else 0 end)"
    return f"len(list_distinct({c})) + {some_null} < len({c})"


def _rows(name: str, row: str, rules: list[tuple[str, str, str, str, str]]) -> str:
    """Union of row rules: severity, code, field, condition, message expression."""
    return " union all ".join(
        f"select '{s}' as severity, '{c}' as code, '{name}/' || {row} as path, '{f}' as field, coalesce(cast({m} as varchar), '') as message from {t} where {w}"
        for s, c, f, w, m, t in ((*r, {"qa": "qa_regression"}.get(name, name)) for r in rules)
    )


def _lost(name: str, row: str, column: str, keys: str, severity: str, code: str) -> str:
    return f"""select '{severity}', '{code}', '{name}/' || {row}, '{column}', {column} from {name}
      where coalesce({_KEY.format(column)}, '') <> '' and {_KEY.format(column)} not in ({keys})"""


def _again(table: str, name: str, row: str, keys: str, field: str, severity: str, code: str, where: str = "true") -> str:
    return f"""select '{severity}', '{code}', '{name}/' || {row}, '{field}', coalesce(cast({field} as varchar), '') from (
      select *, rank() over (partition by {keys} order by {row}) as place from {table} where {where}) where place > 1"""


def _vocab(name: str, row: str, column: str, field: str, severity: str, code: str) -> str:
    return f"""select '{severity}', '{code}', '{name}/' || {row}, '{column}', {column} from {name}
      where trim(coalesce({column}, '')) <> '' and {column} not in (select code from vocab where field = '{field}')"""


_IDS = ("required_authority_ids", "required_rule_ids")
_P, _U = "coalesce(trim(location.path), '')", "coalesce(trim(location.url), '')"
_FAMILIES = {
    "evidence_rules": " union all ".join([
        _rows("evidence", "evidence_row", [
            ("high", "EVIDENCE_ID", "evidence_id", _e("evidence_id"), "'no id'"),
            ("high", "EVIDENCE_SOURCE", "source_id", _e("source_id"), "'no source'"),
            ("high", "EVIDENCE_LOCATOR", "locator", _e("locator"), "'no locator'"),
            ("high", "EVIDENCE_SUPPORTS", "supports", f"({_none('supports')} or {_blank('supports')})", "'no claim'"),
            ("high", "EVIDENCE_SUPPORTS_DUPLICATE", "supports", _rep("supports"), "'repeated claim'"),
            ("high", "DATE_INVALID", "verified_on", _bad("verified_on"), "verified_on"),
        ]),
        _lost("evidence", "evidence_row", "source_id", f"select {_KEY.format('source_id')} from sources where source_id is not null", "high", "EVIDENCE_SOURCE_UNKNOWN"),
        _again("evidence", "evidence", "evidence_row", "entity_id, evidence_id", "evidence_id", "high", "EVIDENCE_ID_DUPLICATE", "trim(coalesce(evidence_id, '')) <> ''"),
    ]),
    "relation_rules": f"with {_TARGETS.strip()} " + " union all ".join([
        _rows("relations", "relation_row", [
            ("high", "RELATION_TARGET", "target_id", _e("target_id"), "'no target'"),
            ("high", "DATE_INVALID", "effective_on", _bad("effective_on"), "effective_on"),
        ]),
        _again("relations", "relations", "relation_row", f"entity_id, relation_type, {_KEY.format('target_id')}", "target_id", "medium", "RELATION_DUPLICATE", f"{_KEY.format('target_id')} <> ''"),
        _lost("relations", "relation_row", "target_id", "select key from names", "critical", "RELATION_TARGET_BROKEN"),
        _vocab("relations", "relation_row", "relation_type", "relation_type", "high", "VOCAB_RELATION"),
    ]),
    "source_rules": " union all ".join([
        _rows("sources", "source_row", [
            ("high", "SOURCE_ID_FORMAT", "source_id", "not coalesce(regexp_full_match(source_id, '[a-z0-9][a-z0-9-]*'), false)", "source_id"),
            *[("high", "SOURCE_FIELD", f, _e(f), "'no value'") for f in ("title", "publisher", "source_type", "jurisdiction")],
            ("high", "SOURCE_AUTHORITY_LEVEL", "authority_level", "coalesce(authority_level not between 1 and 7, true)", "authority_level"),
            ("high", "SOURCE_LOCATION", "location", f"({_P} <> '') = ({_U} <> '')", "'exactly one of path and url'"),
            ("critical", "SOURCE_PATH_ESCAPE", "location", f"(regexp_matches({_P}, '(^|/)\\.\\.(/|$)') or starts_with({_P}, '/'))", _P),
            ("high", "SOURCE_URL_INVALID", "location", f"{_U} <> '' and not regexp_matches({_U}, '^https?://[^/\\s]+')", _U),
        ]),
        _vocab("sources", "source_row", "source_type", "source_type", "high", "SOURCE_TYPE"),
        _again("sources", "sources", "source_row", "source_id", "source_id", "critical", "SOURCE_ID_DUPLICATE"),
        f"""select 'critical', 'SOURCE_PATH_DUPLICATE', 'sources/' || source_row, 'location', {_P} from sources where {_P} in (
          select {_P} from sources where {_P} <> '' group by 1 having count(distinct source_id) > 1)""",
    ]),
    "qa_rules": f"with {_TARGETS.strip()}, types as (select id, max(entity_type) as entity_type from entities group by 1), each as ("
        + " union all ".join(f"select qa_row, '{f}' as field, unnest({f}) as ref from qa_regression" for f in _IDS)
        + f"""), found as (select e.*, t.entity_type, case when t.entity_type is null and field = '{_IDS[0]}' then 'QA_UNKNOWN_AUTHORITY_ID'
             when t.entity_type is null then 'QA_UNKNOWN_RULE_ID' when field = '{_IDS[1]}' and t.entity_type <> 'rule' then 'QA_REQUIRED_ID_NOT_RULE' end as code
           from each e left join names n on n.key = {_KEY.format("e.ref")} left join types t on t.id = n.entity_id where coalesce({_KEY.format("e.ref")}, '') <> '') """
        + " union all ".join([
            _rows("qa", "qa_row", [
                ("high", "QA_ID", "id", _e("id"), "'no id'"), ("high", "QA_AS_OF", "as_of", f"{_date('as_of')} is null", "as_of"),
                *[("high", "QA_TEXT", f, _e(f), "'no text'") for f in ("question", "expected")],
                *[("high", "QA_ID_LIST", f, f"({f} is null or {_blank(f)})", "'no list of ids'") for f in _IDS],
                ("high", "QA_FORBIDDEN_CLAIMS", "forbidden_claims", f"(forbidden_claims is null or {_blank('forbidden_claims')})", "'no list of texts'"),
            ]),
            "select case when starts_with(code, 'QA_UNKNOWN') then 'critical' else 'high' end, code, 'qa/' || qa_row, field, ref from found where code is not null",
            _again("qa_regression", "qa", "qa_row", "id", "id", "high", "QA_ID_DUPLICATE", "trim(coalesce(id, '')) <> ''"),
        ]),
    "identity_rules": """with ids as (select distinct id from entities where trim(coalesce(id, '')) <> ''),
       own as (select distinct alias, owner from (select unnest(id_aliases) as alias, id as owner from entities) where trim(coalesce(alias, '')) <> ''),
       listed as (select distinct alias_id as alias, canonical_id as owner from id_aliases where trim(coalesce(alias_id, '')) <> ''),
       claims as (select * from own where owner is not null union select * from listed where owner is not null) """
        + " union all ".join([
            _rows("entities", "entity_row", [
                ("critical", "ID_MISSING", "id", _e("id"), "'no id'"),
                ("critical", "ID_INVALID", "id", "regexp_matches(id, '\\s|^(claim|evidence|source|conflict):')", "id"),
                ("high", "TITLE_MISSING", "title", _e("title"), "'no title'"),
                ("medium", "DUPLICATE_LIST_VALUE", "aliases", _rep("aliases"), "'repeated alias'"),
                ("high", "FIELD_TYPE", "aliases", _blank("aliases"), "'blank alias'"),
            ]),
            "select 'critical', 'DUPLICATE_ID', id, 'id', count(*) || ' rows' from entities where trim(coalesce(id, '')) <> '' group by id having count(*) > 1",
            "select 'critical', 'ID_ALIAS_COLLISION', alias, 'id_aliases', count(*) || ' records' from claims group by alias having count(*) > 1",
            "select 'critical', 'ID_ALIAS_IS_ID', alias, 'id_aliases', owner from claims where alias in (select id from ids) and alias <> owner",
            "select 'critical', 'ID_ALIAS_CANONICAL_BROKEN', alias, 'canonical_id', coalesce(owner, '') from listed where owner is null or owner not in (select id from ids)",
            "select 'high', 'ID_ALIAS_MAP_DRIFT', alias, 'id_aliases', coalesce(owner, '') from own o where not exists (select 1 from listed l where l.alias = o.alias and l.owner = o.owner)",
        ]),
    "temporal_rules": " union all ".join([
        _rows("chunks", "chunk_row", [
            ("high", "DATE_REQUIRED", "valid_from", _e("valid_from"), "'no start'"),
            ("high", "DATE_INVALID", "valid_from", _bad("valid_from"), "valid_from"),
            ("high", "DATE_INVALID", "valid_until", _bad("valid_until"), "valid_until"),
            ("high", "TEMPORAL_ORDER", "valid_until", f"{_date('valid_from')} > {_date('valid_until')}", "valid_from || ' > ' || valid_until"),
        ]),
        _rows("temporal", "temporal_row", [
            ("high", "RULE_TEMPORAL_DATE", "applicable_from", f"{_date('applicable_from')} is null", "applicable_from"),
            ("high", "RULE_TEMPORAL_DATE", "applicable_to", _bad("applicable_to"), "applicable_to"),
            ("high", "RULE_TEMPORAL_ORDER", "applicable_to", f"{_date('applicable_from')} > {_date('applicable_to')}", "applicable_from || ' > ' || applicable_to"),
            ("high", "RULE_TEMPORAL_VERSION", "rule_version", "not coalesce(regexp_full_match(rule_version, '\\d+(\\.\\d+)*'), false)", "rule_version"),
        ]),
    ]),
    "verification_rules": " union all ".join([
        _rows("entities", "entity_row", [
            ("medium", "VERIFIER_ID_DUPLICATE", "verifier_ids", _rep("verification.verifier_ids"), "'repeated verifier'"),
            ("medium", "VERIFICATION_METHOD_DUPLICATE", "methods", _rep("verification.methods"), "'repeated method'"),
            ("high", "VERIFIER_IDS_TYPE", "verifier_ids", _blank("verification.verifier_ids"), "'blank verifier'"),
            ("high", "VERIFICATION_METHODS_TYPE", "methods", _blank("verification.methods"), "'blank method'"),
            ("high", "VERIFICATION_DATE_INVALID", "verified_on", _bad("verification.verified_on"), "verification.verified_on"),
            ("high", "VERIFIER_ID_INVALID", "verifier_ids", f"len({_ODD_IDS}) > 0", f"array_to_string({_ODD_IDS}, ', ')"),
            ("high", "VERIFICATION_VERIFIER_MISSING", "verifier_ids", f"(not ({_e('verification.verified_on')}) and {_none('verification.verifier_ids')}) or "
             f"(({_some('verification.methods')} or not ({_e('verification.note')})) and not {_some('verification.verifier_ids')})", "'no verifier'"),
            ("high", "VERIFICATION_METHOD_MISSING", "methods", f"(not ({_e('verification.verified_on')}) and {_none('verification.methods')}) or "
             f"({_some('verification.verifier_ids')} and not {_some('verification.methods')})", "'no method'"),
            ("high", "VERIFICATION_NOTE_MISSING", "note", f"coalesce(list_contains(verification.methods, 'source_cross_check'), false) and {_e('verification.note')}", "'a cross check without a note'"),
        ]),
        """select 'high', 'VERIFIER_UNKNOWN', 'entities/' || entity_row, 'verifier_ids', value from (select entity_row, unnest(verification.verifier_ids) as value from entities)
           where trim(coalesce(value, '')) <> '' and value not in (select verifier_id from verifiers)""",
        """select 'high', 'VERIFICATION_METHOD_INVALID', 'entities/' || entity_row, 'methods', value from (select entity_row, unnest(verification.methods) as value from entities)
           where trim(coalesce(value, '')) <> '' and value not in (select code from vocab where field = 'verification_method')""",
    ]),
}

SQL = {
    **_FAMILIES,
    "rule_summary": "select severity, code, count(*) as n_issues from ("
    + " union all ".join(f"select * from ({sql})" for sql in _FAMILIES.values())
    + ") group by 1, 2",
    "source_locations": f"select source_row, case when {_P} <> '' then 'path' when {_U} <> '' then 'url' end as kind, case when {_P} <> '' then {_P} when {_U} <> '' then {_U} end as value from sources",
    "match_language": f"""with h as (select {_hay("title")} as a, {_hay("heading")} as b, {_hay("content")} as c from chunks),
       t as (select *, a || '|' || b || '|' || c as x from h)
       select count(*) filter (contains(x, ' 야간근로수당 ') and contains(x, ' 별지 ')) as "and",
         count(*) filter (contains(x, ' 별지 ') and not contains(x, ' 통신보조비 ')) as "not",
         count(*) filter (contains(x, ' 지급  내역은 ')) as phrase, count(*) filter (contains(x, ' 야간')) as prefix,
         count(*) filter (contains(b, ' 근거자료 ')) as field,
         count(*) filter (regexp_matches(x, ' 내역은 ( [^ |]+ ){{0,4}} 표와 | 표와 ( [^ |]+ ){{0,4}} 내역은 ')) as near,
         count(*) filter ((contains(x, ' standby ') or contains(x, ' meal ')) and contains(x, ' employer ')) as "group",
         count(*) filter (contains(x, ' 별지 ') and contains(x, ' 표와 ') and not (contains(x, ' 통신보조비 ') and contains(x, ' 내역은 '))) as not_of_both,
         count(*) filter (contains(x, ' 별지 ') and contains(x, ' 표와 ') and not contains(x, ' 통신보조비 ')) as not_and,
         count(*) filter (contains(x, ' 별지 ') and not contains(x, ' 통신보조비 ') and not contains(x, ' 내역은 ') or contains(x, ' standby ')) as nots,
         count(*) filter (contains(a, ' 근거자료 ') or contains(b, ' 근거자료 ')) as fields,
         count(*) filter (contains(a, ' 근거자료 ') or contains(b, ' 근거자료 ')) as outside,
         count(*) filter (starts_with(b, '  근거자료 ')) as start, count(*) filter (contains(x, ' 지급  내역은 ')) as joined from t""",
    "record_slugs": rf"""{_L} select id, case when s <> '' then s || '-' else '' end || left(sha256(id), 8) as slug,
       replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') as safe_title
       from (select id, title, regexp_replace(left(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), 48), '^-+|-+$', '', 'g') as s from flat)""",
    "record_search_text": f"""{_L}, parts as (select f.id, list_filter([trim(f.id), f.title, trim(f.entity_type), f.status, f.legal_status,
         trim(array_to_string(list_transform(list_filter(coalesce(l.aliases, []), lambda x: x is not null and trim(x) <> ''), lambda x: trim(x)), ' '))],
         lambda x: x is not null and x <> '') as p, l.aliases from flat f join latest l on l.id = f.id)
       select id, array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), ' ') as search_text from parts where id is not null""",
    "claim_plan": r"""with marks as (select entity_id, regexp_extract(line, '(?:^|[\t-\r ])\^([a-z][a-z0-9-]{0,63})[\t-\r ]*$', 1) as claim_id from (
         select entity_id, unnest(string_split_regex(content, '\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]')) as line from chunks where content is not null)),
       single as (select entity_id, claim_id from marks where claim_id <> '' group by 1, 2 having count(*) = 1),
       claims as (select entity_id, claim_id, count(distinct evidence_id) as n_evidence from (
         select entity_id, evidence_id, unnest(supports) as claim_id from evidence) where trim(claim_id) <> '' group by 1, 2)
       select c.entity_id, c.claim_id, c.n_evidence, s.claim_id is not null as resolved from claims c left join single s using (entity_id, claim_id)""",
    "flat_view": f"""{_L} select entity_row, id, entity_type, title, status, ingestion_status, last_updated, review_cycle, last_checked,
       legal_status, effective_from, effective_to, superseded_by, last_verified, authority_level from flat""",
    "status_facets": f"{_L} select entity_type, status, legal_status, count(*) as n_rows from flat group by all",
    "facet_grouping_sets": f"""{_L} select entity_type, status, legal_status, grouping(entity_type, status, legal_status) as level, count(*) as n_rows
       from flat group by grouping sets ((entity_type), (status), (legal_status), ())""",
    "facet_table": _L
    + " union all ".join(
        f" select '{f}' as facet, coalesce(nullif(trim({f}), ''), '(none)') as value, count(*) as n_rows from flat group by 2"
        for f in ("entity_type", "status", "legal_status", "review_cycle")
    ),
    "verified_current": f"""{_L} select id, title, effective_from, effective_to from flat
       where status = 'verified' and legal_status = 'current' and {_as_of(DAY, "effective_from", "effective_to")}""",
    "review_queue": f"{_L} select id, status, review_cycle, last_checked, {_OVERDUE} as overdue from flat where status in ('draft', 'review') or {_OVERDUE}",
    "future_records": f"{_L} select id, effective_from from flat where {_date('effective_from')} > date '{DAY}'",
    "ingestion_queue": f"{_L} select id, ingestion_status, last_updated from flat where ingestion_status <> 'verified'",
    "infer_legal_status": f"""{_L} select id, legal_status, case when legal_status = 'overruled' then 'overruled' when superseded_by <> '' then 'superseded'
       when {_date("effective_from")} > date '{DAY}' then 'future' when {_date("effective_to")} < date '{DAY}' then 'historical' else 'current' end as inferred from flat""",
    "recent_records": f"{_L} select id, last_updated, title from flat order by last_updated desc, title, id limit 20",
    "type_numbering": f"""{_L}, numbered as (select id, entity_type, row_number() over (partition by entity_type order by lower(title), id) as number from flat)
       select id, entity_type, number, upper(left(entity_type, 2)) || '-' || lpad(cast(number as varchar), 4, '0') as label from numbered""",
    "paginate": f"{_L} select id, title from flat order by title, id limit 10 offset 20",
    "resolve_references": f"{_N} select relation_row, target_id, n_matches, resolved_id from resolved",
    "broken_references": f"{_N} select relation_row, target_id from resolved where n_matches = 0 and trim(coalesce(target_id, '')) <> ''",
    "ambiguous_references": f"""{_N}, o as (select *, {_NORM.format("coalesce(ref, '')")} as key from (select entity_row, unnest(aliases) as ref from entities))
       select 'entities' as table_name, o.entity_row as row, o.ref, coalesce(f.n_matches, b.n_matches) as n_matches from o left join counts f on f.key = o.key
         left join counts b on b.key = {_NORM.format(_BASE.format("o.key"))} where coalesce(f.n_matches, b.n_matches) > 1
       union all select 'relations', relation_row, target_id, n_matches from resolved where n_matches > 1""",
    "qa_reference_resolution": f"{_T}, {_LATEST.strip()}, {_QA.strip()} select qa_row, field, pos, ref_id, entity_id, entity_type from qa_refs",
    "type_mismatch_references": f"""{_T.replace("names as", "targets as")}, {_LATEST.strip()}, {_QA.strip().replace("names ", "targets ").replace("asked", "qa_asked")}, {_NAMES.strip()}
       select 'qa_regression' as table_name, qa_row as row, field, pos, entity_id, entity_type from qa_refs
         where case when field = 'required_rule_ids' then entity_type <> 'rule' else entity_type not in ('law', 'case', 'interpretation', 'guide') end
       union all select 'relations', r.relation_row, r.relation_type, 0, r.resolved_id, f.entity_type from resolved r join flat f on f.id = r.resolved_id
         where case r.relation_type when 'illustrated_by' then f.entity_type <> 'fact_pattern' when 'overrules' then f.entity_type <> 'case'
           when 'amends' then f.entity_type <> 'law' when 'interprets' then f.entity_type not in ('rule', 'law') end""",
    "duplicate_ids": "select id, count(*) as n_rows from entities group by id having count(*) > 1",
    "duplicate_relations": f"""select relation_row, entity_id, relation_type, target_id from (
       select *, rank() over (partition by entity_id, relation_type, {_KEY.format("target_id")} order by relation_row) as place from relations) where place > 1""",
    "orphan_entities": f"""{_L}, {_NAMES.strip()} select id, title, entity_type, exists (select 1 from resolved r where r.resolved_id = f.id) as is_target
       from flat f where not exists (select 1 from relations r where r.entity_id = f.id)""",
    "vocab_violations": """select v.field, v.value, count(*) as n_rows from (
       select 'entity_type' as field, entity_type as value from entities union all select 'status', workflow.editorial_status from entities
       union all select 'legal_status', legal.status from entities union all select 'review_cycle', workflow.review.cycle from entities
       union all select 'relation_type', relation_type from relations union all select 'legal_status', legal_status from chunks
       union all select 'verification_method', unnest(verification.methods) from entities) v
       where v.value is not null and not exists (select 1 from vocab w where w.field = v.field and w.code = v.value) group by 1, 2""",
    "missing_fields": _MISSING,
    "alias_closure": """with recursive links as (select alias_id as alias, min(canonical_id) as target from id_aliases
         where trim(alias_id) <> '' and canonical_id is not null group by 1),
       walk as (select alias, target, cast(1 as bigint) as depth from links
         union all select w.alias, l.target, w.depth + 1 from walk w join links l on l.alias = w.target where w.depth < 16)
       select alias, arg_max(target, depth) as target, max(depth) as depth, max(depth) >= 16 as is_cycle from walk group by 1""",
    "alias_parity": """with own as (select distinct alias from (select unnest(id_aliases) as alias from entities) where trim(alias) <> ''),
       listed as (select distinct alias_id as alias from id_aliases where alias_id is not null)
       select alias, 'table' as missing_in from own where alias not in (select alias from listed)
       union all select alias, 'records' from listed where alias not in (select alias from own)""",
    "asof_effective": f"select chunk_row, entity_id, valid_from, valid_until from chunks where {_as_of('2020-06-30', 'valid_from', 'valid_until')}",
    "temporal_order_check": f"""select 'chunks' as table_name, chunk_row as row, valid_from as a, valid_until as b from chunks where {_date("valid_from")} > {_date("valid_until")}
       union all select 'temporal', temporal_row, applicable_from, applicable_to from temporal where {_date("applicable_from")} > {_date("applicable_to")}""",
    "review_deadlines": f"{_L} select review_cycle, count(*) as n_rows, count(*) filter ({_OVERDUE}) as n_overdue from flat group by 1",
    "supersession_check": f"""{_T.replace("names as", "targets as")}, {_LATEST.strip()}, {_NAMES.strip()},
       newer as (select coalesce(resolved_id, target_id) as id, min(entity_id) as successor from resolved where relation_type = 'supersedes' group by 1),
       r as (select f.id, f.legal_status, f.effective_from, f.effective_to, coalesce(nullif(f.superseded_by, ''), n.successor, '') as by_id,
               coalesce(nullif(coalesce(trim(l.legal.superseded_on), ''), ''), case when coalesce(nullif(f.superseded_by, ''), n.successor, '') <> '' then f.last_updated end, '') as on_day
             from flat f join latest l on l.id = f.id left join newer n on n.id = f.id)
       select 'critical' as severity, case when t.entity_id is null and {_KEY.format("r.by_id")} <> {_KEY.format("r.id")} then 'SUPERSESSION_TARGET_BROKEN' else 'SUPERSESSION_SELF_REFERENCE' end as code,
              r.id as path, 'superseded_by' as field, r.by_id as message
         from r left join targets t on t.key = {_KEY.format("r.by_id")} where r.by_id <> '' and (t.entity_id is null or t.entity_id = r.id or {_KEY.format("r.by_id")} = {_KEY.format("r.id")})
       union all select 'high', 'SUPERSESSION_DATE_ORDER', id, 'superseded_date', on_day from r where {_date("on_day")} < {_date("effective_from")}
       union all select 'medium', 'SUPERSESSION_OPEN_ENDED', id, 'effective_to', legal_status from r where legal_status in ('superseded', 'overruled') and effective_to = '9999-12-31'""",
    "graph_nodes": f"{_L}, {_NODES.strip()} select * from nodes",
    "graph_edges": f"{_N}, {_EDGE.strip()} {_EDGES}",
    "graph_integrity": f"""{_N}, {_EDGE.strip()}, {_LATEST.strip()}, {_NODES.strip()},
       e as (select 'edge-' || left(sha256(source || chr(0) || relation || chr(0) || target), 16) as id, * from edge_keys)
       select 'critical' as severity, 'GRAPH_NODE_ID_MISSING' as code, coalesce(node_type, '') as path, 'id' as field, 'node without id' as message from nodes where coalesce(id, '') = ''
       union all select 'critical', 'GRAPH_NODE_ID_DUPLICATE', id, 'id', count(*) || ' nodes' from nodes where coalesce(id, '') <> '' group by id having count(*) > 1
       union all select 'critical', 'GRAPH_EDGE_RELATION_MISSING', id, 'relation', 'edge without relation' from e where coalesce(relation, '') = ''
       union all select 'critical', 'GRAPH_EDGE_ENDPOINT_MISSING', id, 'endpoint', source from e where not exists (select 1 from nodes n where n.id = source)
       union all select 'critical', 'GRAPH_EDGE_ENDPOINT_MISSING', id, 'endpoint', target from e where not exists (select 1 from nodes n where n.id = target)""",
    "related_entities": f"""{_N}, e as (select distinct entity_id as source, relation_type as relation, coalesce(resolved_id, trim(target_id)) as target from resolved),
       both_ways as (select source as entity_id, target as other_id, relation from e where coalesce(source, '') <> '' and coalesce(target, '') <> ''
         union select target, source, relation from e where coalesce(source, '') <> '' and coalesce(target, '') <> ''),
       g as (select entity_id, other_id, list(distinct relation) as r from both_ways where entity_id <> other_id group by 1, 2)
       select entity_id, other_id, array_to_string(list_sort(case when len(r) > 1 then list_filter(r, lambda x: x <> 'related_to') else r end), '|') as relations from g""",
    "decision_path": f"""{_N}, {_LATEST.strip()} select r.source as fact_id, r.target as rule_id, l.target as law_id
       from {_first("rule")} r join {_first("law")} l on l.source = r.target where r.source in (select id from flat where entity_type = 'fact_pattern')""",
    "order_path": """select r_name, n_name, count(*) as n_orders from orders join customer on o_custkey = c_custkey
       join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""",
    "evidence_supports": """with c as (select entity_id, claim, min((evidence_row, pos)) as o from (
         select entity_id, evidence_row, unnest(supports) as claim, generate_subscripts(supports, 1) as pos from evidence) where trim(claim) <> '' group by 1, 2)
       select entity_id, string_agg(claim, '|' order by o) as claims, count(*) as n_claims from c group by 1""",
    "heading_sections": r"""with p as (select doc_id, string_split(regexp_replace(text, '(^|\n)(#{1,6} )', '\1' || chr(1) || '\2', 'g'), chr(1)) as parts from documents where text is not null),
       q as (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) - 1 as section_no from p)
       select doc_id, section_no, regexp_extract(part, '^#{1,6} ([^\r\n]*)', 1) as heading, length(part) as n_chars from q where trim(part) <> ''""",
    "heading_anchors": r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents where text is not null),
       w as (select doc_id, pos, regexp_replace(regexp_replace(lower(regexp_replace(line, '^#{1,6} +', '')), '[^0-9a-z가-힣]+', '-', 'g'), '^-+|-+$', '', 'g') as words
         from l where regexp_matches(line, '^#{1,6} +[^ \r]'))
       select doc_id, pos, case when words = '' then 'section' else words end as anchor from w""",
    "term_postings": f"""with p as (select chunk_row, field, unnest(t) as term from (
         select chunk_row, 'title' as field, {_tokens("title")} as t from chunks union all select chunk_row, 'heading', {_tokens("heading")} from chunks
         union all select chunk_row, 'content', {_tokens("content")} from chunks))
       select term, field, count(distinct chunk_row) as n_rows, count(*) as tf from p group by 1, 2""",
    "bm25_topk": f"with {_BM.strip()} select chunk_row, rank from ranked order by rank, chunk_row limit 50",
    "search_filtered": f"""with {_BM.strip()} select chunk_row, entity_id, rank from ranked where status in ('verified', 'review') and legal_status = 'current'
       and {_as_of(DAY, "valid_from", "valid_until")} order by rank, chunk_row limit 20""",
    "recent_documents": "select doc_id, title, collected_at from documents order by collected_at desc nulls last, doc_id limit 4",
    "source_labels": r"""select source_row, source_id, case when p <> '' then 'path' when u <> '' then 'url' else '' end as location_kind,
       case when p <> '' then p else u end as location_value, regexp_extract(case when p <> '' then p else u end, '^https?://([^/]+)', 1) as host
       from (select *, coalesce(trim(location.path), '') as p, coalesce(trim(location.url), '') as u from sources)""",
    "content_manifest": r"""select path, 'text/markdown' as media_type, strlen(c) as size_bytes, sha256(c) as sha256, 'raw-' || left(sha256(path), 12) as path_id
       from (select doc_id || '.md' as path, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) as c from documents)""",
    "manifest_diff": f"""select coalesce(a.chunk_id, b.chunk_id) as chunk_id, case when a.chunk_id is null then 'added' when b.chunk_id is null then 'removed' else 'changed' end as change
       from {_state(EARLIER)} a full join {_state(DAY)} b on a.chunk_id = b.chunk_id where a.sha is distinct from b.sha""",
    "set_digests": f"select * from {_digest()}",
    "baseline_verdicts": f"""select n.relation_type, case when n.n_keys > coalesce(o.n_keys, 0) then 'growth' when n.n_keys = o.n_keys and n.digest <> o.digest then 'drift'
       when n.n_keys < o.n_keys then 'shrunk' else 'same' end as verdict from {_digest()} n left join {_digest("where recorded_at < timestamp '2025-06-30 00:00:00'")} o using (relation_type)""",
    "issue_report": f"{_N}, {_ISSUES.strip()} select * from issues",
    "top_issues": f"""{_N}, {_ISSUES.strip()} select * from issues
       order by case severity when 'critical' then 1 when 'high' then 2 when 'medium' then 3 else 4 end, code, path, message limit 100""",
    "graph_stats": f"""{_N}, {_EDGE.strip()}, {_LATEST.strip()}, {_NODES.strip()} select 'node' as part, node_type as kind, count(*) as n, 0 as n_with_evidence from nodes group by 2
       union all select 'edge', relation, count(*), count(*) filter (has_some) from (select source, relation, target, bool_or(coalesce(evidence_ref, '') <> '') as has_some
         from edge_rows where coalesce(source, '') <> '' and coalesce(target, '') <> '' group by all) group by 2""",
    "severity_gate": f"""{_N}, {_ISSUES.strip()} select s.severity, count(i.code) as n_issues from (values ('critical'), ('high'), ('medium'), ('low')) s(severity)
       left join issues i on i.severity = s.severity group by 1""",
    "migration_plan": """select schema_version, count(*) as n_rows, count(*) filter (schema_version <> '1.4' or coalesce(o, false) or coalesce(r, false) or coalesce(b, false)) as n_changes,
       count(*) filter (o) as n_open_ends, count(*) filter (b) as n_blank_aliases from (
       select schema_version, legal.validity.valid_until = '9999-12-31' as o, len(list_distinct(id_aliases)) < len(id_aliases) as r,
         len(list_filter(aliases, lambda x: x is null or trim(x) = '')) > 0 as b from entities) group by 1""",
    "event_actions": """select cast(cast(ts as date) as varchar) as day, event_type, count(*) as n_events, round(sum(value), 4) as total from events group by 1, 2""",
}
