"""Claim, log and page rules, supersession, verification, graph details and orders on small fixtures."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import markup
from tessera.operators import checks, claims, graph, quality, record_rules, resolve, rewrite, search, temporal, view

PAGES = "page string, part int, title string, body string"


def issues(df):
    return sorted((r.code, r.path, r.message) for r in df.collect())


@pytest.mark.parametrize(
    "body, accepted, rejected",
    [
        ("One fact. ^a\n\n- item ^b\n\nMore.\n\n^c\n\n```\ncode ^d\n```", ["a", "b", "c"], []),
        ("# Head ^a", [], ["a"]),
        ("first ^a\nsecond ^b", ["b"], ["a"]),
        ("````\n``` ^a\n````\n~~~\nx ^b\n~~~", [], []),
        ("- ^a\n\n> ^b", ["a", "b"], []),
        ("para\n\n^a\n^b", ["a"], ["b"]),
        ("- item\n\n^a", [], ["a"]),
        ("> said\n> ^a", ["a"], []),
        ("^a", [], ["a"]),
        ("| a | b |\n|---|---|\n| c | d ^x |\nafter ^y", ["y"], ["x"]),
    ],
)
def test_marks(body, accepted, rejected):
    if body.startswith("| a"):
        body = body.replace("d ^x |", "d ^x")
    yes, no = markup.anchors(body)
    assert [a[0] for a in yes] == accepted and [r[1] for r in no] == rejected


def test_claim_rules(spark):
    pages = [
        ("p", 1, "T", "Fact. ^good\n\n- ^empty\n\n# Head ^head\n\nTwice ^two"), ("p", 2, "T", "Twice ^two\n\nBad ^Bad_Id\n\n## My part\n\nx ^my-part"),
        ("q", 1, "Title", "# Title\n\nx ^title"), ("q", 2, None, None), (None, 1, "T", "x ^y"),
    ]
    named = [("p", c) for c in ("good", "good", " good ", "empty", "two", "lost", "lost", "NO", "", None)] + [("q", "title"), ("r", "none"), (None, "x")]
    pages, supports = spark.createDataFrame(pages, PAGES), spark.createDataFrame(named, "page string, claim_id string")
    got = [(c, m) for c, p, m in issues(claims.claim_rules(pages.where("page is not null"), supports))]
    assert got == sorted([
        ("CLAIM_ANCHOR_DUPLICATE", "two"), ("CLAIM_ANCHOR_UNREFERENCED", "my-part"), ("CLAIM_BLOCK_EMPTY", "empty"), ("CLAIM_FRAGMENT_COLLISION", "my-part"),
        ("CLAIM_ID_INVALID", "Bad_Id"), ("CLAIM_MARKER_CONTEXT", "head"), ("EVIDENCE_CLAIM_ID_INVALID", "NO"), ("EVIDENCE_CLAIM_UNRESOLVED", "NO"),
        ("EVIDENCE_CLAIM_UNRESOLVED", "lost"), ("EVIDENCE_CLAIM_UNRESOLVED", "none"),
    ])
    loose = {c for c, _, _ in issues(claims.claim_rules(pages, supports, strict=False))}
    assert "EVIDENCE_CLAIM_UNRESOLVED" not in loose and "CLAIM_ANCHOR_UNREFERENCED" not in loose
    assert claims.claim_rules(pages.limit(0), supports.limit(0)).count() == 0


def test_supersession(spark):
    rows = [
        ("a", "superseded", "2020-01-01", "9999-12-31", "a", "2019-01-01"), ("b", "current", "2020-01-01", "9999-12-31", " C ", "2021-01-01"),
        ("d", "overruled", "no date", "2020-01-01", "nobody", ""), ("e", "current", "", "9999-12-31", "", None), ("f", None, None, None, None, None), ("g", "current", "", "", "old-g", ""),
    ]
    df = spark.createDataFrame(rows, "id string, legal_status string, effective_from string, effective_to string, superseded_by string, superseded_date string")
    targets = spark.createDataFrame([("a", "a"), ("c", "c"), ("old-g", "g")], "key string, entity_id string")
    assert issues(temporal.supersession_issues(df, targets)) == [
        ("SUPERSESSION_DATE_ORDER", "a", "2019-01-01"), ("SUPERSESSION_OPEN_ENDED", "a", "superseded"), ("SUPERSESSION_SELF_REFERENCE", "a", "a"),
        ("SUPERSESSION_SELF_REFERENCE", "g", "old-g"), ("SUPERSESSION_TARGET_BROKEN", "d", "nobody"),
    ]
    assert temporal.supersession_issues(df.limit(0), targets).count() == 0


def test_verification_timeline(spark):
    records = [
        ("a", "case", "verified", "verified", "2024-01-10", "2024-01-05"), ("b", "law", "draft", "verified", None, None), ("c", "rule", "draft", "verified", "", ""),
        ("d", "case", "verified", "linked", "2024-01-10", "x"),
    ]
    evidence = [(1, "a", "2024-01-11"), (2, "a", "2024-01-10"), (3, "d", "2030-01-01"), (4, "none", "2030-01-02"), (5, None, "bad"), (6, "d", None)]
    df = spark.createDataFrame(records, "id string, entity_type string, status string, ingestion_status string, last_verified string, last_checked string")
    ev = spark.createDataFrame(evidence, "evidence_row int, entity_id string, verified_on string")
    assert [(c, p) for c, p, _ in issues(temporal.verification_timeline(df, ev, "2024-06-30"))] == [
        ("EVIDENCE_AFTER_LAST_VERIFIED", "evidence/1"), ("EVIDENCE_AFTER_LAST_VERIFIED", "evidence/3"), ("EVIDENCE_VERIFIED_IN_FUTURE", "evidence/3"),
        ("EVIDENCE_VERIFIED_IN_FUTURE", "evidence/4"), ("INGESTION_VERIFIED_EVIDENCE_MISSING", "b"), ("VERIFICATION_AFTER_CHECK", "a"),
    ]


def test_unknown_sources_need_a_registry(spark):
    evidence = spark.createDataFrame(
        [(1, "e", "x", "s1", "p", ["c"], None), (2, "e", "y", "s2", "p", ["c"], None)],
        "evidence_row int, entity_id string, evidence_id string, source_id string, locator string, supports array<string>, verified_on string",
    )
    sources = spark.createDataFrame([("S1 ",)], "source_id string")
    assert [(c, p) for c, p, _ in issues(record_rules.evidence_rules(evidence, sources))] == [("EVIDENCE_SOURCE_UNKNOWN", "evidence/2")]
    assert issues(record_rules.evidence_rules(evidence, sources.limit(0))) == []


def test_edges_of_authorities_and_conflicts(spark):
    records = spark.createDataFrame(
        [("a", [("law-1", "primary", "n"), (" law-2 ", "supporting", None), ("", "supporting", None)], [("k1", "scope", "active", ["b", "c", None], "why")], 1), ("b", [], None, 2), ("c", None, [], 3)],
        "id string, authorities array<struct<target_id:string,role:string,note:string>>, conflicts array<struct<conflict_id:string,type:string,status:string,target_ids:array<string>,note:string>>, ord int",
    )
    rows = graph.authority_edges(records).unionByName(graph.conflict_edges(records))
    edges = graph.ordered_edges(graph.merge_edges(rows, ["origin", "note"])).collect()
    assert [(e.source, e.relation, e.target, e.note) for e in edges] == [
        ("a", "has_authority", "law-2", []), ("a", "has_conflict", "conflict:a#k1", []), ("a", "has_primary_authority", "law-1", ["n"]),
        ("conflict:a#k1", "conflicts_with", "b", ["why"]), ("conflict:a#k1", "conflicts_with", "c", ["why"]),
    ]
    assert [tuple(r) for r in graph.conflict_nodes(records).collect()] == [("conflict:a#k1", "conflict", "k1", "a")]


def test_merged_edges_keep_first_places(spark):
    rows = [
        ("s", "r", "t", 3, "b", "x"), ("s", "r", "t", 1, "a", None), ("s", "r", "t", 2, "b", " "), ("s", "r", "t", 2, "b", "x"), ("", "r", "t", 1, "a", "x"), ("s", "r", None, 1, "a", "x"),
        ("s", None, "t", 1, None, None),
    ]
    df = spark.createDataFrame(rows, "source string, relation string, target string, ord int, origin string, note string")
    got = {r.relation: (r.n_rows, r.origin, r.note) for r in graph.merge_edges(df, ["origin", "note"]).collect()}
    assert got == {"r": (4, ["a", "b"], ["x"]), None: (1, [], [])}
    link = df.select(graph.evidence_link("origin", "note", F.lit(None)).alias("link")).where("link is not null").distinct()
    parts = link.groupBy().agg(F.array_sort(F.collect_list("link")).alias("l")).select(F.inline(graph.evidence_links("l")))
    assert sorted((r.evidence_ref, r.locator, r.claim_ref) for r in parts.collect()) == [("a", "", ""), ("a", "x", ""), ("b", " ", ""), ("b", "x", "")]
    assert graph.merge_edges(df.limit(0), ["origin"]).count() == 0


def test_long_paths_have_all_layers(spark):
    edges = [(k, k + 1) for k in range(12)] + [(50, 51), (51, 50), (51, 52)]
    got = dict(tuple(r) for r in graph.layers(spark.createDataFrame(edges, "source int, target int")).collect())
    assert got == {**{k: k for k in range(13)}, 50: None, 51: None, 52: None}


def test_log_and_page_rules(spark):
    items = [("l.md", 1, "CREATE", []), ("l.md", 2, "BREAK", []), ("l.md", 3, "", ["wiki/a.md", "wiki/Old.md", "wiki/gone.md", "raw/x.pdf", "note"]), ("l.md", 4, "", ["wiki/dead.md"])]
    df = spark.createDataFrame(items, "file string, line_no int, action string, targets array<string>")
    paths = spark.createDataFrame([("wiki/a.md",), ("wiki/new.md",)], "path string")
    moved = spark.createDataFrame([("wiki/old.md", "wiki/new.md"), ("wiki/dead.md", "wiki/none.md")], "alias string, target string")
    assert [(c, m) for c, _, m in issues(checks.log_issues(df, paths, moved))] == [
        ("LOG_ACTION_INVALID", "line 2: BREAK"), ("LOG_TARGET_UNRESOLVED", "line 3: wiki/gone.md"), ("LOG_TARGET_UNRESOLVED", "line 4: wiki/dead.md"),
    ]
    good = '<html lang="ko"><h1 id="a">x</h1><a href="b.html">y</a><a href="mailto:x@y">z</a></html>'
    bad = '<html lang="en"><p id="a"></p><p id="a"></p><img src="q"><a href="ftp://x">y</a> file:///home/me class="language-mermaid"</html>'
    pages = spark.createDataFrame([("g.html", good), ("b.html", bad), ("aliases/x.html", '<html lang="ko"></html>'), ("null.html", None)], "page string, html string")
    got = sorted((r.page, r.code, r.detail) for r in checks.page_issues(pages).collect())
    assert got == [
        ("b.html", "DUPLICATE_ID", "a"), ("b.html", "H1_COUNT", "0"), ("b.html", "IMAGE_ALT", "1"), ("b.html", "LANG_MISSING", "en"), ("b.html", "LOCAL_PATH_LEAK", ""),
        ("b.html", "REFERENCE_SCHEME", "ftp://x"), ("b.html", "UNRENDERED_MERMAID", ""), ("null.html", "H1_COUNT", "0"), ("null.html", "LANG_MISSING", ""),
    ]


def test_plain_digest(spark):
    rows = [("b", "x"), ("a", "y"), ("a", "y"), ("a", None), ("가", "z")]
    df = spark.createDataFrame(rows, "l string, r string")
    text = "\n".join(f"{a}\t{b}" for a, b in sorted({(a, b or "") for a, b in rows}))
    assert quality.plain_digest(df, ["l", "r"]) == (4, hashlib.sha256(text.encode()).hexdigest())
    assert quality.plain_digest(df.limit(0), ["l", "r"]) == (0, hashlib.sha256(b"").hexdigest())
    with pytest.raises(ValueError):
        quality.plain_digest(df, ["l", "r"], limit=2)


def test_section_chunks_and_orders(spark):
    df = spark.createDataFrame([("e", "T", "intro\n\n# A\n\ntext ^m\n\n# B\n\n```\nx\n```\n", " "), ("f", None, None, "2020-01-01"), ("g", "", "", None)], "id string, title string, body string, effective_from string")
    got = [tuple(r) for r in search.section_chunks(df, "body").orderBy("chunk_id").collect()]
    assert got == [
        ("e::section-001", "e", "T", "", "", "unknown", "1900-01-01", "9999-12-31", "본문", "intro"),
        ("e::section-002", "e", "T", "", "", "unknown", "1900-01-01", "9999-12-31", "A", "text"),
    ]
    records = spark.createDataFrame([("b", "law", "2020"), ("가", "x", "2021"), ("a", "case", "2020"), ("B", "law", "2022")], "title string, entity_type string, sort_date string")
    order = lambda m: [r.title for r in records.orderBy(*view.record_order(m, ["law", "case"])).collect()]
    assert order("newest")[:2] == ["B", "가"] and order("newest")[2:] == ["a", "b"] and order("oldest")[0] == "a"
    assert order("title").index("a") < order("title").index("b") and order("type")[:2] in (["b", "B"], ["B", "b"]) and order("type")[3] == "가"
    with pytest.raises(ValueError):
        view.record_order("other", [])
    assert markup.summary("# h\n\nbody text", None, " ", "**Held** so.") == "Held so." and markup.summary("# h\n\nbody text", "") == "body text"


def test_relations_and_conflicts_in_the_nested_form(spark):
    records = spark.createDataFrame([("a", "case", "Alpha"), ("b", "rule", "Beta"), ("c", "law", "Same"), ("d", "law", "Same")], "id string, entity_type string, title string")
    names = resolve.name_table(records, "id", ["id", "title"], [])
    rows = [
        (1, "a", "supports", "Beta", " n ", "9999-12-31"), (2, "a", "supports", "b", "n", None), (3, "a", "odd", "b", None, "2020-01-01"), (4, "a", "conflicts_with", "b", "why", None),
        (5, "a", "conflicts_with", "Beta", "again", None), (6, "a", "cites", " ", None, None), (7, "a", "related", "Same", None, ""), (8, None, "cites", None, None, None), (9, "b", "conflicts_with", "가 나", None, None),
    ]
    df = spark.createDataFrame(rows, "relation_row int, entity_id string, relation_type string, target_id string, note string, effective_on string")
    got = sorted(tuple(r) for r in rewrite.normalised_relations(df, names, ("supports", "cites")).collect())
    assert got == [
        (1, "a", "supports", "b", "n", None, True), (3, "a", "related_to", "b", "", "2020-01-01", True), (7, "a", "related_to", "Same", "", None, False),
    ]
    found = sorted(tuple(r) for r in rewrite.stated_conflicts(df, names).collect())
    assert found == [(4, "a", "conflict:a-b", "pending", "b", "why"), (9, "b", "conflict:b", "pending", "가 나", "")]
    links = spark.createDataFrame([(1, "a", "Beta"), (2, "a", "b"), (3, "b", "a"), (4, "a", "Same"), (5, "a", ""), (6, "z", "b")], "row int, entity_id string, target string")
    made, lost = rewrite.typed_links(links, names, records)
    assert sorted(tuple(r) for r in made.collect()) == [(1, "a", "supports", "b"), (3, "b", "cites", "a"), (6, "z", "cites", "b")]
    assert [tuple(r) for r in lost.collect()] == [(4, "a", "Same")]
    assert rewrite.normalised_relations(df.limit(0), names, ()).count() == 0


def test_unique_evidence_is_idempotent(spark):
    rows = [(1, "e", "x", "s", "l"), (2, "e", "x", "s", "l"), (3, "e", "", None, None), (4, "f", "x", "s", "l"), (5, "e", "x", None, "l"), (6, None, "x", "s", "l"), (7, "e", "y" * 100, "s", ""), (8, "e", "y" * 100, "s", "")]
    df = spark.createDataFrame(rows, "evidence_row int, entity_id string, evidence_id string, source_id string, locator string")
    once = {r.evidence_row: r.unique_id for r in rewrite.unique_evidence(df).collect()}
    digest = lambda *p: hashlib.sha256("\0".join(p).encode()).hexdigest()[:10]
    assert once == {
        1: "x", 2: "x-" + digest("e", "1", "s", "l"), 3: "evidence:e-2", 4: "x", 5: "x-" + digest("e", "3", "None", "l"), 7: "y" * 100, 8: "y" * 78 + "-" + digest("e", "5", "s", ""),
    }
    again = df.drop("evidence_id").join(spark.createDataFrame(list(once.items()), "evidence_row int, evidence_id string"), "evidence_row")
    assert {r.evidence_row: r.unique_id for r in rewrite.unique_evidence(again).collect()} == once


def test_verified_states_and_verification_plan(spark):
    schema = "id string, entity_type string, status string, ingestion_status string, last_verified string, verifier_ids array<string>, methods array<string>"
    rows = [
        ("a", "case", "verified", "verified", "2020-01-01", ["v", "x"], ["m"]), ("b", "case", "verified", "linked", "2020-01-01", ["v"], ["m"]), ("c", "rule", "verified", "odd", "2020-01-01", ["v"], [" m"]),
        ("d", "rule", "draft", "verified", None, ["v"], ["m"]), ("e", "rule", "odd", "linked", "", None, None), ("f", "rule", "verified", "linked", "2020-01-01", ["x"], ["m"]),
    ]
    evidence = spark.createDataFrame([("a",), ("a",), (None,)], "entity_id string")
    got = {r.id: tuple(r)[1:] for r in rewrite.verified_states(spark.createDataFrame(rows, schema), evidence, spark.createDataFrame([("v",)], "verifier_id string"), ("m",)).collect()}
    assert got == {
        "a": ("verified", "verified", False), "b": ("review", "linked", True), "c": ("verified", "linked", False), "d": ("review", "linked", True), "e": ("review", "linked", False), "f": ("review", "linked", True),
    }
    plans = [
        (1, ["Ann"], None), (2, ["Ann", "who"], None), (3, ["Ann"], ["v2"]), (4, ["Ann"], ["v1"]), (5, ["v1"], []), (6, ["v1", "Ann"], ["v1"]), (7, None, ["v1"]), (8, [" ", None], None),
    ]
    df = spark.createDataFrame([(k, v, (i,)) for k, v, i in plans], "row int, verified_by array<string>, verification struct<verifier_ids:array<string>>")
    out = {r.row: (r.changed, r.conflict, r.unknown) for r in rewrite.verification_plan(df, {"Ann": "v1"}, ("v1", "v2")).collect()}
    assert out[1] == (True, False, []) and out[2] == (False, False, ["who"]) and out[3] == (False, True, []) and out[4] == (False, False, [])
    assert out[7] == (False, False, []) and out[8] == (False, False, []) and out[6] == (False, False, [])
