"""Sources, markup, resolution, graph, search, checks, sinks and streams on small fixtures."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import random
import os
import sqlite3
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import flowchart, markup, norm, text
from tessera.operators import checks, graph, quality, resolve, search, temporal, view
from tessera.plans import reference_queries
from tessera.sinks import writers
from tessera.sources import frontmatter, readers
from tessera.streaming import flows

HEADER = """---
id: rule-a
title: "A: b # c"   # comment
n: 3
d: 2024-01-02
empty:
tags: [a, 'b, c', {k: v}]
note: >-
  one
  two
evidence:
  - evidence_id: e1
    supports: [c1, c2]
  - evidence_id: e2
    supports:
      - c3
    note: x
---
Body
"""


def test_header_types():
    data, body = frontmatter.parse_document("\ufeff" + HEADER)
    assert data["title"] == "A: b # c" and data["n"] == 3 and data["d"] == "2024-01-02" and data["empty"] is None
    assert data["tags"] == ["a", "b, c", {"k": "v"}] and data["note"] == "one two" and body == "Body\n"
    assert data["evidence"][1] == {"evidence_id": "e2", "supports": ["c3"], "note": "x"}


@pytest.mark.parametrize("bad", ["a: 1\na: 2", "a: !x", "\ta: 1", "- a", "a: 1\n  b: 2", "a", "x: {a: 1, a: 2}", "l:\n- a", 'q: "a'])
def test_header_errors(bad):
    if bad == 'q: "a':
        assert frontmatter.parse_header(bad) == {"q": '"a'}
        return
    with pytest.raises(frontmatter.HeaderError):
        frontmatter.parse_header(bad)


_KEY = st.text("abcxyz-_ 가나", min_size=1, max_size=8).filter(lambda s: s.strip() == s)
_LEAF = st.none() | st.booleans() | st.integers() | st.text(max_size=20)
_VALUE = st.recursive(_LEAF, lambda v: st.lists(v, max_size=3) | st.dictionaries(_KEY, v, max_size=3), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(_KEY, _VALUE, max_size=4))
def test_header_round_trip(data):
    assert frontmatter.parse_header(frontmatter.dump_header(data)) == data


def test_parse_documents_keeps_extra_columns(spark):
    df = spark.createDataFrame([(1, HEADER, "kept"), (2, "no header", "x"), (3, None, None)], "n int, text string, body string")
    rows = {r.n: r for r in frontmatter.parse_documents(df).collect()}
    assert json.loads(rows[1].header)["n"] == 3 and rows[1].body == "Body\n" and rows[1].type_tags["tags"] == "list"
    assert rows[1].present_keys[0] == "id" and rows[2].error == "no header" and rows[3].header is None
    assert frontmatter.parse_documents(df.limit(0)).count() == 0


def test_folder_reading(spark, tmp_path):
    for name, content in {"rules/a.md": HEADER, "rules/b.md": "x", "logs/c.md": HEADER, ".h/d.md": HEADER, "index.md": HEADER, "e.md": HEADER.replace("n: 3", "entity_type: rule")}.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(content)
    good, issues = frontmatter.load_entities(spark, str(tmp_path))
    assert [r.path for r in good.collect()] == ["e.md"]
    assert sorted((r.path, r.code) for r in issues.collect()) == [("rules/a.md", "ENTITY_TYPE_MISSING"), ("rules/b.md", "FRONTMATTER_PARSE")]


BODY = """# Title

First paragraph ^one
- item ^two

A block
^three

```
inside ^four
```
## Head ^five
prose ^six
prose ^seven

> quote ^eight
| a | b |
|---|---|
| c | d ^nine
- ^ten
"""


def test_claim_anchors():
    accepted, rejected = markup.anchors(BODY)
    assert [(c, n) for c, n, _ in accepted] == [("one", 3), ("two", 4), ("three", 7), ("seven", 14), ("eight", 16), ("ten", 20)]
    assert dict((c, t) for c, _, t in accepted)["three"] == "A block" and dict((c, t) for c, _, t in accepted)["ten"] == ""
    assert rejected == [(12, "five"), (13, "six"), (19, "nine")]
    assert markup.resolved(BODY, "Title") == ["one", "two", "three", "seven", "eight"]
    assert markup.headings(BODY, "Title") == ["head-five"]
    assert "^one" not in markup.stripped(BODY) and "^four" in markup.stripped(BODY)


def test_sections_and_summary():
    body = "intro\n## A **b**\ntext `x` [l](u) [[p#h|Label]] [[q]]\n~~~\n# no heading\n~~~\n## Empty\n"
    assert markup.sections(body) == [("본문", "intro"), ("A b", "text x l Label q")]
    assert markup.summary("# T\n\n| a |\n\n> One. Two.\nmore\n\nnext") == "One. Two. more"
    assert markup.shortened("a" * 50 + ". " + "b" * 60, 80) == "a" * 50 + "."
    assert markup.shortened("word " * 40, 20) == "word word word word…"
    assert markup.sections("") == [] and markup.summary("") == ""


def test_plain_text_is_the_same_in_both(spark):
    texts = ["**b** and __c__ ~~d~~ *e* _f_ a_b_c", "[[a|b]] [x](y) `code`\n> q\n## h", "snake_case 2*3*4", "<BR/>x", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.plain_text("t").alias("p")).collect()
    for r in rows:
        assert r.p == (None if r.t is None else markup.plain(r.t))


MARKED = [
    "**bold** and __bold__ ~~struck~~ *it* _it_ snake_case_name 2 * 3 * 4", "***both*** **a *b* c** __init__ _가_나 (_x_)",
    "**open\n**closed** *a\rb* _a\u0085b_ ~~a\u2028b~~", "a\r# no heading\n  ## heading\n> quote\r> none\n\x1f> quote",
    "_e\u0301_ _a_\u0301 *\x1ca* \x1cend\x1d", "[[p#h|**Label**]] [*l*](u) `_c_` <br/>\u3000x", "", None,
]


def test_plain_text_query_takes_every_step(spark, tmp_path):
    spark.createDataFrame(list(enumerate(MARKED)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.digest for r in reference_queries.plain_text(spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.sha256(markup.plain(t).encode()).hexdigest() for k, t in enumerate(MARKED) if t is not None}


def test_udf_columns(spark):
    df = spark.createDataFrame([(BODY, "Title"), (None, None), ("", "")], "b string, t string")
    rows = df.select(
        F.size(markup.claim_anchors("b").getField("accepted")).alias("n"), markup.resolved_claims("b", "t").alias("r"),
        markup.heading_ids("b", "t").alias("h"), markup.without_claim_marks("b").alias("s"), markup.folded("t").alias("f"), markup.summary_text("b").alias("m"),
    ).collect()
    assert rows[0].n == 6 and rows[0].h == ["head-five"] and rows[0].f == "title" and rows[1].r is None and rows[2].m == ""


def test_page_links(spark):
    html = '<html lang="ko"><h1 id="a">x</h1><a href="b.html#top">l</a><a href="../c.html">l</a><a href="/d">l</a><img src="https://x/y.png"></html>'
    pages = spark.createDataFrame([("s/a.html", html), ("s/b.html", '<p id="q"><a href="./#a">i</a><a href="../../z.html">z</a></p>'), ("c.html", "")], "page string, html string")
    parts = pages.select("page", markup.page_parts("html").alias("p")).select("page", "p.*")
    assert parts.where("page = 's/a.html'").first().h1_count == 1
    got = sorted((r.page, r.reference, r.code) for r in checks.page_link_issues(parts).collect())
    assert got == [
        ("s/a.html", "/d", "ROOT_ABSOLUTE_REFERENCE"), ("s/a.html", "b.html#top", "BROKEN_FRAGMENT"),
        ("s/b.html", "../../z.html", "REFERENCE_ESCAPE"), ("s/b.html", "./#a", "BROKEN_REFERENCE"),
    ]


def test_strict_dates_and_keys(spark):
    values = ["2024-02-29", "2023-02-29", "2024-7-1", "2024-07", " 2024-07-01", "2024-07-01\n", "0000-01-01", "", None]
    got = [r.d for r in spark.createDataFrame([(v,) for v in values], "v string").select(norm.strict_date("v").alias("d")).collect()]
    assert got == [dt.date(2024, 2, 29)] + [None] * 8
    row = spark.createDataFrame([(" \u3000Ab C\u00a0", "a b/~*ü")], "x string, y string").select(norm.reference_key("x").alias("k"), norm.percent_encode("y").alias("p")).first()
    assert row.k == "ab c" and row.p == "a%20b%2F~%2A%C3%BC"


def test_resolution(spark):
    recs = spark.createDataFrame(
        [("a", "Title A", "wiki/rules/a.md", ["x", None, ""]), ("b", "Title B", "wiki/laws/b.md", ["x"]), (None, "t", "p", None)],
        "id string, title string, path string, aliases array<string>",
    )
    names = resolve.name_table(recs, "id", ["id", "title", "path"], ["aliases"])
    refs = spark.createDataFrame([(1, "./wiki/rules/A.md"), (2, "other/b"), (3, "X"), (4, "zzz"), (5, None), (6, " ")], "row int, ref string")
    got = {r.row: (r.n_matches, r.resolved_id) for r in resolve.resolve(refs, names, "ref", ["row"]).collect()}
    assert got == {1: (1, "a"), 2: (1, "b"), 3: (2, None), 4: (0, None), 5: (0, None), 6: (0, None)}


def test_alias_closure_and_numbering(spark):
    links = spark.createDataFrame([(f"a{i}", f"a{i + 1}") for i in range(9)] + [("p", "q"), ("q", "p"), ("s", "s"), (None, "x"), ("", "x")], "alias string, target string")
    got = {r.alias: (r.target, r.depth, r.is_cycle) for r in resolve.alias_closure(links, spark, 64).collect()}
    assert got["a0"] == ("a9", 9, False) and got["a8"] == ("a9", 1, False) and got["p"][2] and got["s"][2] and len(got) == 12
    df = spark.range(200).selectExpr("id", "if(id < 150, 'hot', if(id < 190, 'g', null)) as g")
    rows = resolve.numbered(df, "g", ["id"]).collect()
    for g in ("hot", "g", None):
        mine = sorted((r.id, r.number) for r in rows if r.g == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_alias_closure_walks_chains_of_any_length(spark, tmp_path):
    links = {f"{n}-{i}": f"{n}-{i + 1}" for n in (1, 2, 15, 16, 17, 33, 100) for i in range(n)}
    links |= {f"c{n}-{i}": f"c{n}-{(i + 1) % n}" for n in (1, 2, 3, 16) for i in range(n)} | {"in": "way", "way": "c3-1", "side": "100-50"}
    spark.createDataFrame(list(links.items()), "alias_id string, canonical_id string").write.parquet(str(tmp_path / "id_aliases.parquet"))
    got = {r.alias: (r.target, r.depth, r.is_cycle) for r in reference_queries.alias_closure(spark, str(tmp_path)).collect()}
    assert set(got) == set(links)
    for alias, (target, depth, is_cycle) in got.items():
        at, seen = alias, set()
        while at in links and at not in seen:
            seen.add(at)
            at = links[at]
        assert is_cycle == (at in links) and (is_cycle or (target, depth) == (at, len(seen)))
    chain = spark.createDataFrame([(f"{i}", f"{i + 1}") for i in range(3)], "alias string, target string")
    assert {r.alias: (r.target, r.depth, r.is_cycle) for r in resolve.alias_closure(chain, spark).collect()}["0"] == ("3", 3, False)
    assert resolve.alias_closure(chain.limit(0), spark).count() == 0


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b"), (2, "a")], "n int, k string")
    assert sorted((str(r.k), r.n_rows) for r in resolve.duplicates(df, ["k"]).collect()) == [("None", 2), ("a", 3)]
    assert sorted(r.n for r in resolve.later_duplicates(df, ["k"], "n").collect()) == [2, 2, 4]


def test_edges_keep_first_order(spark):
    rows = spark.createDataFrame(
        [("a", "r", "b", "n2", 2), ("a", "r", "b", "n1", 1), ("a", "r", "b", "n2", 3), ("a", "r", "b", None, 0), ("", "r", "b", "x", 1), ("a", "r", None, "x", 1), ("c", "related_to", "a", None, 1), ("a", "r", "c", None, 1), ("a", "r", "a", None, 1)],
        "source string, relation string, target string, note string, ord int",
    )
    edges = graph.merge_edges(rows, ["note"])
    got = {(r.source, r.target): (r.note, r.n_rows) for r in edges.collect()}
    assert got == {("a", "b"): (["n1", "n2"], 4), ("c", "a"): ([], 1), ("a", "c"): ([], 1), ("a", "a"): ([], 1)}
    import hashlib

    assert edges.where("target = 'b'").first().id == "edge-" + hashlib.sha256(b"a\0r\0b").hexdigest()[:16]
    assert sorted((r.entity_id, r.other_id, r.relations) for r in graph.related(edges).collect()) == [
        ("a", "b", ["r"]), ("a", "c", ["r"]), ("b", "a", ["r"]), ("c", "a", ["r"]),
    ]


def test_graph_issues_and_layers(spark):
    nodes = spark.createDataFrame([("a", "entity"), ("a", "source"), ("", "claim"), (None, "claim"), ("b", "entity")], "id string, node_type string")
    edges = spark.createDataFrame([("1", "a", "r", "b"), ("2", "a", "", "z"), ("3", None, "r", "b")], "id string, source string, relation string, target string")
    codes = sorted(r.code for r in graph.edge_issues(nodes, edges).collect())
    assert codes == ["GRAPH_EDGE_ENDPOINT_EMPTY", "GRAPH_EDGE_ENDPOINT_MISSING", "GRAPH_EDGE_RELATION_MISSING", "GRAPH_NODE_ID_DUPLICATE", "GRAPH_NODE_ID_MISSING", "GRAPH_NODE_ID_MISSING"]
    assert flowchart.parse("flowchart TD\n A[x] --> B{y} -->|no| C\n A --> C") == [("A", "B", ""), ("B", "C", "no"), ("A", "C", "")]
    for bad in ("flowchart TD\nA --> A", "graph LR", "x"):
        with pytest.raises(ValueError):
            flowchart.parse(bad)
    df = spark.createDataFrame([("A", "B"), ("B", "C"), ("A", "C"), ("X", "Y"), ("Y", "X"), ("Y", "Z"), (None, "A")], "source string, target string")
    assert {r.node: r.depth for r in graph.layers(df).collect()} == {"A": 0, "B": 1, "C": 2, "X": None, "Y": None, "Z": None}


def test_first_related_and_claims(spark):
    edges = spark.createDataFrame([("a", "cites", "r1", 1), ("a", "applies", "r2", 9), ("a", "applies", "l", 0), ("a", "applies", "a", 0)], "source string, relation string, target string, ord int")
    types = spark.createDataFrame([("r1", "rule"), ("r2", "rule"), ("r2", "rule"), ("l", "law"), ("a", "rule")], "id string, node_type string")
    assert [(r.source, r.target) for r in graph.first_related(edges, types, "rule", ["applies"]).collect()] == [("a", "r2")]
    anchors = spark.createDataFrame([("e", "c1"), ("e", "c2"), ("e", "c2")], "entity_id string, claim_id string")
    supports = spark.createDataFrame([("e", "c1", "v"), ("e", "c1", "v"), ("e", "c2", "v"), ("e", "c3", "w")], "entity_id string, claim_id string, evidence_id string")
    assert sorted((r.claim_id, r.n_evidence, r.resolved) for r in graph.claim_plan(anchors, supports).collect()) == [("c1", 1, True), ("c2", 1, False), ("c3", 1, False)]


DOCS = [
    (1, "Wage law", "overtime", "night work is paid, night by night"), (2, "Night", "", "the employer pays overtime"), (3, "Other", "night work", "nothing here"),
    (4, "Élan", None, "overtime overtime pays"), (5, "Empty", None, None), (6, "work", "x", "work night of pay overtime"),
]


def test_claim_plan_reads_anchors_as_the_page_does(spark, tmp_path):
    chunks = [
        ("e", "T", "본문", "A block ^once\n\n```\ncode ^once\nmore ^fenced\n```\n"),
        ("e", "T", "Facts", "# Head ^head\n\n| a | b |\n|---|---|\n| c | d ^cell\nrun ^running\ngoes on\n\n^alone\n\n- ^empty\n- x ^my-head"),
        ("e", "T", None, "## My head\n\nsection ^facts\n\npage ^main\n\n- one ^two\n\n- two ^two\n\n- fit ^t\n\n- last ^bad_id"),
        ("f", "Facts", "Facts", "# Facts\n\nhere ^facts\n\ntwice ^once"), ("f", None, None, None), (None, "T", None, "x ^once"),
    ]
    ids = ["once", "fenced", "head", "cell", "running", "alone", "empty", "my-head", "facts", "main", "two", "t", "bad_id", "none"]
    evidence = [(e, i, ids) for i, e in enumerate(("e", "f", "f"))]
    spark.createDataFrame(chunks, "entity_id string, title string, heading string, content string").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame(evidence, "entity_id string, evidence_id int, supports array<string>").write.parquet(str(tmp_path / "evidence.parquet"))
    rows = reference_queries.claim_plan(spark, str(tmp_path)).collect()
    assert {(r.entity_id, r.claim_id) for r in rows if r.resolved} == {("e", "once"), ("e", "alone"), ("e", "t"), ("f", "facts"), ("f", "once")}
    assert len(rows) == 2 * len(ids) and {r.n_evidence for r in rows if r.entity_id == "f"} == {2}


def test_bm25_equals_sqlite(spark):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table f using fts5(title, heading, content, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    con.executemany("insert into f(rowid, title, heading, content) values (?, ?, ?, ?)", [(a, b, c or "", d or "") for a, b, c, d in DOCS])
    df = spark.createDataFrame(DOCS, "id int, title string, heading string, content string")
    for query in ("overtime", "night work", "elan OR employer", '"night work"', "overtime NOT employer", "pay*", "title: night", "NEAR(night overtime, 2)", "(night OR employer) AND overtime", '"by night"'):
        want = dict(con.execute("select rowid, bm25(f, 2, 1, 1) from f where f match ?", (query,)).fetchall())
        got = {r.id: r.rank for r in search.bm25(df, query, {"title": 2.0, "heading": 1.0, "content": 1.0}).collect()}
        assert set(got) == set(want), query
        for k in want:
            if ":" not in query:
                assert math.isclose(got[k], want[k], rel_tol=1e-6, abs_tol=1e-9), query
    assert search.bm25(df.limit(0), "x", {"title": 1.0}).count() == 0
    for bad in ("(a", "", "a OR"):
        with pytest.raises(ValueError):
            search.parse_match(bad)


def _query(rng, depth=0):
    """A query of the match language; not each is well-formed."""
    word = lambda: rng.choice("a b c d e".split())

    def phrase():
        text = rng.choice([word(), word(), f'"{word()} {word()}"', word() + "*", f"{word()} + {word()}", f"^ {word()}"])
        return rng.choice(["", "", "", "title: ", "- heading: ", "{title content}: "]) + text

    def side_by_side():
        near = f"NEAR({word()} {word()}, {rng.randrange(3)})"
        return " ".join(rng.choice([phrase(), phrase(), near]) for _ in range(rng.choice([1, 1, 2, 3])))

    parts = [side_by_side() if depth > 1 or rng.random() < 0.7 else f"{rng.choice(['', '', 'heading: '])}({_query(rng, depth + 1)})" for _ in range(rng.choice([1, 2, 2, 3]))]
    out = parts[0]
    for p in parts[1:]:
        out += rng.choice([" AND ", " OR ", " NOT ", " NOT ", " "]) + p
    return out


def test_match_language_equals_sqlite(spark, tmp_path):
    rng = random.Random(5)
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table f using fts5(title, heading, content, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    text = lambda n: " ".join(rng.choice(["a", "b", "c", "d", "e", "ab", "x"]) for _ in range(rng.randrange(n)))
    docs = [(k, text(3), text(3), text(7)) for k in range(300)]
    con.executemany("insert into f(rowid, title, heading, content) values (?, ?, ?, ?)", docs)
    fields = ["title", "heading", "content"]
    df = spark.createDataFrame(docs, "chunk_row int, title string, heading string, content string")
    queries = ["a b NOT c d", "a NOT c d", "a b NOT c", "a AND b NOT c", "a NOT b NOT c", "a NOT b AND c", "a OR b NOT c", "a (b)", "(a) b", "NEAR", "NEAR(a)", "a NOT", "NOT a"]
    queries += [_query(rng) for _ in range(150)]
    good, want = [], {}
    for q in queries:
        try:
            want[q] = {r[0]: r[1] for r in con.execute("select rowid, bm25(f, 2, 1, 1) from f where f match ?", (q,))}
        except sqlite3.OperationalError:
            with pytest.raises(ValueError):
                search.parse_match(q)
        else:
            good.append(q)
    good = list(dict.fromkeys(good))
    assert len(good) > 100
    tokens, columns = search.tokenised(df, fields)
    for k in range(0, len(good), 20):
        part = good[k : k + 20]
        hits = [F.coalesce(search.matches(search.parse_match(q), columns), F.lit(False)).alias(f"q{n}") for n, q in enumerate(part)]
        rows = tokens.select("chunk_row", *hits).collect()
        for n, q in enumerate(part):
            assert {r.chunk_row for r in rows if r[f"q{n}"]} == set(want[q]), q
    writers.write_postings(df, str(tmp_path / "index"), buckets=4)
    index = search.open_index(spark, str(tmp_path / "index"), buckets=4)
    for q in good[:40]:
        found = {r.chunk_row: r.rank for r in search.search_index(index, q, {"title": 2.0, "heading": 1.0, "content": 1.0}).collect()}
        assert set(found) == set(want[q]), q
        if ":" not in q and "^" not in q and "NEAR" not in q and "NOT" not in q:
            assert all(math.isclose(found[i], want[q][i], rel_tol=1e-6, abs_tol=1e-9) for i in found), q
    assert search.search_index(index, "zz OR yy", {"title": 1.0}).count() == 0


def test_search_helpers(spark):
    df = spark.createDataFrame([(i, f"t{i:02}") for i in range(25)], "id int, title string")
    assert [r.id for r in search.page(df, 99, 10, ["title"]).collect()] == list(range(20, 25))
    assert [r.id for r in search.page(df, 0, 10, ["title"]).collect()] == list(range(10))
    assert search.page(df.limit(0), 3, 10, ["title"]).count() == 0
    many = spark.range(5000).select((F.col("id") % 40).alias("a"), "id").repartition(7)
    want = [tuple(r) for r in many.orderBy(F.desc("a"), "id").collect()]
    for number in (1, 3, 200, 313, 999):
        place = min(number, 313) - 1
        got = [tuple(r) for r in search.page(many, number, 16, [F.desc("a"), "id"], deep=0).collect()]
        assert got == want[place * 16 : place * 16 + 16], number
    lit = F.lit
    score = search.additive_score(["ab", "c"], lit("ab"), lit("x"), lit("c"), lit("no 1"), lit("ab c x"))
    none = search.additive_score(["zz"], lit("a"), lit(""), lit(""), lit(""), lit("a"))
    row = spark.range(1).select(score.alias("a"), none.alias("b"), search.snippet(lit("one two three Night five"), "night", 3).alias("s")).first()
    assert row.a == 80 + 3 + 12 + 3 and row.b == -1 and row.s == " … three [Night] five"
    assert search.fold_query("Ａb·C  d") == ["ab", "c", "d"]
    assert search.top_ranked(df, 0, ["title"]).count() == 1


RELEVANT = [
    (1, "수당 안내", "raw-1", "guide", "# 지급\n\n- 항목\n\n수당 지급 요약이다.\n\n더 있다."),  # the summary is not the beginning
    (2, "수당", "지급 규정", "수당", "terms only beside the text"),
    (3, None, None, None, "ＡＢ 수당·지급\u3000 x"),
    (4, unicodedata.normalize("NFD", "수당 지급"), "s", "지급", unicodedata.normalize("NFD", "수당") + " ^mark"),
    (5, "지급", None, "x", None),
    (6, "수당", "지급", "x", None),
    (7, " ", "", "수당지급", "수**당** 지*급*"),
    (8, "t", "s", "x", "```\n수당 지급\n```\n" + "가나 " * 90 + "수당"),
    (9, None, None, None, None),
]


def relevance(terms, title, source, kind, body):
    fold = lambda t: " ".join(unicodedata.normalize("NFKC", t or "").lower().replace("·", " ").split())
    parts = [(x or "").strip() for x in (title, source, kind, markup.plain(markup.stripped(body or "")))]
    whole = fold(" ".join(dict.fromkeys(x for x in parts if x)))
    title, source, kind, short = fold(title), fold(source), fold(kind), fold(markup.summary(body or ""))
    if not all(t in whole for t in terms):
        return -1
    return sum(
        (100 if kind == t else 70 * (t in kind)) + (80 if title == t else 55 if title.startswith(t) else 40 * (t in title))
        + 30 * (t in source) + 12 * (t in short) + 3
        for t in terms
    )


def test_relevance_takes_all_parts(spark, tmp_path):
    columns = "doc_id bigint, title string, source string, entity_type string, text string"
    spark.createDataFrame(RELEVANT, columns).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.score for r in reference_queries.additive_relevance(spark, str(tmp_path)).collect()}
    want = {k: relevance(["수당", "지급"], *rest) for k, *rest in RELEVANT}
    assert got == {k: v for k, v in want.items() if v >= 0} and {1, 2, 3, 4, 6, 7, 8} <= set(got)


def test_temporal(spark):
    df = spark.createDataFrame(
        [(1, "2020-01-01", "2020-02-01"), (2, "2020-02-01", None), (3, "2020-01-01", ""), (4, "x", None), (5, "2020-01-01", "x"), (6, None, None), (7, "2020-01-01", "9999-12-31")],
        "n int, a string, b string",
    )
    assert sorted(r.n for r in temporal.as_of(df, "2020-02-01", "a", "b").collect()) == [2, 3, 7]
    late = df.select(temporal.review_overdue(F.lit("monthly"), F.lit("2020-01-01"), "2020-02-01").alias("a"), temporal.review_overdue(F.lit("monthly"), F.lit("2020-01-01"), "2020-02-02").alias("b"), temporal.review_overdue(F.lit("x"), F.lit("2020-01-01"), "2030-01-01").alias("c")).first()
    assert (late.a, late.b, late.c) == (False, True, False)
    day = spark.sql("select timestamp '2024-01-01 16:00:00' as t").select(temporal.local_day("t").alias("d")).first().d
    assert day == dt.date(2024, 1, 2)
    first = df.select(temporal.first_valid_date([("a", F.col("a")), ("b", F.col("b"))]).alias("f"), "n").collect()
    assert {r.n: r.f and r.f.label for r in first}[4] is None and {r.n: r.f and r.f.label for r in first}[1] == "a"
    assert [r.path for r in temporal.timeline_issues(df.withColumn("p", F.lit("p")), "p", [("ORDER", "b", "a")]).collect()] == ["p", "p"]
    over = temporal.successor_overlaps(df.withColumn("e", F.lit("e")), "e", "a", "b", "n")
    assert [r.n for r in over.collect()] == [1]


def test_quality(spark):
    old = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], "k string, v string")
    new = spark.createDataFrame([("a", "2"), ("b", None), ("d", "4")], "k string, v string")
    assert sorted((r.k, r.change) for r in quality.diff(old, new, "k", "v").collect()) == [("a", "changed"), ("c", "removed"), ("d", "added")]
    a, b = quality.set_digest(old, ["k", "v"]).first(), quality.set_digest(old.union(old).orderBy(F.desc("k")), ["k", "v"]).first()
    assert a == b and a.n_keys == 3
    g = lambda df: quality.set_digest(df.withColumn("g", F.lit("g")), ["k", "v"], ["g"])
    assert quality.compare_baseline(g(new), g(old), ["g"]).first().verdict == "drift"
    assert quality.compare_baseline(g(new.union(old)), g(old), ["g"]).first().verdict == "growth"
    issues = spark.createDataFrame([("high", "B", "p", "f", "m"), ("critical", "A", "p", "f", "m"), ("high", "A", "p", "f", "m")], "severity string, code string, path string, field string, message string")
    assert [r.code + r.severity for r in quality.ordered_issues(issues).collect()] == ["Acritical", "Ahigh", "Bhigh"]
    counts = quality.severity_counts(spark, issues)
    assert {r.severity: r.n_issues for r in counts.collect()} == {"critical": 1, "high": 2, "medium": 0, "low": 0}
    assert quality.breaches(counts, "critical") and not quality.breaches(quality.severity_counts(spark, issues.limit(0)), "low")
    files = spark.createDataFrame([("a.md", b"x\r\ny"), ("b.md", b"x\ny"), ("c.pdf", b"x\r\ny"), ("d", None)], "path string, content binary")
    m = {r.path: r for r in quality.manifest(files).collect()}
    assert m["a.md"].sha256 == m["b.md"].sha256 != m["c.pdf"].sha256 and m["c.pdf"].size_bytes == 4 and m["d"].size_bytes == 0
    assert {(r.facet, r.value): r.n_rows for r in quality.facet_counts(old, ["v"]).collect()} == {("v", "1"): 1, ("v", "(none)"): 1, ("v", "3"): 1}


def test_raw_records(spark):
    rows = ['{"id": 5, "locator": " ", "extra": 1}', '{"id": "a", "supports": null}', '["x"]', '{"id": null, "locator": "x", "supports": []}']
    df = spark.createDataFrame(list(enumerate(rows)), "p int, j string").select(F.col("p").cast("string").alias("p"), F.parse_json("j").alias("r"))
    fields = [checks.Field("id", required=True), checks.Field("locator", required=True, blank_allowed=False), checks.Field("supports", "list")]
    got = sorted((r.path, r.code, r.field) for r in checks.field_issues(df, "r", "p", fields, "EV").collect())
    assert got == [
        ("0", "EV_FIELD_BLANK", "locator"), ("0", "EV_FIELD_TYPE", "id"), ("0", "EV_FIELD_UNKNOWN", "extra"),
        ("1", "EV_FIELD_MISSING", "locator"), ("1", "EV_FIELD_TYPE", "supports"), ("2", "EV_ITEM_TYPE", ""), ("3", "EV_FIELD_TYPE", "id"),
    ]


def test_rules(spark):
    df = spark.createDataFrame([(1, "a", ["x", "x"], "good"), (2, "a", [None], "bad"), (3, None, None, None), (4, " B ", ["y"], "")], "path int, k string, l array<string>, v string")
    vocab = spark.createDataFrame([("f", "good")], "field string, value string")
    known = spark.createDataFrame([("b",), (None,)], "id string")
    assert sorted((r.path, r.code) for r in checks.list_issues(df, "l", "path", "L").collect()) == [(1, "L_DUPLICATE"), (2, "L_BLANK")]
    assert [(r.path, r.field, r.message) for r in checks.vocabulary_issues(df, {"v": "f"}, "path", vocab).collect()] == [(2, "v", "bad")]
    assert sorted(r.path for r in checks.unique_issues(df, ["k"], "path", "U").collect()) == ["1", "2"]
    assert sorted(r.path for r in checks.reference_issues(df, "k", "path", known, "R").collect()) == ["1", "2"]


def test_readers(spark, tmp_path):
    registry = tmp_path / "registry.yaml"
    registry.write_text("sources:\n  - source_id: s1\n    authority_level: 2\n    location:\n      kind: path\n      path: raw/a.pdf\n  - source_id: s2\n    path: raw/b.pdf\n")
    rows = {r.source_id: r for r in readers.read_registry(spark, str(registry)).collect()}
    assert rows["s1"].location.path == "raw/a.pdf" and rows["s2"].location.kind == "path" and rows["s1"].authority_level == 2
    assert readers.read_registry(spark, str(tmp_path / "none"), tolerant=True).count() == 0
    for name, content, kind in (("none", None, "missing"), ("bad", "a: 1\na: 2\n", "parse"), ("type", "sources: x\n", "type")):
        if content:
            (tmp_path / name).write_text(content)
        with pytest.raises(readers.RegistryError) as e:
            readers.read_registry(spark, str(tmp_path / name))
        assert e.value.kind == kind
    lines = tmp_path / "m.jsonl"
    lines.write_text('{"source_id": "a"}\n\nnot json\n[1]\n{"source_id": "b", "x": 1}\n')
    assert sorted(r.source_id for r in readers.read_jsonl(spark, str(lines), "source_id string").collect()) == ["a", "b"]
    assert [(r.line, r.is_json, r.is_object) for r in readers.qa_records(spark, str(lines)).orderBy("line").collect()] == [(1, True, True), (3, False, False), (4, True, False), (5, True, True)]
    (tmp_path / "v.json").write_text('[{"a": 1}]')
    assert readers.read_json(spark, str(tmp_path / "v.json"), "a int").first().a == 1
    default = spark.createDataFrame([(7,)], "a int")
    assert readers.read_json(spark, str(tmp_path / "nope.json"), "a int", default).first().a == 7
    paths = spark.createDataFrame([(p,) for p in ("raw/a.pdf", "raw/.h/b", "raw/~$c.doc", "raw/AGENTS.md", "raw/d.tmp")], "path string")
    assert [r.path for r in readers.raw_files(paths).collect()] == ["raw/a.pdf"]
    assert readers.raw_files(paths, True, True).count() == 5
    assert sorted(r.name for r in readers.raw_names(paths.limit(1)).collect()) == ["a", "a.pdf", "raw/a", "raw/a.pdf"]
    log = spark.createDataFrame([("f", 1, "- Action: create"), ("f", 2, "- Target: a.md; b.md"), ("f", 3, "other"), ("f", 4, None)], "file string, line_no int, text string")
    assert [(r.line_no, r.action, r.targets) for r in readers.log_items(log).orderBy("line_no").collect()] == [(1, "create", []), (2, "", ["a.md", "b.md"])]
    assert {(r.field, r.value) for r in readers.vocabulary(spark, '{"f": ["a", "a"], "n": 1}').collect()} == {("f", "a")}
    assert [(r.alias, r.target) for r in readers.alias_map(spark, "aliases:\n  ./A.md: B.md\n").collect()] == [("a", "b")]
    ids = spark.createDataFrame([("a",), (" ",), (None,), (" a ",)], "source_id string")
    assert [r.source_id for r in readers.known_source_ids(ids, ids).collect()] == ["a"]
    last = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "k string, n int, v string")
    assert readers.last_of_each(last, "k", "n").first().v == "new"
    assert readers.read_texts(spark, str(tmp_path), "*.jsonl").count() == 1 and readers.read_binaries(spark, str(tmp_path), "*.jsonl").count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b|", None), (1, "a", "x")], "z int, a string, m string")
    writers.write_jsonl(df, str(tmp_path / "out"), ["z"], one_file=True)
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":"a","m":"x","z":1}', '{"a":"b|","m":null,"z":2}']
    assert writers.markdown_table(df).splitlines()[2] == "| 2 | b\\| |  |"
    with pytest.raises(ValueError):
        writers.markdown_table(df, 1)
    with pytest.raises(ValueError):
        writers.inside(str(tmp_path), "../x")
    root = str(tmp_path / "site")
    writers.write_all(root, {"a.json": lambda p: writers.write_json({"v": 1}, p)})

    def fail(stage):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        writers.write_all(root, {"a.json": lambda p: writers.write_json({"v": 2}, p)}, fail)
    assert json.load(open(root + "/a.json")) == {"v": 1} and os.listdir(root) == ["a.json"]
    chunks = spark.createDataFrame([(1, "t", None, "x x")], "chunk_row int, title string, heading string, content string")
    writers.write_index(chunks, str(tmp_path / "index"), buckets=4)
    assert {(r.term, r.tf) for r in spark.read.parquet(str(tmp_path / "index/postings")).collect()} == {("t", 1), ("x", 2)}


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 5), "a"), (dt.datetime(2024, 1, 1, 0, 55), "a"), (dt.datetime(2024, 1, 1, 1, 1), "b"), (None, "a")], "ts timestamp_ntz, event_type string")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = flows.action_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = sorted((r.action, r.n_events) for r in spark.table("counts").collect())
    assert got == [("a", 2), ("b", 1)] == sorted((r.action, r.n_events) for r in flows.action_counts(events).collect())
    rules = lambda b: b.where("ts is null").select(*graph.issue("high", "NO_TIME", "event_type", "ts", F.lit("m")))
    for _ in range(2):
        flows.validated(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), rules, str(tmp_path / "issues"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "issues")).count() == 1
    assert flows.first_seen(events, "event_type", "ts").where("event_type = 'a'").first().first_seen == dt.datetime(2024, 1, 1, 0, 5)


def test_views(spark, small):
    e = spark.read.parquet(small + "/entities.parquet")
    flat = view.flat_records(e)
    assert flat.where("effective_to is null or status is null").count() == 0
    latest = view.latest_records(flat)
    assert latest.count() == e.where("id is not null").select("id").distinct().count() and view.latest_records(flat.limit(0)).count() == 0
    row = spark.createDataFrame([(["b", " a ", "b", None, ""], None)], "x array<string>, y array<string>").select(norm.ordered_distinct("x").alias("x"), norm.text_list("y").alias("y")).first()
    assert row.x == ["b", "a"] and row.y == []
    labels = spark.createDataFrame([(["law 1", "case", "law 2", "?"],)], "x array<string>").select(text.support_labels("x", {"L": ("law",), "C": ("case",)}, "other").alias("l")).first().l
    assert labels == ["L", "C", "other"]
    toc = spark.range(1).select(text.toc_entries(F.lit('<h1 id="t">T</h1><h2 class="x" id="a">A <b>b</b></h2>')).alias("t")).first().t
    assert [(r.id, r.label) for r in toc] == [("a", "A b")]
    links = spark.createDataFrame([(["[[a#h|b]] and [[c]]", "plain", "https://x", None],)], "x array<string>").select(text.wiki_targets("x").alias("w")).first().w
    assert links == ["a", "c", "plain"]
