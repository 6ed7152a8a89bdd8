"""Projections of nested and flat records, number links, registries and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import quality, resolve, view
from tessera.plans import reference_queries


def test_authorities(spark):
    schema = "n int, records array<struct<target_id:string,role:string>>, p string, s array<string>"
    df = spark.createDataFrame([(1, [(" a ", "primary")], "x", ["y"]), (2, None, " p ", ["s", "p", None, "s", ""]), (3, None, None, None), (4, [], "x", None)], schema)
    rec = view.authority_records("records", "p", "s")
    got = {r.n: ([tuple(x) for x in r.a], r.t) for r in df.select("n", rec.alias("a"), view.authority_target_ids(rec).alias("t")).collect()}
    assert got == {1: ([("a", "primary")], ["a"]), 2: ([("p", "primary"), ("s", "supporting")], ["p", "s"]), 3: ([], []), 4: ([], [])}


def test_conflicts_and_provenance(spark):
    schema = "n int, c array<struct<conflict_id:string,type:string,status:string,note:string>>, k string, s string, o string, own array<string>, e array<struct<source_id:string>>, m map<string,string>, title string"
    rows = [(1, [("c1", "t", "open", ""), None], "k", "s", "o", [" a "], [("b",)], {"title": "T2", "other": "x"}, "T"), (2, None, "k", None, "o", [], [("b",), ("b",), (None,)], None, "T"), (3, None, " ", None, None, None, None, {}, None)]
    df = spark.createDataFrame(rows, schema)
    out = df.select("n", view.conflict_records("c", "k", "s", "o").alias("c"), view.source_ids("own", F.col("e")).alias("i"), view.availability("o").alias("v")).collect()
    got = {r.n: ([x.conflict_id for x in r.c], r.i, r.v) for r in out}
    assert got[1] == (["c1"], ["a"], "not_applicable") and got[2] == (["legacy-conflict"], ["b"], "not_applicable") and got[3][0] == []
    assert [r.title for r in view.shadowed(df, "m", ["title"]).orderBy("n").collect()] == ["T2", "T", None]
    assert spark.createDataFrame([("available",)], "o string").select(view.availability("o").alias("v")).first().v == "complete"


def test_orders(spark):
    df = spark.createDataFrame([("b", "2024", "rule"), ("a", "2024", "x"), ("c", "2025", "case"), ("d", None, None)], "title string, sort_date string, t string")
    assert [r.title for r in df.orderBy(*view.archive_order()).collect()] == ["c", "a", "b", "d"]
    assert [r.title for r in df.orderBy(view.type_rank("t", ["case", "rule"]), "title").collect()] == ["c", "b", "a", "d"]


def test_numbers(spark):
    recs = spark.createDataFrame([("a", "2013다12"), ("b", " 2014다7 "), ("c", ""), ("d", None), ("e", "2013다12")], "entity_id string, number string")
    texts = spark.createDataFrame([(1, "see 2013다12 and 2013다12, 2014다7"), (2, "2013다123"), (3, None)], "row int, t string")
    got = sorted((r.row, r.entity_id) for r in resolve.number_links(recs, "number", texts, "t", "row", r"\d{4}다\d+").collect())
    assert got == [(1, "a"), (1, "b"), (1, "e")]
    row = spark.range(1).select(text.decision_number(F.lit(" 2013 다 12 (en banc) ")).alias("n"), text.body_sections(F.lit("feat: x\n\nWhy: y\n- a: b\nHow to: z")).alias("s")).first()
    assert row.n == "2013다12" and row.s == ["feat", "Why", "How to"]


def test_needles_and_heading_anchors(spark, tmp_path):
    rows = [(1, "see 2013 다 12", "2013다12", None, None), (2, "the CIVIL  Code, art. 1", "", " ", "Civil code"), (3, "Strasse", None, None, "STRAßE"), (4, None, "1", "1", "1"), (5, "other", "", None, "2013"), (6, "no. A-7", None, "a - 7", "x")]
    related = spark.createDataFrame(rows, "row int, t string, case_number string, document_number string, title string")
    got = resolve.needle_links(related, ["case_number", "document_number", "title"], "t")
    assert sorted(r.row for r in got.collect()) == [1, 2, 3, 6]
    heads = "# [[page#x|My label]]\n## [link](http://u) `a`<br>b\n### **!**\nno\n# Plain\r"
    spark.createDataFrame([(1, heads)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.pos: r.anchor for r in reference_queries.heading_anchors(spark, str(tmp_path)).collect()}
    assert found == {0: "my-label", 1: "link-a-b", 2: "section", 4: "plain"}


def test_registry(spark):
    reg = spark.createDataFrame([("a", "p/a", []), ("b", "p/b", ["old"]), ("old", "p/o", None), ("gone", "p/g", [])], "id string, path string, aliases array<string>")
    now = spark.createDataFrame([("a", "p/a"), ("b", "q/b"), ("new", "p/n")], "id string, path string")
    assert sorted((r.id, r.verdict) for r in quality.registry_drift(reg, now).collect()) == [("b", "path changed"), ("gone", "removed"), ("new", "missing")]
    files = quality.manifest(spark.createDataFrame([("raw/a.pdf", b"x"), ("raw/b.pdf", b"y")], "path string, content binary"))
    ids = spark.createDataFrame([("raw/a.pdf", "s1", 1), ("raw/a.pdf", "s2", 2), ("raw/b.pdf", None, 1)], "path string, source_id string, ordinal int")
    got = {r.path: r.source_id for r in quality.with_source_ids(files, ids).collect()}
    assert got["raw/a.pdf"] == "s2" and got["raw/b.pdf"].startswith("raw-")
