"""Rule families and rewrites: one row that is right, one that breaks each rule, and nothing at all."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators import record_rules, rewrite, view


def codes(df):
    return sorted((r.path, r.code) for r in df.collect())


def test_evidence(spark):
    schema = "evidence_row int, entity_id string, evidence_id string, source_id string, locator string, supports array<string>, verified_on string, severity string"
    rows = [
        (1, "e", "v1", " S1 ", "p", ["c"], "2024-01-01", "x"), (2, "e", "", None, " ", [], "2024-1-1", "x"), (3, "e", "v1", "s9", "p", ["c", "c"], None, "x"),
        (4, "e", "v4", "s1", "p", None, "", "x"), (5, "e", "v5", "s1", "p", ["c", None], "", "x"),
    ]
    df, sources = spark.createDataFrame(rows, schema), spark.createDataFrame([("s1",), ("s1",), (None,)], "source_id string")
    assert codes(record_rules.evidence_rules(df, sources)) == [
        ("evidence/2", "DATE_INVALID"), ("evidence/2", "EVIDENCE_ID"), ("evidence/2", "EVIDENCE_LOCATOR"), ("evidence/2", "EVIDENCE_SOURCE"), ("evidence/2", "EVIDENCE_SUPPORTS"),
        ("evidence/3", "EVIDENCE_ID_DUPLICATE"), ("evidence/3", "EVIDENCE_SOURCE_UNKNOWN"), ("evidence/3", "EVIDENCE_SUPPORTS_DUPLICATE"),
        ("evidence/4", "EVIDENCE_SUPPORTS"), ("evidence/5", "EVIDENCE_SUPPORTS"),
    ]
    assert record_rules.evidence_rules(df.limit(0), sources.limit(0)).count() == 0


def test_relations(spark):
    rows = [(1, "e", "cites", "a", None), (2, "e", "cites", " A", "2024-13-01"), (3, "e", "bad", "zz", ""), (4, "e", None, None, None), (5, "e", "cites", " ", None)]
    df = spark.createDataFrame(rows, "relation_row int, entity_id string, relation_type string, target_id string, effective_on string")
    names = spark.createDataFrame([("a",)], "key string")
    vocab = spark.createDataFrame([("relation_type", "cites"), ("other", "bad")], "field string, code string")
    assert codes(record_rules.relation_rules(df, names, vocab)) == [
        ("relations/2", "DATE_INVALID"), ("relations/2", "RELATION_DUPLICATE"), ("relations/3", "RELATION_TARGET_BROKEN"), ("relations/3", "VOCAB_RELATION"),
        ("relations/4", "RELATION_TARGET"), ("relations/5", "RELATION_TARGET"),
    ]


def test_sources(spark):
    schema = "source_row int, source_id string, title string, publisher string, source_type string, jurisdiction string, authority_level int, location struct<kind:string,path:string,url:string>"
    ok = ("t", "p", "law", "KR", 1)
    rows = [
        (1, "s1", *ok, ("path", "raw/a", None)), (2, "s1", *ok, ("url", None, "https://a.example/x")), (3, "S 3", None, "p", "odd", "KR", 9, ("path", "raw/a", "ftp://x")),
        (4, "s4", *ok, ("path", "../b", None)), (5, "s5", "t", "p", "law", "KR", None, None),
    ]
    vocab = spark.createDataFrame([("source_type", "law")], "field string, code string")
    assert codes(record_rules.source_rules(spark.createDataFrame(rows, schema), vocab)) == [
        ("sources/1", "SOURCE_PATH_DUPLICATE"), ("sources/2", "SOURCE_ID_DUPLICATE"), ("sources/3", "SOURCE_AUTHORITY_LEVEL"), ("sources/3", "SOURCE_FIELD"),
        ("sources/3", "SOURCE_ID_FORMAT"), ("sources/3", "SOURCE_LOCATION"), ("sources/3", "SOURCE_PATH_DUPLICATE"), ("sources/3", "SOURCE_TYPE"), ("sources/3", "SOURCE_URL_INVALID"),
        ("sources/4", "SOURCE_PATH_ESCAPE"), ("sources/5", "SOURCE_AUTHORITY_LEVEL"), ("sources/5", "SOURCE_LOCATION"),
    ]


def test_qa(spark):
    schema = "qa_row int, id string, as_of string, question string, expected string, required_authority_ids array<string>, required_rule_ids array<string>, forbidden_claims array<string>"
    rows = [(1, "q", "2024-01-01", "?", "!", ["l"], ["R"], []), (2, "q", "soon", "", None, None, ["l", "zz"], [""]), (3, None, "2024-01-01", "?", "!", ["zz", " "], [], None)]
    targets = spark.createDataFrame([("l", "law"), ("r", "rule")], "key string, entity_type string")
    assert codes(record_rules.qa_rules(spark.createDataFrame(rows, schema), targets)) == [
        ("qa/2", "QA_AS_OF"), ("qa/2", "QA_FORBIDDEN_CLAIMS"), ("qa/2", "QA_ID_DUPLICATE"), ("qa/2", "QA_ID_LIST"), ("qa/2", "QA_REQUIRED_ID_NOT_RULE"), ("qa/2", "QA_TEXT"), ("qa/2", "QA_TEXT"),
        ("qa/2", "QA_UNKNOWN_RULE_ID"), ("qa/3", "QA_FORBIDDEN_CLAIMS"), ("qa/3", "QA_ID"), ("qa/3", "QA_ID_LIST"), ("qa/3", "QA_UNKNOWN_AUTHORITY_ID"),
    ]


def test_identity(spark):
    rows = [(1, "a", "t", ["x"], ["old"]), (2, "a", "t", ["x"], ["old"]), (3, "b", " ", ["x", "x", None], ["old", "a"]), (4, None, "t", None, None), (5, "claim:x", "t", [], [])]
    e = spark.createDataFrame(rows, "entity_row int, id string, title string, aliases array<string>, id_aliases array<string>")
    al = spark.createDataFrame([("old", "a"), ("new", "zz"), (None, "a")], "alias_id string, canonical_id string")
    assert codes(record_rules.identity_rules(e, al)) == [
        ("a", "DUPLICATE_ID"), ("a", "ID_ALIAS_IS_ID"), ("a", "ID_ALIAS_MAP_DRIFT"), ("entities/3", "DUPLICATE_LIST_VALUE"), ("entities/3", "FIELD_TYPE"), ("entities/3", "TITLE_MISSING"),
        ("entities/4", "ID_MISSING"), ("entities/5", "ID_INVALID"), ("new", "ID_ALIAS_CANONICAL_BROKEN"), ("old", "ID_ALIAS_COLLISION"), ("old", "ID_ALIAS_MAP_DRIFT"),
    ]
    assert record_rules.identity_rules(e.limit(0), al.limit(0)).count() == 0


def test_periods_and_verification(spark):
    chunks = spark.createDataFrame([(1, "2024-01-01", ""), (2, None, "x"), (3, "2024-02-01", "2024-01-01")], "chunk_row int, valid_from string, valid_until string")
    rules = spark.createDataFrame([(1, "2024-01-01", None, "1.0"), (2, "2024", "2024-01-01", "v"), (3, "2024-02-01", "2024-01-01", None)], "temporal_row int, applicable_from string, applicable_to string, rule_version string")
    assert codes(record_rules.temporal_rules(chunks, rules)) == [
        ("chunks/2", "DATE_INVALID"), ("chunks/2", "DATE_REQUIRED"), ("chunks/3", "TEMPORAL_ORDER"), ("temporal/2", "RULE_TEMPORAL_DATE"), ("temporal/2", "RULE_TEMPORAL_VERSION"),
        ("temporal/3", "RULE_TEMPORAL_ORDER"), ("temporal/3", "RULE_TEMPORAL_VERSION"),
    ]
    rows = [(1, ("2024-01-01", ["v"], ["m"])), (2, ("2024-01-01", [], None)), (3, ("x", ["v", "v", "w"], ["m", None, "n"])), (4, None)]
    e = spark.createDataFrame(rows, "entity_row int, verification struct<verified_on:string,verifier_ids:array<string>,methods:array<string>>")
    people = spark.createDataFrame([("v",)], "verifier_id string")
    vocab = spark.createDataFrame([("verification_method", "m")], "field string, code string")
    assert codes(record_rules.verification_rules(e, people, vocab)) == [
        ("entities/2", "VERIFICATION_METHOD_MISSING"), ("entities/2", "VERIFICATION_VERIFIER_MISSING"), ("entities/3", "VERIFICATION_DATE_INVALID"),
        ("entities/3", "VERIFICATION_METHODS_TYPE"), ("entities/3", "VERIFICATION_METHOD_INVALID"), ("entities/3", "VERIFIER_ID_DUPLICATE"), ("entities/3", "VERIFIER_UNKNOWN"),
    ]
    more = [(1, (None, ["v"], [], "")), (2, (None, [], ["m"], None)), (3, (None, None, None, "n")), (4, (None, ["V x"], ["source_cross_check"], " ")), (5, (None, [" "], None, ""))]
    e = spark.createDataFrame(more, "entity_row int, verification struct<verified_on:string,verifier_ids:array<string>,methods:array<string>,note:string>")
    assert codes(record_rules.verification_rules(e, people, vocab.union(spark.createDataFrame([("verification_method", "source_cross_check")], vocab.schema)))) == [
        ("entities/1", "VERIFICATION_METHOD_MISSING"), ("entities/2", "VERIFICATION_VERIFIER_MISSING"), ("entities/3", "VERIFICATION_VERIFIER_MISSING"),
        ("entities/4", "VERIFICATION_NOTE_MISSING"), ("entities/4", "VERIFIER_ID_INVALID"), ("entities/4", "VERIFIER_UNKNOWN"), ("entities/5", "VERIFIER_IDS_TYPE"),
    ]


def test_rewrites(spark, small):
    flat = view.flat_records(spark.read.parquet(small + "/entities.parquet"))
    nested = rewrite.nested_records(flat)
    again = nested.select("id", F.col("workflow.editorial_status").alias("s"), F.col("legal.validity.valid_until").alias("u"))
    assert again.where("u = '9999-12-31' or s = ''").count() == 0 and nested.count() == flat.count()
    assert rewrite.change_report(nested, nested, "id", ["workflow", "legal"]).count() == 0
    src = spark.createDataFrame([("a", ("k", "p", None)), ("b", ("k", " ", "u")), ("c", None)], "source_id string, location struct<kind:string,path:string,url:string>")
    assert [(r.location.kind, r.location.value) for r in rewrite.located_sources(src, False).collect()] == [("path", "p"), ("url", "u"), (None, None)]
    with pytest.raises(PySparkException):
        rewrite.located_sources(src).collect()
    v = spark.createDataFrame([(["Team A", "team-a", "x", None],), (None,)], "verified_by array<string>")
    got = [(r.mapped_ids, r.unmapped) for r in rewrite.mapped_verification(v, {"Team A": "team-a"}).collect()]
    assert got == [(["team-a"], ["x"]), ([], [])]
