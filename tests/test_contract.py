"""Schema contracts, nested values and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import values
from tessera.operators import checks, contract

SCHEMA = {
    "required": ["id", "kind", "lost"], "additionalProperties": False,
    "properties": {
        "schema_version": {"const": "1.4"}, "id": {"$ref": "#/$defs/id"}, "kind": {"enum": ["a", "b"]}, "tags": {"type": "array", "items": {"enum": ["x"]}},
        "level": {"type": ["integer", "null"]}, "entity_type": {"type": "string"}, "extra": {"type": "object"},
    },
    "allOf": [{"if": {"properties": {"entity_type": {"const": "rule"}}}, "then": {"required": ["level", "gone"]}}],
    "$defs": {"id": {"type": "string", "minLength": 1}},
}


def test_schema_fields():
    fields = {f.name: f for f in contract.schema_fields(SCHEMA)}
    assert fields["id"] == checks.Field("id", "text", True, False) and fields["level"] == checks.Field("level", "int", null_allowed=True)
    assert fields["tags"].kind == "list" and fields["extra"].kind == "map" and fields["kind"].required
    assert contract.required_by_type(SCHEMA) == {"rule": ["level", "gone"]} and contract.enumerations(SCHEMA) == {"kind": ["a", "b"], "tags": ["x"]}


def test_drift(spark):
    got = sorted((r.code, r.field) for r in contract.contract_drift(spark, SCHEMA, {"kind": ["a", "c"]}, "1.5").collect())
    assert got == [
        ("SCHEMA_REQUIRED_UNKNOWN", "lost"), ("SCHEMA_TYPE_REQUIRED_UNKNOWN", "gone"), ("SCHEMA_VERSION_DRIFT", "schema_version"),
        ("SCHEMA_VOCAB_DRIFT", "kind"), ("SCHEMA_VOCAB_UNDECLARED", "tags"),
    ]
    assert contract.contract_drift(spark, {"properties": {}}, {}).count() == 0


def test_schema_issues(spark):
    schema = {**SCHEMA, "required": ["id", "kind"]}
    rows = ['{"id": "x", "kind": "a", "level": null}', '{"id": "", "kind": "z", "level": "5"}', '{"entity_type": "rule", "odd": 1}', "[1]"]
    df = spark.createDataFrame([(str(k), r) for k, r in enumerate(rows)], "p string, j string").select("p", F.parse_json("j").alias("r"))
    got = sorted((r.path, r.code, r.field) for r in contract.schema_issues(df, "r", "p", schema).collect())
    assert got == [
        ("1", "RECORD_FIELD_BLANK", "id"), ("1", "RECORD_FIELD_TYPE", "level"), ("1", "RECORD_VALUE", "kind"),
        ("2", "RECORD_FIELD_MISSING", "gone"), ("2", "RECORD_FIELD_MISSING", "id"), ("2", "RECORD_FIELD_MISSING", "kind"), ("2", "RECORD_FIELD_MISSING", "level"),
        ("2", "RECORD_FIELD_UNKNOWN", "odd"), ("3", "RECORD_ITEM_TYPE", ""),
    ]


def test_values(spark):
    df = spark.createDataFrame([('{"a": [1, {"b": "x"}], "c": null, "d": true, "e": ""}', "2024-07-01", "https://www.law.example/x"), (None, "soon", None), ("{", None, "http://other.example")], "j string, d string, u string")
    rows = df.select(values.leaf_texts("j").alias("l"), values.dotted_date("d").alias("d"), values.host_label("u", {"law.example": "law"}, "web").alias("h")).collect()
    assert [tuple(r) for r in rows] == [(["1", "x", "true"], "2024. 7. 1.", "law"), ([], "soon", "web"), ([], None, "web")]
