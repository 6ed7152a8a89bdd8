"""Constraint tables from a JSON Schema and a vocabulary: what a record must have, and where the two differ.

Schemas and vocabularies are small curated documents, read on the driver; what
is derived from them is applied to records by ``operators.checks``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .checks import Field, field_issues
from .graph import issue

_KINDS = {"string": "text", "array": "list", "object": "map", "integer": "int", "number": "number", "boolean": "bool"}


def _resolved(node: dict, schema: dict) -> dict:
    """A node with its local reference followed."""
    while "$ref" in node:
        target: dict = schema
        for part in node["$ref"].removeprefix("#/").split("/"):
            target = target[part]
        node = {**target, **{k: v for k, v in node.items() if k != "$ref"}}
    return node


def _types(node: dict) -> list[str]:
    types = node.get("type", [])
    return [types] if isinstance(types, str) else list(types)


def schema_fields(schema: dict) -> list[Field]:
    """Fields of a closed object schema; kinds of several types take the first that is not null."""
    required = set(schema.get("required", []))
    out = []
    for name, node in schema.get("properties", {}).items():
        node = _resolved(node, schema)
        types = _types(node) or [{str: "string", int: "integer", bool: "boolean"}[type(v)] for v in [node.get("const", (node.get("enum") or [""])[0])]]
        kinds = [_KINDS[t] for t in types if t in _KINDS]
        out.append(Field(name, kinds[0] if kinds else "text", name in required, node.get("minLength", 0) == 0, "null" in types))
    return out


def required_by_type(schema: dict, discriminator: str = "entity_type") -> dict[str, list[str]]:
    """Further required fields per value of the discriminator, from the schema's if-then rules."""
    out: dict[str, list[str]] = {}
    for rule in schema.get("allOf", []):
        condition = rule.get("if", {}).get("properties", {}).get(discriminator, {})
        values = [condition["const"]] if "const" in condition else condition.get("enum", [])
        for v in values:
            out.setdefault(v, []).extend(rule.get("then", {}).get("required", []))
    return out


def enumerations(schema: dict) -> dict[str, list[str]]:
    """field -> allowed values, of the top level and of the elements of arrays."""
    out = {}
    for name, node in schema.get("properties", {}).items():
        node = _resolved(node, schema)
        inner = _resolved(node.get("items", {}), schema) if isinstance(node.get("items"), dict) else {}
        for n in (node, inner):
            if "enum" in n:
                out[name] = [v for v in n["enum"] if isinstance(v, str)]
    return out


def contract_drift(spark: SparkSession, schema: dict, vocabulary: dict[str, list[str]], version: str | None = None) -> DataFrame:
    """Issues of a schema that disagrees with its vocabulary or with itself."""
    rows = []
    properties = schema.get("properties", {})
    if version is not None and properties.get("schema_version", {}).get("const") != version:
        rows.append(("SCHEMA_VERSION_DRIFT", "schema_version", str(properties.get("schema_version", {}).get("const"))))
    rows += [("SCHEMA_REQUIRED_UNKNOWN", f, f) for f in schema.get("required", []) if f not in properties]
    for kind, fields in required_by_type(schema).items():
        rows += [("SCHEMA_TYPE_REQUIRED_UNKNOWN", f, kind) for f in fields if f not in properties]
    for name, values in enumerations(schema).items():
        if name not in vocabulary:
            rows.append(("SCHEMA_VOCAB_UNDECLARED", name, ""))
        elif set(values) != set(vocabulary[name]):
            rows.append(("SCHEMA_VOCAB_DRIFT", name, ", ".join(sorted(set(values) ^ set(vocabulary[name])))))
    df = spark.createDataFrame(rows, "code string, field string, message string")
    return df.select(F.lit("critical").alias("severity"), "code", F.lit("schema").alias("path"), "field", "message")


def schema_issues(records: DataFrame, record: str, path: str, schema: dict, prefix: str = "RECORD", discriminator: str = "entity_type") -> DataFrame:
    """Issues of VARIANT records against a schema: types, presence, unknown keys, fields required by type, values."""
    base = field_issues(records, record, path, schema_fields(schema), prefix, schema.get("additionalProperties") is False)
    kind = F.try_variant_get(F.col(record), f"$.{discriminator}", "string")
    keys = F.map_keys(F.try_variant_get(F.col(record), "$", "map<string,variant>"))
    by_type: Column = F.array().cast("array<string>")
    for value, fields in required_by_type(schema, discriminator).items():
        by_type = F.when(kind == value, F.array_except(F.array(*map(F.lit, fields)), keys)).otherwise(by_type)
    missing = records.select(F.col(path).alias("path"), F.explode(by_type).alias("field"))
    out = base.unionByName(missing.select(*issue("high", f"{prefix}_FIELD_MISSING", "path", "", F.lit("required by its type"))[:3], "field", F.lit("required by its type").alias("message")))
    for name, values in enumerations(schema).items():
        value = F.try_variant_get(F.col(record), f"$.{name}", "string")
        wrong = records.where(value.isNotNull() & ~value.isin(*values))
        if dict(schema["properties"]).get(name, {}).get("type") != "array":
            out = out.unionByName(wrong.select(*issue("high", f"{prefix}_VALUE", path, name, value)))
    return out
