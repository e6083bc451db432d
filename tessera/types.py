"""Avro-style schemas and their Spark types."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import types as T

#: Primitive type names.
PRIMITIVES = {
    "null": T.NullType(),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "bytes": T.BinaryType(),
}


class SchemaError(ValueError):
    """A schema or document that isn't well formed."""


class Types:
    """Named types of a document, usable before they are declared."""

    def __init__(self) -> None:
        self.named: dict[str, dict] = {}

    def declare(self, schema: Any) -> None:
        """Collect all named types anywhere in a schema or document."""
        if isinstance(schema, list):
            for s in schema:
                self.declare(s)
        elif isinstance(schema, dict):
            if schema.get("type") in ("record", "enum", "fixed") and "name" in schema:
                self.named[schema["name"]] = schema
            for s in schema.values():
                self.declare(s)

    def resolve(self, schema: Any) -> Any:
        if isinstance(schema, str) and schema in self.named:
            return self.named[schema]
        if isinstance(schema, dict) and isinstance(schema.get("type"), (dict, list)):
            return self.resolve(schema["type"])
        return schema

    def spark(self, schema: Any, seen: tuple[str, ...] = ()) -> T.DataType:
        """The Spark type; a union with null is a nullable type, other unions are structs of tagged members."""
        s = self.resolve(schema)
        if isinstance(s, list):
            members = [m for m in s if m != "null"]
            if len(members) == 1:
                return self.spark(members[0], seen)
            return T.StructType([T.StructField(self.tag(m), self.spark(m, seen), True) for m in members])
        kind = s["type"] if isinstance(s, dict) else s
        if kind in PRIMITIVES:
            return PRIMITIVES[kind]
        if kind == "array":
            return T.ArrayType(self.spark(s["items"], seen), True)
        if kind == "map":
            return T.MapType(T.StringType(), self.spark(s["values"], seen), True)
        if kind == "enum":
            return T.StringType()
        if kind == "fixed":
            return T.BinaryType()
        if kind == "record":
            if s["name"] in seen:
                raise SchemaError(f"recursive type {s['name']} can only be a constant model")
            return T.StructType([T.StructField(f["name"], self.spark(f["type"], (*seen, s["name"])), True) for f in s["fields"]])
        raise SchemaError(f"unknown type {json.dumps(schema)}")

    def tag(self, schema: Any) -> str:
        s = self.resolve(schema)
        return s if isinstance(s, str) else s.get("name", s["type"])

    def untag(self, value: Any, schema: Any) -> Any:
        """A JSON value with the tags of its unions removed, for from_json."""
        s = self.resolve(schema)
        if isinstance(s, list):
            if value is None:
                return None
            members = [m for m in s if m != "null"]
            if isinstance(value, dict) and len(value) == 1:
                (tag, inner), = value.items()
                for m in members:
                    if self.tag(m) == tag:
                        inner = self.untag(inner, m)
                        return inner if len(members) == 1 else {tag: inner}
            return self.untag(value, members[0]) if len(members) == 1 else value
        kind = s["type"] if isinstance(s, dict) else s
        if kind == "array":
            return [self.untag(v, s["items"]) for v in value]
        if kind == "map":
            return {k: self.untag(v, s["values"]) for k, v in value.items()}
        if kind == "record":
            return {f["name"]: self.untag(value.get(f["name"], f.get("default")), f["type"]) for f in s["fields"]}
        return value


def schema_from_spark(data_type: T.DataType, name: str = "Record") -> Any:
    """The Avro-style schema of a Spark type, nullable fields as unions with null."""
    for label, t in PRIMITIVES.items():
        if data_type == t:
            return label
    if isinstance(data_type, T.ArrayType):
        items = schema_from_spark(data_type.elementType, name + "_item")
        return {"type": "array", "items": [items, "null"] if data_type.containsNull else items}
    if isinstance(data_type, T.MapType):
        return {"type": "map", "values": schema_from_spark(data_type.valueType, name + "_value")}
    if isinstance(data_type, T.StructType):
        fields = []
        for f in data_type.fields:
            inner = schema_from_spark(f.dataType, f"{name}_{f.name}")
            fields.append({"name": f.name, "type": [inner, "null"] if f.nullable else inner})
        return {"type": "record", "name": name, "fields": fields}
    if isinstance(data_type, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return "double"
    raise SchemaError(f"no schema for {data_type}")
