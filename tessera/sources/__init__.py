"""Datum sources and sinks with declared schemas; nothing is inferred, so scans read only what is asked for."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import SchemaError, Types


def spark_schema(schema: Any) -> T.StructType:
    """The columns of a schema: a record's fields, or one column `value`."""
    types = Types()
    types.declare(schema)
    kind = types.spark(schema)
    return kind if isinstance(kind, T.StructType) else T.StructType([T.StructField("value", kind)])


def read_json(spark: SparkSession, path: str, schema: Any) -> DataFrame:
    """One JSON datum a line; a tagged union {"double": 3.0} is its value. A line that doesn't fit is an error."""
    kind = spark_schema(schema)
    line = F.col("value")
    types = Types()
    types.declare(schema)
    for tag in _tags(types, schema):
        line = F.regexp_replace(line, rf'\{{\s*"{tag}"\s*:\s*("(?:[^"\\]|\\.)*"|[-+.0-9eE]+|true|false)\s*\}}', "$1")
    rows = spark.read.text(path)
    record = types.resolve(schema)
    if isinstance(record, dict) and record.get("type") == "record":
        return rows.select(F.from_json(line, kind, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    whole = F.concat(F.lit('{"value":'), line, F.lit("}"))
    return rows.select(F.from_json(whole, kind, {"mode": "FAILFAST"}).alias("d")).select("d.*")


def _tags(types: Types, schema: Any) -> list[str]:
    found: set[str] = set()

    def walk(s: Any) -> None:
        if isinstance(s, list):
            found.update(m for m in s if isinstance(m, str) and m in ("boolean", "int", "long", "float", "double", "string"))
            for m in s:
                walk(m)
        elif isinstance(s, dict):
            for v in s.values():
                if isinstance(v, (dict, list)):
                    walk(v)

    walk(schema)
    return sorted(found)


def read_csv(spark: SparkSession, path: str, schema: Any, header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=spark_schema(schema), header=header, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue="null", enforceSchema=False)


def read_parquet(spark: SparkSession, path: str, schema: Any = None) -> DataFrame:
    return spark.read.parquet(path) if schema is None else spark.read.schema(spark_schema(schema)).parquet(path)


def read_avro(spark: SparkSession, path: str) -> DataFrame:
    """Needs Spark's Avro package on the class path."""
    return spark.read.format("avro").load(path)


def write_json(df: DataFrame, path: str, name: str | None = None) -> None:
    """One JSON datum a line: the column `name` alone, or whole rows."""
    if name is None:
        df.write.json(path, ignoreNullFields=False)
        return
    text = F.col(name)
    kind = df.schema[name].dataType
    text = F.to_json(text) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else F.regexp_extract(F.to_json(F.struct(text.alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":(.*)\}$', 1)
    df.select(text.alias("value")).write.text(path)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """Records of primitives only; null is written as `null`."""
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            raise SchemaError(f"field {f.name} is no primitive")
    df.write.csv(path, header=header, nullValue="null")


def read_document(spark: SparkSession, path: str) -> dict:
    """A document from any store that Spark reads."""
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
