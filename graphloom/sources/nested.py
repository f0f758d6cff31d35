"""Nested records as rows: every leaf of a JSON text with its path, to any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import staged

#: What a variant's schema calls a leaf, and what it is called here.
_KINDS = {"VOID": "null", "STRING": "string", "BOOLEAN": "boolean"}


def leaves(df: DataFrame, json_col: str, *keys: str) -> DataFrame:
    """(keys, path, type, value): a row for each leaf of the records in ``json_col``.

    Paths begin with $; a name of other signs than letters, digits and underscores is quoted. Types are string, number, boolean,
    null, object and array; only empty objects and arrays are leaves. A null value has a null text. Texts that
    are null or no JSON have no leaves. One round for each level of the deepest record; a round holds what has deeper levels only.
    """
    spark = df.sparkSession
    rows = df.select(*[F.col(k) for k in keys], F.lit("$").alias("path"), F.try_parse_json(json_col).alias("v")).where("v IS NOT NULL")
    found = None
    while True:
        kind = F.regexp_extract(F.schema_of_variant("v"), r"^[A-Z]+", 0)
        text = F.to_json("v")
        empty = text.isin("{}", "[]")
        inner = kind.isin("OBJECT", "ARRAY") & ~empty
        rows = staged(rows.select(*keys, "path", F.when(inner, F.lit("inner")).otherwise(kind).alias("kind"), F.when(inner, F.lit(None)).otherwise(F.when(kind.isin("OBJECT", "ARRAY"), text).otherwise(F.col("v").cast("string"))).alias("value"), text.alias("json")), "leaves")
        named = F.col("kind")
        for name, own in _KINDS.items():
            named = F.when(F.col("kind") == name, own).otherwise(named)
        named = F.when(named.isin("null", "string", "boolean"), named).when(named.isin("OBJECT", "ARRAY"), F.lower(named)).otherwise("number")
        part = rows.where("kind <> 'inner'").select(*keys, "path", named.alias("type"), "value")
        found = part if found is None else found.union(part)
        deeper = rows.where("kind = 'inner'")
        if not deeper.take(1):
            return found
        deeper = deeper.select(*keys, "path", F.parse_json("json").alias("v"))
        chosen = ", ".join(f"r.`{k}`" for k in keys)
        step = spark.sql(f"SELECT {chosen}{',' if keys else ''} r.path, t.pos, t.key, t.value AS v FROM {{rows}} r, LATERAL variant_explode(r.v) t", rows=deeper)
        name = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("key").rlike("^[A-Za-z0-9_]+$"), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit('."'), F.col("key"), F.lit('"')))
        rows = step.select(*keys, F.concat("path", name).alias("path"), "v")


def flattened(df: DataFrame, json_col: str, paths: dict[str, str], *keys: str) -> DataFrame:
    """(keys, a column for each name): the values at the given paths of each record, as texts; null where there is none."""
    parsed = df.select(*[F.col(k) for k in keys], F.try_parse_json(json_col).alias("v"))
    return parsed.select(*keys, *[F.try_variant_get("v", path, "string").alias(name) for name, path in paths.items()])
