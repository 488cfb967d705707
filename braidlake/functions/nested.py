"""Nested names: fields below groups as one level of columns with compound names, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def flat_keys(values: dict, root: str = "") -> dict:
    """{"a": {"b": 1}} as {"a/b": 1}."""
    out = {}
    for k, v in values.items():
        name = f"{root}/{k}" if root else k
        out |= flat_keys(v, name) if isinstance(v, dict) else {name: v}
    return out


def field_paths(schema: StructType, root: str = "") -> list[str]:
    """Paths of all fields that aren't groups, such as observables/rmsd."""
    out = []
    for f in schema.fields:
        name = f"{root}/{f.name}" if root else f.name
        out += field_paths(f.dataType, name) if isinstance(f.dataType, StructType) else [name]
    return out


def flattened(df: DataFrame) -> DataFrame:
    """df with a column for each path of ``field_paths``."""
    return df.select(*(F.col(".".join(f"`{x}`" for x in p.split("/"))).alias(p) for p in field_paths(df.schema)))
