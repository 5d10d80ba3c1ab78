"""Column expressions over values whose shape differs from row to row, and over nested schemas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, StringType, StructType


def got(json: Column, path: str, default: str = "") -> Column:
    """What lies at a path of a JSON text, as a string; default where it isn't there, is null, or the text is no JSON."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(json), path, "string"), F.lit(default))


def first_of(v: Column) -> Column:
    """The first element of a list, anything else as it is."""
    is_list = F.schema_of_variant(v).startswith("ARRAY")
    return F.when(is_list, F.try_variant_get(v, "$[0]", "variant")).otherwise(v)


def tolerant_text(v: Column, key: str = "text") -> Column:
    """Text of a variant that may be a string, a list of strings (joined by blanks), an object (its key's text) or missing (empty)."""
    kind = F.schema_of_variant(v)
    listed = F.array_join(F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array().cast("array<string>")), " ")
    inside = F.try_variant_get(v, f"$.{key}", "string")
    plain = F.try_variant_get(v, "$", "string")
    return F.coalesce(F.when(v.isNull() | F.is_variant_null(v), F.lit("")).when(kind.startswith("ARRAY"), listed).when(kind.startswith("OBJECT"), inside).otherwise(plain), F.lit(""))


def is_text(v: Column) -> Column:
    """Whether a variant is a string: a test of its type, not of null."""
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def stringified(col: Column, kind: DataType) -> Column:
    """col with every primitive, at any depth and in keys too, as a string (booleans as True and False); nulls stay."""
    if isinstance(kind, StructType):
        return F.when(col.isNotNull(), F.struct(*[stringified(col[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, ArrayType):
        return F.transform(col, lambda x: stringified(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(F.transform_keys(col, lambda k, _: stringified(k, kind.keyType)), lambda _, v: stringified(v, kind.valueType))
    if isinstance(kind, BooleanType):
        return F.initcap(col.cast("string"))
    return col if isinstance(kind, StringType) else col.cast("string")
