"""Columns of any type as one text, for work that passes rows through Python, and back without loss.

JSON alone rounds timestamps, has no keys but texts and no decimals or special numbers; by the schema, such values become
whole numbers, texts and lists of entries first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted

_PLAIN = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _plain(kind: T.DataType) -> T.DataType:
    """The type that stands for a type in JSON."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f"f{i}", _plain(f.dataType)) for i, f in enumerate(kind)])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_plain(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.ArrayType(T.StructType([T.StructField("k", _plain(kind.keyType)), T.StructField("v", _plain(kind.valueType))]))
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return T.LongType()
    return kind if isinstance(kind, _PLAIN) else T.StringType()


def _there(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_there(value.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind))))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _there(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform(F.map_entries(value), lambda e: F.struct(_there(e["key"], kind.keyType).alias("k"), _there(e["value"], kind.valueType).alias("v")))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    return value if isinstance(kind, _PLAIN) else value.cast("string")


def _back(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_back(value.getField(f"f{i}"), f.dataType).alias(f.name) for i, f in enumerate(kind))))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _back(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(value, lambda e: F.struct(_back(e["k"], kind.keyType).alias("key"), _back(e["v"], kind.valueType).alias("value"))))
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(value)
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(value.cast("int"))
    if isinstance(kind, T.BinaryType):
        return F.unhex(value)
    return value if isinstance(kind, _PLAIN) else value.cast(kind)


def packed(df: DataFrame) -> Column:
    """One text that holds all columns of df."""
    return F.to_json(F.struct(F.lit(0).alias("none"), *(_there(F.col(quoted(f.name)), f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema))))


def unpacked(text: Column, schema: T.StructType) -> list[Column]:
    """The columns of packed() under their names."""
    held = F.from_json(text, T.StructType([T.StructField(f"c{i}", _plain(f.dataType)) for i, f in enumerate(schema)]))
    return [_back(held.getField(f"c{i}"), f.dataType).alias(f.name) for i, f in enumerate(schema)]
