"""Types written without a session, so that workers can import the modules that use them."""

from __future__ import annotations

from pyspark.sql import types as T

STR, INT, DOUBLE, BOOL = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def array(of: T.DataType) -> T.ArrayType:
    return T.ArrayType(of)
