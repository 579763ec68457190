"""128-bit fingerprints of rows, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.functions.names import quoted


def fingerprint(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of the whole row, which equal rows share and others do not.

    The hash function passes over NULLs, so each value is followed by whether it is one;
    nested values, in which NULLs may hide and maps cannot be hashed, are hashed as JSON.
    Among n different rows a pair of equal fingerprints has a chance of n^2 in 2^129:
    for 10^12 rows one in 10^14.
    """
    parts = []
    for field in df.schema:
        value = F.col(quoted(field.name))
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(F.struct(value.alias("c")), {"ignoreNullFields": "false"})
        parts += [value, value.isNull()]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)
