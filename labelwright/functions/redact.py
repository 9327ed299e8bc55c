"""Redaction of nested columns before they leave in a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What may stand neither in a field's name nor in a text, whatever the case: words of credentials, beginnings of paths.
FORBIDDEN = (
    "api_key", "api-key", "apikey", "authorization", "bearer ", "cookie", "password", "secret", "session_id", "session-id", "token",
    "/mnt/", "/home/", "/etc/", "/root/", "/var/lib/", "/opt/", "/usr/local/",
)
MARK = "[REDACTED]"


def forbidden(name: str) -> bool:
    return any(x in name.lower() for x in FORBIDDEN)


def unfit(c: Column) -> Column:
    """Whether a text holds anything forbidden; null for null."""
    low, out = F.lower(c), F.lit(False)
    for x in FORBIDDEN:
        out = out | F.contains(low, F.lit(x))
    return out


def _clean(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.when(unfit(c), F.lit(MARK)).otherwise(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _clean(x, kind.elementType))
    if isinstance(kind, T.MapType):
        kept = F.map_filter(c, lambda k, _: ~unfit(k.cast("string")))
        return F.transform_values(kept, lambda _, v: _clean(v, kind.valueType))
    if isinstance(kind, T.StructType):
        fields = [_clean(c[f.name], f.dataType).alias(f.name) for f in kind if not forbidden(f.name)]
        return F.when(c.isNotNull(), F.struct(*fields)) if fields else F.lit(None)
    return c


def redacted(df: DataFrame) -> DataFrame:
    """``df`` without fields and map entries whose name holds anything forbidden, at any depth; texts that hold it are replaced."""
    return df.select(*[_clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema if not forbidden(f.name)])
