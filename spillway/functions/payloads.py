"""Nested payloads: numbers that JSON can't hold, and addresses that must not leave in the clear."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spillway.functions import scoring

_BYTE = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = rf"{_BYTE}(\.{_BYTE}){{3}}"
_GROUP = "[0-9A-Fa-f]{1,4}"


def _groups(least: int, most: int) -> str:
    return "" if most == 0 else f"({_GROUP}(:{_GROUP}){{{max(least - 1, 0)},{most - 1}}}){'?' if least == 0 else ''}"


def _sixes() -> list[str]:
    """Eight groups, or fewer around one double colon; a quad may stand for the last two."""
    whole = [_groups(8, 8), f"{_groups(6, 6)}:{_QUAD}"]
    short = [f"{_groups(n, n)}::{_groups(0, 7 - n)}" for n in range(8)]
    ended = [f"{_groups(n, n)}::({_GROUP}:){{0,{5 - n}}}{_QUAD}" for n in range(6)]
    return whole + short + ended


ADDRESS = f"^({'|'.join([_QUAD, *_sixes()])})(%[^%]+)?$"
_FOUR = f"^{_QUAD}$"


def is_address(text: Column) -> Column:
    """Whether the whole text is an address of either version; a zone may follow one of version 6."""
    return F.coalesce(F.rlike(text, F.lit(ADDRESS)) & (F.rlike(text, F.lit(_FOUR)) | F.contains(text, F.lit(":"))), F.lit(False))


def finite(value: Column, kind: T.DataType) -> Column:
    """``value`` of any nesting with null for every number that is not finite."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return scoring.finite_or_null(value)
    if isinstance(kind, T.StructType):
        made = F.struct(*[finite(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, x: finite(x, kind.valueType))
    return value


def texts_of(value: Column, kind: T.DataType) -> Column | None:
    """All texts of a payload, keys of maps included, as one array; None if its type has none."""
    if isinstance(kind, T.StringType):
        return F.array(value)
    parts: list[Column] = []
    if isinstance(kind, T.StructType):
        parts = [t for f in kind.fields if (t := texts_of(value.getField(f.name), f.dataType)) is not None]
    elif isinstance(kind, T.ArrayType):
        if texts_of(F.lit(None), kind.elementType) is not None:
            parts = [F.flatten(F.transform(value, lambda x: texts_of(x, kind.elementType)))]
    elif isinstance(kind, T.MapType):
        inner = [(F.map_keys(value), kind.keyType), (F.map_values(value), kind.valueType)]
        parts = [t for v, k in inner if (t := texts_of(v, T.ArrayType(k))) is not None]
    none = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(p, none) for p in parts]) if parts else None


def has_raw_address(value: Column, kind: T.DataType) -> Column:
    """Whether a text anywhere in the payload is, as a whole, an address; prose that mentions one is not."""
    texts = texts_of(value, kind)
    return F.lit(False) if texts is None else F.exists(texts, is_address)
