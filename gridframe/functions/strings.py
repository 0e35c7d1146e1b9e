"""Text and bytes in nested columns, comparison of nested values, names from templates, prefixed units."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Decimal prefixes of units.
PREFIXES = {
    "yotta": 1e24, "zetta": 1e21, "exa": 1e18, "peta": 1e15, "tera": 1e12, "giga": 1e9, "mega": 1e6, "kilo": 1e3, "hecto": 1e2, "deca": 1e1,
    "deci": 1e-1, "centi": 1e-2, "milli": 1e-3, "micro": 1e-6, "nano": 1e-9, "pico": 1e-12, "femto": 1e-15, "atto": 1e-18, "zepto": 1e-21, "yocto": 1e-24,
}
#: Units in SI units.
UNITS = {"metre": 1.0, "gram": 1e-3, "second": 1.0, "hertz": 1.0, "kelvin": 1.0, "joule": 1.0, "watt": 1.0, "parsec": 3.0856775814913673e16, "year": 31557600.0, "electronvolt": 1.602176634e-19}


def unit(name: str) -> float:
    """The value of a unit in SI units, with at most one prefix: ``kilo_metre``, ``mega_parsec``."""
    *prefixes, base = name.split("_")
    if len(prefixes) > 1 or base not in UNITS or any(p not in PREFIXES for p in prefixes):
        raise AttributeError(name)
    return UNITS[base] * (PREFIXES[prefixes[0]] if prefixes else 1.0)


def converted(column: Column, kind: T.DataType, old: type, change: Any) -> Column:
    """The column with every leaf of type ``old`` changed, through structs, arrays and maps."""
    if isinstance(kind, old):
        return change(column)
    if isinstance(kind, T.StructType):
        return F.when(column.isNull(), F.lit(None)).otherwise(F.struct(*[converted(column[f.name], f.dataType, old, change).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: converted(x, kind.elementType, old, change))
    if isinstance(kind, T.MapType):
        keyed = F.transform_keys(column, lambda k, _: converted(k, kind.keyType, old, change))
        return F.transform_values(keyed, lambda _, v: converted(v, kind.valueType, old, change))
    return column


def ensure_unicode(df: DataFrame) -> DataFrame:
    """All bytes as UTF-8 text, in nested columns too; bytes that are no UTF-8 are an error."""
    return df.select(*[converted(F.col(f.name), f.dataType, T.BinaryType, lambda c: F.validate_utf8(c.cast("string"))).alias(f.name) for f in df.schema])


def ensure_bytes(df: DataFrame) -> DataFrame:
    """All text as UTF-8 bytes, in nested columns too."""
    return df.select(*[converted(F.col(f.name), f.dataType, T.StringType, lambda c: c.cast("binary")).alias(f.name) for f in df.schema])


def has_kind(kind: T.DataType, wanted: type) -> bool:
    """Whether a type is or holds the wanted one."""
    if isinstance(kind, T.StructType):
        return any(has_kind(f.dataType, wanted) for f in kind)
    if isinstance(kind, T.ArrayType):
        return has_kind(kind.elementType, wanted)
    if isinstance(kind, T.MapType):
        return has_kind(kind.keyType, wanted) or has_kind(kind.valueType, wanted)
    return isinstance(kind, wanted)


def all_equal(a: Any, b: Any) -> bool:
    """Equality through mappings, sequences and arrays; NaN equals itself."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(all_equal(v, b[k]) for k, v in a.items())
    if hasattr(a, "tolist") and hasattr(b, "tolist"):
        return all_equal(a.tolist(), b.tolist())
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(all_equal, a, b))
    return a == b or a != a and b != b


def from_template(template: str, **values: Column) -> Column:
    """A name put together from columns: ``{tag}`` stands for the column given as tag."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))
