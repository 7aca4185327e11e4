"""Record schemas as values, their byte layout, and their Spark types."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T


class SchemaError(ValueError):
    """A schema that cannot be meant."""


@dataclass(frozen=True)
class FieldSpec:
    """A field: a scalar type, or `record` with fields.

    dims: an entry for each dimension of a vector, None (any length), a number, or the
    name of the field with the length. condition: (column, operator, literal, whether it
    must hold) of a conditional field.
    """

    name: str
    type: str
    args: tuple[int, ...] = ()
    fields: tuple[FieldSpec, ...] = ()
    dims: tuple[int | str | None, ...] = ()
    nullable: bool = True
    delimiter: str | None = None
    format: str | None = None
    picture: str | None = None
    null_indicator: str | None = None
    default: Any = None
    encoding: str | None = None
    annotations: tuple[tuple[str, str], ...] = ()
    alias: str | None = None
    condition: tuple[str, str, Any, bool] | None = None
    comment: str | None = None
    offset: int | None = None
    length: int | None = None

    @property
    def depends_on(self) -> str | None:
        return next((d for d in self.dims if isinstance(d, str)), None)


@dataclass(frozen=True)
class RecordSpec:
    """A named record; layout is fixed, delimited, mixed or empty for none."""

    name: str
    fields: tuple[FieldSpec, ...]
    encoding: str | None = None
    layout: str | None = None
    record_length: int | None = None
    comment: str | None = None
    notes: tuple[str, ...] = field(default=(), compare=False)

    def field(self, name: str) -> FieldSpec:
        return next(f for f in self.fields if f.name == name)


#: Bytes of types whose width isn't an argument; of text, pictures, packed and binary numbers see width().
WIDTHS = {"integer": 4, "long": 8, "float": 4, "double": 8, "boolean": 1, "date": 10, "datetime": 19}


def width(f: FieldSpec) -> int | None:
    """Bytes of one value in a fixed layout, None if they aren't fixed."""
    if f.fields:
        parts = [total_width(x) for x in f.fields]
        return None if None in parts else sum(parts)  # type: ignore[arg-type]
    if f.delimiter is not None:
        return None
    if f.type == "decimal":
        if not f.args:
            return None
        notes, n = dict(f.annotations), f.args[0]
        if f.encoding == "packed":
            return n // 2 + 1
        if notes.get("usage") == "binary":
            return 2 if n <= 4 else 4 if n <= 9 else 8
        return n + ("sign" in notes)  # a sign of its own is a character more
    if f.type in ("string", "binary"):
        wide = dict(f.annotations).get("charset") == "UTF-16BE"
        return f.args[0] * (2 if wide else 1) if f.args else None
    if f.type in ("date", "datetime") and f.format:
        return len(f.format)
    return f.args[0] if f.args else WIDTHS.get(f.type)


def total_width(f: FieldSpec) -> int | None:
    one = width(f)
    for d in f.dims:
        if not isinstance(d, int) or one is None:
            return None
        one *= d
    return one


def with_layout(r: RecordSpec) -> RecordSpec:
    """r with layout, record_length and the offsets of a fixed layout."""

    def leaves(fields: tuple[FieldSpec, ...]):
        for f in fields:
            yield from leaves(f.fields) if f.fields else [f]

    def place(fields: tuple[FieldSpec, ...], at: int) -> tuple[tuple[FieldSpec, ...], int]:
        out = []
        for f in fields:
            n = total_width(f) or 0
            inner = place(f.fields, at)[0] if f.fields else ()
            out.append(replace(f, offset=at, length=n, fields=inner))
            at += n
        return tuple(out), at

    all_ = list(leaves(r.fields))
    if not all_:
        return replace(r, layout="empty")
    fixed = [width(f) is not None for f in all_]
    delimited = [f.delimiter is not None for f in all_]
    if all(total_width(f) is not None for f in r.fields):
        fields, n = place(r.fields, 0)
        return replace(r, layout="fixed", record_length=n, fields=fields)
    if all(delimited):
        return replace(r, layout="delimited")
    return replace(r, layout="mixed" if any(delimited) and any(fixed) else "delimited" if any(delimited) else "stream")


def spark_type(f: FieldSpec, lossy: bool = False) -> T.DataType:
    """The type of a field. lossy: decimals as doubles, dates and times as strings."""
    if f.fields or f.type == "record":
        t: T.DataType = struct_type(f.fields, lossy)
    elif f.type == "integer":
        t = {1: T.ByteType(), 2: T.ShortType(), 4: T.IntegerType(), 8: T.LongType()}.get(f.args[0] if f.args else 4)  # type: ignore[assignment]
        if t is None:
            raise SchemaError(f"{f.name}: integer({f.args[0]}) isn't 1, 2, 4 or 8 bytes")
    elif f.type == "float":
        t = T.DoubleType() if f.args[:1] == (8,) else T.FloatType()
    elif f.type == "decimal":
        if lossy:
            t = T.DoubleType()
        else:
            p, s = (f.args[0] if f.args else 38), (f.args[1] if len(f.args) > 1 else 0)
            if s > p:
                raise SchemaError(f"{f.name}: decimal({p},{s}) has a scale above its precision")
            t = T.DecimalType(min(p, 38), s)
    elif f.type in ("date", "datetime") and lossy:
        t = T.StringType()
    else:
        simple = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampType(), "binary": T.BinaryType()}
        if f.type not in simple:
            raise SchemaError(f"{f.name}: unknown type {f.type}")
        t = simple[f.type]
    for _ in f.dims:
        t = T.ArrayType(t, True)
    return t


_KEPT = ("delimiter", "format", "picture", "null_indicator", "default", "encoding", "alias", "comment", "offset", "length")


def struct_type(fields: tuple[FieldSpec, ...] | RecordSpec, lossy: bool = False) -> T.StructType:
    """The StructType, with what is no type in the fields' metadata."""
    fields = fields.fields if isinstance(fields, RecordSpec) else fields
    out = []
    for f in fields:
        meta = {k: v for k in _KEPT if (v := getattr(f, k)) is not None} if not lossy else {}
        if not lossy:
            meta |= {k: v for k, v in (("args", list(f.args)), ("dims", [str(d) for d in f.dims]), ("annotations", dict(f.annotations))) if v}
            if f.condition:
                meta["condition"] = [str(x) for x in f.condition]
        out.append(T.StructField(f.name, spark_type(f, lossy), f.nullable, meta))
    return T.StructType(out)


def resolve(schemas: dict[str, RecordSpec], name: str) -> RecordSpec:
    """By exact name, then without suffix, then the one that begins with it, then the one that it begins with.

    Several that begin alike are an error: which is meant can't be told.
    """
    if name in schemas:
        return schemas[name]
    stem = name.rsplit(".", 1)[0] if "." in name else name
    if stem in schemas:
        return schemas[stem]
    for found in ([n for n in schemas if n.lower().startswith(stem.lower())], [n for n in schemas if stem.lower().startswith(n.lower())]):
        if len(found) > 1:
            raise SchemaError(f"schema {name!r} may be any of {', '.join(found)}")
        if found:
            return schemas[found[0]]
    raise SchemaError(f"no schema {name!r} among {', '.join(schemas) or 'none'}")
