"""Hive CREATE TABLE statements as record schemas."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from ..schema.dml import strip_comments, unescape
from ..schema.emit import emit_dml
from ..schema.spec import FieldSpec, RecordSpec, SchemaError, with_layout

# Scalar types with the type and width that they become.
SCALARS = {
    "tinyint": ("integer", (1,)), "smallint": ("integer", (2,)), "int": ("integer", (4,)), "integer": ("integer", (4,)), "bigint": ("integer", (8,)), "long": ("integer", (8,)),
    "float": ("float", (4,)), "real": ("float", (4,)), "double": ("float", (8,)), "boolean": ("integer", (1,)), "string": ("string", ()), "varchar": ("string", ()), "char": ("string", ()),
    "date": ("date", ()), "timestamp": ("datetime", ()), "binary": ("binary", ()), "decimal": ("decimal", (10, 0)), "numeric": ("decimal", (10, 0)), "dec": ("decimal", (10, 0)), "interval": ("string", ()),
}
TEXT_FORMATS = {"textfile", None}
_TOKEN = re.compile(r"\s+|(?P<string>'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\")|(?P<quoted>`(?:[^`]|``)+`)|(?P<word>[A-Za-z_0-9$]+)|(?P<op>[(),<>:;=.])")


@dataclass(frozen=True)
class HiveTable:
    name: str
    record: RecordSpec
    stored_as: str | None
    delimiter: str | None
    partitions: tuple[str, ...]
    location: str | None
    renames: dict[str, str]

    @property
    def dml(self) -> str:
        return emit_dml(self.record)


class _Ddl:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SchemaError(f"unexpected {text[at]!r} in the statement")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.i = 0
        self.renames: dict[str, str] = {}

    def is_(self, *words: str, ahead: int = 0) -> bool:
        k, t = self.tokens[min(self.i + ahead, len(self.tokens) - 1)]
        return k in ("word", "op") and t.lower() in words

    def take(self, *words: str) -> bool:
        """The words one after another, or nothing."""
        if all(self.is_(w, ahead=k) for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise SchemaError(f"expected {' '.join(words).upper()}, found {self.tokens[self.i][1] or 'the end'!r}")

    def string(self) -> str:
        k, t = self.tokens[self.i]
        if k != "string":
            raise SchemaError(f"expected a string, found {t or 'the end'!r}")
        self.i += 1
        return unescape(t[1:-1].replace("''", "'"))

    def identifier(self, rename: bool = True) -> str:
        k, t = self.tokens[self.i]
        if k not in ("word", "quoted"):
            raise SchemaError(f"expected a name, found {t or 'the end'!r}")
        self.i += 1
        raw = t[1:-1].replace("``", "`") if k == "quoted" else t
        name = re.sub(r"\W", "_", raw)
        name = f"_{name}" if not name or name[0].isdigit() else name
        if name != raw and rename:
            self.renames[raw] = name
        return name

    # -- types

    def type(self, name: str) -> FieldSpec:
        word = self.identifier(rename=False).lower()
        if word == "uniontype":
            raise SchemaError(f"{name}: UNIONTYPE isn't supported")
        if word == "array":
            self.need("<")
            item = self.type("item")
            self.need(">")
            return FieldSpec(name, "record", fields=(replace(item, dims=(None, *item.dims)),), comment="ARRAY")
        if word == "map":
            self.need("<")
            key = self.type("key")
            self.need(",")
            value = self.type("value")
            self.need(">")
            if key.fields:
                raise SchemaError(f"{name}: the key of a MAP must be primitive")
            return FieldSpec(name, "record", fields=(FieldSpec("map_entries", "record", fields=(key, value), dims=(None,)),), comment="MAP")
        if word == "struct":
            self.need("<")
            if self.is_(">"):
                raise SchemaError(f"{name}: an empty STRUCT")
            fields = []
            while True:
                inner = self.identifier()
                self.take(":")
                f = self.type(inner)
                if self.take("comment"):
                    self.string()
                fields.append(f)
                if self.take(">"):
                    break
                self.need(",")
            _distinct(fields, f"{name}: ")
            return FieldSpec(name, "record", fields=tuple(fields), comment="STRUCT")
        if word not in SCALARS:
            raise SchemaError(f"{name}: unknown type {word.upper()}")
        kind, args = SCALARS[word]
        comment = word.upper()
        if word == "timestamp" and self.take("with", "local", "time", "zone"):
            comment = "TIMESTAMP WITH LOCAL TIME ZONE"
        if word == "double":
            self.take("precision")
        if self.take("("):
            given = [int(self.identifier(rename=False).lstrip("_"))]
            while self.take(","):
                given.append(int(self.identifier(rename=False).lstrip("_")))
            self.need(")")
            args = (given[0], given[1] if len(given) > 1 else 0) if kind == "decimal" else tuple(given)
            comment += f"({','.join(map(str, given))})"
        if kind == "string" and args == (0,):
            raise SchemaError(f"{name}: {comment} has no length")
        if kind == "decimal" and not 0 <= args[1] <= args[0] <= 38:
            raise SchemaError(f"{name}: DECIMAL({args[0]},{args[1]}) isn't a type")
        return FieldSpec(name, kind, args, comment=comment)

    def columns(self) -> list[FieldSpec]:
        self.need("(")
        out = []
        while not self.take(")"):
            if self.is_("primary", "foreign", "constraint", "unique", "check"):
                depth = 0
                while depth or not self.is_(",", ")"):
                    depth += self.is_("(") - self.is_(")")
                    self.i += 1
            else:
                f = self.type(self.identifier())
                while not self.is_(",", ")"):
                    if self.take("comment"):
                        self.string()
                    elif self.take("not", "null"):
                        f = replace(f, nullable=False)
                    elif self.take("default"):
                        self.i += 1
                    else:
                        self.i += 1
                        if self.tokens[self.i][0] == "end":
                            raise SchemaError("missing )")
                out.append(f)
            self.take(",")
        return out


def _distinct(fields: list[FieldSpec], where: str = "") -> None:
    seen: dict[str, str] = {}
    for f in fields:
        if f.name.lower() in seen:
            raise SchemaError(f"{where}columns {seen[f.name.lower()]} and {f.name} differ in case at most")
        seen[f.name.lower()] = f.name


def _stamped(f: FieldSpec, delimiter: str) -> FieldSpec:
    if f.fields:
        return replace(f, fields=tuple(_stamped(x, delimiter) for x in f.fields))
    return replace(f, delimiter=delimiter) if f.type == "string" and not f.args else f


def import_hive(ddl: str, newline_field: bool = False) -> HiveTable:
    """The table of one CREATE TABLE with columns; other statements are errors.

    Partition columns follow the others. With a text format and a delimiter, strings
    carry it. Clauses without a bearing on the record are skipped, known or not.
    """
    d = _Ddl(strip_comments(ddl))
    if not d.is_("create"):
        raise SchemaError(f"{d.tokens[0][1].upper() or 'nothing'} isn't CREATE TABLE")
    d.i += 1
    while d.take("external") or d.take("temporary") or d.take("transactional"):
        pass
    if not d.is_("table"):
        raise SchemaError(f"CREATE {d.tokens[d.i][1].upper()} isn't CREATE TABLE")
    d.i += 1
    d.take("if", "not", "exists")
    name = d.identifier()
    while d.take("."):
        name = d.identifier()
    if d.is_("like"):
        raise SchemaError("CREATE TABLE LIKE has no columns")
    if d.is_("as"):
        raise SchemaError("CREATE TABLE AS SELECT has no columns")
    fields = d.columns()
    partitions: list[FieldSpec] = []
    stored, delimiter, location, text_rows = None, None, None, False
    while d.tokens[d.i][0] != "end" and not d.is_(";"):
        if d.take("partitioned", "by"):
            partitions = d.columns()
        elif d.take("fields", "terminated", "by"):
            delimiter = d.string()
        elif d.take("row", "format", "delimited"):
            text_rows = True
        elif d.take("stored", "as"):
            stored = d.identifier(rename=False).lower()
        elif d.take("stored", "by"):
            d.string()
            stored = "by_serde"
        elif d.take("location"):
            location = d.string()
        elif d.is_("as") and d.is_("select", ahead=1):
            raise SchemaError("CREATE TABLE AS SELECT isn't supported")
        else:
            d.i += 1
    _distinct([*fields, *partitions])
    if text_rows and stored in TEXT_FORMATS and delimiter is None:
        delimiter = "\x01"
    if delimiter is not None and stored in TEXT_FORMATS:
        fields = [_stamped(f, delimiter) for f in fields]
    all_ = [*fields, *(replace(p, comment=f"{p.comment}, partition") for p in partitions)]
    if newline_field:
        all_.append(FieldSpec("newline", "string", delimiter="\n"))
    record = with_layout(RecordSpec(name, tuple(all_), comment=f"from Hive table {name}"))
    return HiveTable(name, record, stored, delimiter, tuple(p.name for p in partitions), location, d.renames)
