"""Parser of record-schema text."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import Any

from .spec import FieldSpec, RecordSpec, SchemaError, resolve, spark_type, struct_type, with_layout

#: Names of types, each with the type and arguments that it stands for.
TYPES: dict[str, tuple[str, tuple[int, ...]]] = {
    "string": ("string", ()), "varchar": ("string", ()), "char": ("string", ()), "ustring": ("string", ()),
    "integer": ("integer", ()), "int": ("integer", ()), "smallint": ("integer", (2,)), "tinyint": ("integer", (1,)),
    "long": ("long", ()), "bigint": ("long", ()), "float": ("float", ()), "real": ("float", ()), "double": ("double", ()),
    "boolean": ("boolean", ()), "bool": ("boolean", ()), "decimal": ("decimal", ()), "numeric": ("decimal", ()),
    "packed_decimal": ("decimal", ()), "bcd": ("decimal", ()), "date": ("date", ()), "datetime": ("datetime", ()), "timestamp": ("datetime", ()),
    "binary": ("binary", ()), "bytes": ("binary", ()), "ebcdic": ("string", ()), "ebcdic_string": ("string", ()), "void": ("string", ()),
}
IMPLIED = {"packed_decimal": "packed", "bcd": "packed", "ebcdic": "ebcdic", "ebcdic_string": "ebcdic", "bytes": None}
ENCODINGS = {"utf8", "ascii", "ebcdic", "packed"}
FORBIDDEN = {"union", "variant"}

_TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|//[^\n]*|/\*.*?\*/)
      | (?P<number>-?\d+(?:\.\d+)?)
      | (?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
      | (?P<name>[A-Za-z_][A-Za-z0-9_]*)
      | (?P<op>==|!=|<=|>=|[-{}()\[\];,=<>@.])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


def unescape(text: str) -> str:
    return re.sub(r"\\(x[0-9A-Fa-f]{2}|[0-7]{3}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "x" and len(m[1]) == 3 else chr(int(m[1], 8)) if len(m[1]) == 3 else _ESCAPES.get(m[1], m[1]), text, flags=re.S)


def strip_comments(text: str) -> str:
    """Comments to spaces, outside of strings."""
    return re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(--[^\n]*|//[^\n]*|/\*.*?\*/)", lambda m: re.sub(r"[^\n]", " ", m[0]) if m[1] else m[0], text, flags=re.S)


def preprocess(text: str, params: dict[str, str] | None = None) -> str:
    """Comments out, #define macros (the last wins) and ${NAME} in; what stays unresolved goes."""
    text = strip_comments(text)
    macros: dict[str, str] = {}

    def note(m: re.Match) -> str:
        macros[m[1]] = m[2].strip()
        return ""

    text = re.sub(r"(?m)^[ \t]*#define[ \t]+(\w+)[ \t]+(.*)$", note, text)
    for _ in range(8):
        before = text
        text = re.sub(r"\$\{(\w+)\}", lambda m: str({**macros, **(params or {})}.get(m[1], m[0])), text)
        if text == before:
            break
    for name, value in macros.items():
        text = re.sub(rf"\b{re.escape(name)}\b", lambda _, v=value: v, text)
    return re.sub(r"\$\{\w*\}", "", text)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    line: int

    @property
    def value(self) -> str:
        return unescape(self.text[1:-1]) if self.kind == "string" else self.text


def tokens_of(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SchemaError(f"unexpected {text[at]!r} on line {text.count(chr(10), 0, at) + 1}")
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup or "", m[0], text.count("\n", 0, at) + 1))
        at = m.end()
    return [*out, Token("end", "", text.count("\n") + 1)]


class Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.i = tokens, 0
        self.aliases: dict[str, tuple[FieldSpec, ...]] = {}
        self.siblings: list[str] = []

    # -- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def is_(self, *texts: str, ahead: int = 0) -> bool:
        t = self.tokens[min(self.i + ahead, len(self.tokens) - 1)]
        return t.kind != "string" and t.text.lower() in texts

    def take(self, *texts: str) -> bool:
        if self.is_(*texts):
            self.i += 1
            return True
        return False

    def need(self, *texts: str) -> None:
        if not self.take(*texts):
            raise self.fail(f"expected {' or '.join(texts)}")

    def fail(self, what: str) -> SchemaError:
        return SchemaError(f"{what}, found {self.now.text or 'the end'!r} on line {self.now.line}")

    def word(self) -> str:
        if self.now.kind != "name":
            raise self.fail("expected a name")
        self.i += 1
        return self.tokens[self.i - 1].text

    # -- files

    def file(self) -> dict[str, RecordSpec]:
        out: dict[str, RecordSpec] = {}

        def put(r: RecordSpec) -> None:
            if r.name in out:
                raise SchemaError(f"two records are named {r.name}")
            out[r.name] = with_layout(r)

        while self.now.kind != "end":
            if self.take(";"):
                continue
            if self.take("define"):
                name = self.word()
                self.need("begin")
                fields = self.fields("end")
                self.need("end")
                put(RecordSpec(name, fields))
            elif self.is_("type") and self.is_("=", ahead=2):
                self.i += 1
                alias = self.word()
                self.need("=")
                self.need("record", "group")
                fields = self.fields("end", "}")
                self.need("end", "}")
                self.aliases[alias.lower()] = fields
            elif self.is_("metadata") and self.is_("type", ahead=1):
                self.i += 2
                self.need("=")
                put(self.root("metadata", out))
            else:
                put(self.root(None, out))
        if not out and self.aliases:
            for name, fields in self.aliases.items():
                put(RecordSpec(name, fields))
        return out

    def root(self, name: str | None, seen: dict[str, RecordSpec]) -> RecordSpec:
        encoding = self.word().lower() if self.is_(*ENCODINGS) and self.is_("record", "group", ahead=1) else None
        if name and self.now.kind == "name" and self.now.text.lower() in self.aliases:
            return RecordSpec(name, self.aliases[self.word().lower()], encoding)
        self.need("record", "group")
        fields = self.fields("end", "}")
        self.need("end", "}")
        if self.now.kind == "name" and not self.is_("record", "group", "define", "type", "metadata", *ENCODINGS):
            name = self.word()
        self.take(";")
        return RecordSpec(name or f"record_{len(seen) + 1}", fields, encoding)

    # -- fields

    def fields(self, *ends: str) -> tuple[FieldSpec, ...]:
        outer, self.siblings = self.siblings, []
        out: list[FieldSpec] = []
        while not self.is_(*ends):
            if self.now.kind == "end":
                raise self.fail(f"missing {ends[0]}")
            if self.take(";"):
                continue
            if self.is_("if") and not self.is_(";", ahead=1):
                found = self.conditional()
            else:
                found = (self.field(),)
            for f in found:
                if f.name in self.siblings and f.condition is None:
                    raise SchemaError(f"two fields are named {f.name}")
                out.append(f)
                self.siblings.append(f.name)
        self.siblings = outer
        return tuple(out)

    def conditional(self) -> tuple[FieldSpec, ...]:
        """if (column op literal) [then] fields [else fields] end: one level, each branch may be null."""
        self.need("if")
        self.need("(")
        column = self.word()
        op = self.now.text
        self.need("==", "!=", "=", "<", "<=", ">", ">=")
        t = self.now
        if t.kind not in ("string", "number", "name"):
            raise self.fail("expected a literal")
        self.i += 1
        value: Any = t.value if t.kind != "number" else (float(t.text) if "." in t.text else int(t.text))
        self.need(")")
        self.take("then")
        out = []
        for holds in (True, False):
            if not holds and not self.take("else"):
                break
            while not self.is_("else", "end", "end_if"):
                if self.now.kind == "end":
                    raise self.fail("missing end of if")
                if self.is_("if"):
                    raise self.fail("an if within an if")
                if self.take(";"):
                    continue
                out.append(replace(self.field(), nullable=True, condition=(column, "=" if op == "==" else op, value, holds)))
        self.need("end", "end_if")
        self.take("if")
        self.take(";")
        return tuple(out)

    def dims(self) -> tuple[int | str | None, ...]:
        out: list[int | str | None] = []
        while self.take("["):
            if self.take("]"):
                out.append(None)
                continue
            t = self.now
            self.i += 1
            if t.kind == "number":
                out.append(int(t.text))
            elif t.kind == "name" and t.text.lower() in ("int", "integer"):
                out.append(None)
            elif t.kind == "name":
                if t.text not in self.siblings:
                    raise SchemaError(f"no earlier field {t.text} for the length of a vector, line {t.line}")
                out.append(t.text)
            else:
                raise self.fail("expected the length of a vector")
            self.need("]")
        return tuple(out)

    def field(self) -> FieldSpec:
        if self.is_(*FORBIDDEN):
            raise SchemaError(f"{self.now.text} isn't supported, line {self.now.line}")
        encoding = None
        if self.is_(*ENCODINGS) and self.tokens[self.i + 1].kind == "name" and not self.is_("null", "not", ahead=1):
            encoding = self.word().lower()
        if self.is_("record", "group") and not self.is_(";", "(", ahead=1):
            return self.struct(encoding)
        first = self.word()
        if first.lower() in TYPES or first.lower() in self.aliases:
            # type(args) name, unless the name comes first and the type after it
            if not (self.now.kind == "name" and self.now.text.lower() in {*TYPES, *self.aliases, *FORBIDDEN} and (self.is_(";", "(", "null", "not", "=", ahead=1))):
                made = self.typed(first, encoding)
                before = self.dims()
                name = self.word()
                return self.finish(replace(made, name=name), before + self.dims())
        name, after = first, self.dims()
        if self.is_(*FORBIDDEN):
            raise SchemaError(f"{self.now.text} isn't supported, line {self.now.line}")
        if self.is_(*ENCODINGS) and self.tokens[self.i + 1].kind == "name":
            encoding = self.word().lower()
        if self.is_("record", "group"):
            self.i += 1
            fields = self.fields("end", "}")
            self.need("end", "}")
            after += self.dims()
            self.take(name.lower())  # the name may be said again
            return self.finish(FieldSpec(name, "record", fields=fields, encoding=encoding), after + self.dims())
        kind = self.word()
        if kind.lower() not in TYPES and kind.lower() not in self.aliases:
            raise SchemaError(f"unknown type {kind} on line {self.tokens[self.i - 1].line}")
        return self.finish(replace(self.typed(kind, encoding), name=name), after + self.dims())

    def struct(self, encoding: str | None) -> FieldSpec:
        """record ... end name; end[N] name; } name; } [int] name; or no name."""
        self.i += 1
        fields = self.fields("end", "}")
        self.need("end", "}")
        dims = self.dims()
        name = self.word() if self.now.kind == "name" and not self.is_("null", "not", "nullable", "not_null", "notnull") else f"anonymous_{len(self.siblings) + 1}"
        return self.finish(FieldSpec(name, "record", fields=fields, encoding=encoding), dims + self.dims())

    def typed(self, word: str, encoding: str | None) -> FieldSpec:
        low = word.lower()
        if low in self.aliases:
            return FieldSpec("", "record", fields=self.aliases[low], alias=low)
        kind, args = TYPES[low]
        f = FieldSpec("", kind, args, encoding=encoding or IMPLIED.get(low))
        return self.arguments(f) if self.take("(") else f

    def arguments(self, f: FieldSpec) -> FieldSpec:
        numbers: list[int] = []
        while not self.take(")"):
            t = self.now
            if t.kind == "end":
                raise self.fail("missing )")
            self.i += 1
            if t.kind == "number":
                numbers.append(int(t.text.split(".")[0]))
            elif t.kind == "string":
                if f.type in ("date", "datetime"):
                    f = replace(f, format=t.value)
                elif f.type == "decimal" and re.fullmatch(r"[-+S]?[0-9Z]*\.[0-9]+", t.value):
                    f = replace(f, picture=t.value)
                elif t.value == "":
                    raise SchemaError(f"an empty delimiter, line {t.line}")
                else:
                    f = replace(f, delimiter=t.value)
            elif t.kind == "name" and t.text.lower() == "null" and self.take("("):
                f = replace(f, null_indicator=self.now.value, nullable=True)
                self.i += 1
                self.need(")")
        if f.picture is not None:
            whole, _, rest = f.picture.lstrip("-+S").partition(".")
            if len(rest) == 1 and not whole and rest.isdigit():  # ".2": two places
                numbers = [38, int(rest)]
            else:
                numbers = [len(whole) + len(rest), len(rest)]
        if f.type == "decimal" and len(numbers) == 2 and numbers[1] > numbers[0]:
            raise SchemaError(f"decimal({numbers[0]},{numbers[1]}) has a scale above its precision")
        return replace(f, args=tuple(numbers) or f.args)

    def finish(self, f: FieldSpec, dims: tuple[int | str | None, ...]) -> FieldSpec:
        f, notes = replace(f, dims=dims), []
        while not self.take(";"):
            if self.take("not"):
                self.need("null")
                f = replace(f, nullable=False)
            elif self.take("not_null", "notnull"):
                f = replace(f, nullable=False)
            elif self.take("null"):
                if self.take("("):
                    f = replace(f, null_indicator=self.now.value)
                    self.i += 1
                    self.need(")")
                f = replace(f, nullable=True)
            elif self.take("nullable"):
                f = replace(f, nullable=True)
            elif self.take("="):
                t = self.now
                self.i += 1
                f = replace(f, default=t.value if t.kind != "number" else (float(t.text) if "." in t.text else int(t.text)))
            elif self.take("@"):
                notes.append((self.word(), self._noted()))
            elif self.take(","):
                notes.append((self.word(), self._noted()))
            else:
                raise self.fail("expected ;")
        return replace(f, annotations=tuple(notes))

    def _noted(self) -> str:
        self.need("=")
        self.i += 1
        return self.tokens[self.i - 1].value


def parse_dml(text: str, params: dict[str, str] | None = None) -> dict[str, RecordSpec]:
    """Records by name, in order. Errors name the line."""
    return Parser(tokens_of(preprocess(text, params))).file()


def to_struct_type(text: str, name: str | None = None, lossy: bool = False, params: dict[str, str] | None = None):
    found = parse_dml(text, params)
    return struct_type(resolve(found, name) if name else next(iter(found.values())), lossy)


def explain_dml(text: str, params: dict[str, str] | None = None) -> dict[str, Any]:
    """Each stage's result, up to the one that fails: text, tokens, records, layouts, types."""
    out: dict[str, Any] = {"ok": False}
    try:
        out["preprocessed"] = preprocess(text, params)
        tokens = tokens_of(out["preprocessed"])
        out["tokens"] = [(t.kind, t.text, t.line) for t in tokens if t.kind != "end"]
        records = Parser(tokens).file()
        out["records"] = records
        out["layouts"] = {n: {"layout": r.layout, "record_length": r.record_length, "fields": [(f.name, f.offset, f.length) for f in r.fields]} for n, r in records.items()}
        out["types"] = {n: struct_type(r).simpleString() for n, r in records.items()}
        out["ok"] = True
    except SchemaError as why:
        out["error"] = str(why)
    return out


__all__ = ["FieldSpec", "RecordSpec", "SchemaError", "explain_dml", "parse_dml", "preprocess", "resolve", "spark_type", "struct_type", "to_struct_type"]
