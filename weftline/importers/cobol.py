"""COBOL copybooks as record schemas."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from ..schema.spec import FieldSpec, RecordSpec, SchemaError, total_width, with_layout

_PICTURE = re.compile(r"(S?)((?:[9XANV](?:\(\d+\))?)+)$", re.I)


@dataclass
class _Item:
    level: int
    name: str
    words: list[str]
    children: list[_Item] = field(default_factory=list)

    def has(self, *words: str) -> bool:
        return any(w in self.words for w in words)

    def after(self, *words: str) -> str | None:
        for w in words:
            if w in self.words:
                i = self.words.index(w) + 1
                i += i < len(self.words) and self.words[i] in ("IS", "ON", "BY")
                return self.words[i] if i < len(self.words) else None
        return None


def _statements(text: str, copies: Callable[[str], str | None] | None) -> list[list[str]]:
    lines = []
    for line in text.splitlines():
        if re.match(r"^\d{6}", line) or re.match(r"^ {6}[*/ -]", line):
            line = line[6:72]
            if line[:1] in "*/":
                continue
        elif line.lstrip().startswith("*"):
            continue
        lines.append(line.split("*>")[0])
    out = []
    for part in re.split(r"\.(?=\s|$)", "\n".join(lines)):
        words = re.findall(r"'[^']*'|\"[^\"]*\"|==.*?==|[^\s,;]+", part)
        if not words:
            continue
        if words[0].upper() == "COPY":
            body = copies(words[1].strip("'\"")) if copies and len(words) > 1 else None
            if body is None:
                raise SchemaError(f"COPY {' '.join(words[1:2])} has no text")
            swaps = re.findall(r"==\s*(.*?)\s*==\s+BY\s+==\s*(.*?)\s*==", part, re.I | re.S)
            for a, b in swaps:
                body = body.replace(a, b)
            out += _statements(body, copies)
        else:
            out.append([w if w[0] in "'\"" else w.upper() for w in words])
    return out


def _tree(statements: list[list[str]], notes: list[str]) -> list[_Item]:
    top: list[_Item] = []
    stack: list[_Item] = []
    for words in statements:
        if not words[0].isdigit():
            notes.append(f"ignored: {' '.join(words)}")
            continue
        level = int(words[0])
        if level in (66, 88):
            notes.append(f"ignored level {level}: {' '.join(words[1:])}")
            continue
        named = len(words) > 1 and words[1] not in ("PIC", "PICTURE", "OCCURS", "USAGE", "COMP", "COMP-3", "REDEFINES")
        item = _Item(level, words[1] if named else "FILLER", words[1 + named :])
        if level == 77:
            level = item.level = 1
        while stack and stack[-1].level >= level:
            last = stack.pop()
            if stack and stack[-1].level < level < last.level:
                raise SchemaError(f"level {level:02d} of {item.name} fits no group")
        if stack:
            stack[-1].children.append(item)
        elif top and level > 1 and top[0].level > level:
            raise SchemaError(f"level {level:02d} of {item.name} comes after a deeper one")
        else:
            top.append(item)
        stack.append(item)
    return top


def _name(cobol: str) -> str:
    return re.sub(r"\W", "_", cobol.lower().replace("-", "_"))


def _digits(picture: str) -> tuple[str, int, int, bool]:
    """(kind X, 9 or N, characters or digits, digits after V, signed)."""
    m = _PICTURE.match(picture)
    if not m:
        raise SchemaError(f"PIC {picture} isn't supported")
    chars = re.sub(r"([9XANV])\((\d+)\)", lambda x: x[1] * int(x[2]), m[2], flags=re.I).upper()
    whole, _, rest = chars.partition("V")
    letters = set(whole + rest)
    if letters <= {"9"}:
        return "9", len(whole + rest), len(rest), bool(m[1])
    if m[1] or rest or "V" in chars:
        raise SchemaError(f"PIC {picture} isn't supported")
    return ("N" if letters == {"N"} else "X"), len(whole), 0, False


def _field(item: _Item, notes: list[str], view: str | None = None) -> FieldSpec:
    dims: tuple[int | str | None, ...] = ()
    if item.has("OCCURS"):
        counts = [int(w) for w in item.words[item.words.index("OCCURS") + 1 :][:3] if w.isdigit()]
        on = item.after("DEPENDING")
        dims = (_name(on),) if on else (counts[-1],)
    redefines = item.after("REDEFINES")
    notes_ = (("redefines", _name(redefines)),) if redefines else ()
    if item.children:
        fields = _fields(item.children, notes, view)
        return FieldSpec(_name(item.name), "record", fields=fields, dims=dims, annotations=notes_)
    usage = next((w for w in item.words if re.fullmatch(r"COMP(UTATIONAL)?(-[1-5])?|PACKED-DECIMAL|BINARY|POINTER|INDEX|DISPLAY", w)), "DISPLAY").replace("COMPUTATIONAL", "COMP")
    if usage in ("POINTER", "INDEX"):
        raise SchemaError(f"{item.name}: USAGE {usage} isn't supported")
    if usage in ("COMP-1", "COMP-2"):
        return FieldSpec(_name(item.name), "float", (4 if usage == "COMP-1" else 8,), dims=dims, annotations=notes_)
    picture = item.after("PIC", "PICTURE")
    if picture is None:
        raise SchemaError(f"{item.name} has neither PIC nor fields")
    kind, n, scale, signed = _digits(picture)
    made = FieldSpec(_name(item.name), "string", (n,), dims=dims, comment=f"PIC {picture}" + (f" {usage}" if usage != "DISPLAY" else ""))
    if kind == "N":
        made = replace(made, encoding="utf8", annotations=(("charset", "UTF-16BE"),))
    elif kind == "9":
        made = replace(made, type="decimal", args=(n, scale))
        if usage in ("COMP-3", "PACKED-DECIMAL"):
            made = replace(made, encoding="packed")
        elif usage in ("COMP", "COMP-4", "COMP-5", "BINARY"):
            made = replace(made, encoding=None, annotations=(("usage", "binary"), *((("signed", "yes"),) if signed else ())))
        else:
            made = replace(made, encoding="ascii")
            if signed and item.has("SEPARATE"):
                made = replace(made, annotations=(("sign", "leading separate" if item.has("LEADING") else "trailing separate"),))
    return replace(made, annotations=made.annotations + notes_)


def _fields(items: list[_Item], notes: list[str], view: str | None = None) -> tuple[FieldSpec, ...]:
    out: list[FieldSpec] = []
    fillers = 0
    for item in items:
        if item.has("REDEFINES"):
            target = _name(item.after("REDEFINES") or "")
            if view == _name(item.name):
                out = [_field(item, notes, view) if f.name == target else f for f in out]
            elif view is None:
                notes.append(f"{_name(item.name)} redefines {target}")
            continue
        f = _field(item, notes, view)
        if item.name == "FILLER":
            fillers += 1
            f = replace(f, name=f"filler_{fillers}", annotations=(*f.annotations, ("padding", "true")))
        out.append(f)
    double = [n for n, k in Counter(f.name for f in out).items() if k > 1]
    if double:
        raise SchemaError(f"fields of one level share the name {double[0]}")
    return tuple(out)


def record_bytes(record: RecordSpec) -> int:
    """Bytes of a record; a vector whose length another field tells has none."""
    n = 0
    for f in record.fields:
        w = total_width(f)
        if w is None:
            raise SchemaError(f"{f.name} has no fixed length")
        n += w
    return n


def _in_encoding(f: FieldSpec, encoding: str) -> FieldSpec:
    """Text and digits of a field in the record's encoding; packed, binary and wide ones have their own."""
    fields = tuple(_in_encoding(x, encoding) for x in f.fields)
    plain = f.encoding == "ascii" or f.type == "string" and f.encoding is None
    return replace(f, fields=fields, encoding=encoding if plain else f.encoding)


def _redefining(item: _Item) -> list[str]:
    own = [_name(item.name)] if item.has("REDEFINES") else []
    return own + [n for c in item.children for n in _redefining(c)]


def import_cobol(text: str, copies: Callable[[str], str | None] | None = None, redefines: bool = False, encoding: str | None = None) -> list[RecordSpec]:
    """A record for each top item of the copybook; ignored statements are in its notes.

    encoding (ascii or ebcdic) is that of text and unpacked digits in the records' files.

    copies gives the text of COPY members. Of REDEFINES the first layout stays; with
    redefines, a further record for each, named record__item, has the other in its place.
    """
    notes: list[str] = []
    top = _tree(_statements(text, copies), notes)
    if not top:
        raise SchemaError("no items")
    if top[0].level > 1:
        top = [_Item(1, "RECORD", [], top)]
    out = []
    for item in top:
        fields = _fields(item.children, notes) if item.children else (_field(item, notes),)
        record = RecordSpec(_name(item.name), fields, comment="from a COBOL copybook", notes=tuple(notes))
        out.append(record)
        for name in _redefining(item) if redefines else ():
            out.append(replace(record, name=f"{record.name}__{name}", fields=_fields(item.children, [], name)))
    if encoding:
        out = [replace(r, encoding=encoding, fields=tuple(_in_encoding(f, encoding) for f in r.fields)) for r in out]
    return [with_layout(r) for r in out]
