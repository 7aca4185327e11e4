"""Record schemas as text that parses back to the same schema."""

from __future__ import annotations

from .spec import FieldSpec, RecordSpec

_ESCAPES = {"\n": "\\n", "\t": "\\t", "\r": "\\r", '"': '\\"', "\\": "\\\\"}


def quoted(text: str) -> str:
    return '"' + "".join(_ESCAPES.get(c, c if " " <= c else f"\\{ord(c):03o}") for c in text) + '"'


def _dims(f: FieldSpec) -> str:
    return "".join("[int]" if d is None else f"[{d}]" for d in f.dims)


def _literal(x: object) -> str:
    return quoted(x) if isinstance(x, str) else str(x)


def _tail(f: FieldSpec) -> str:
    out = "" if f.nullable else " NOT NULL"
    if f.default is not None:
        out += f" = {_literal(f.default)}"
    out += "".join(f" @{k}={quoted(v)}" for k, v in f.annotations)
    return out + ";" + (f" /* {f.comment} */" if f.comment else "")


def _type(f: FieldSpec) -> str:
    args = [] if f.picture else [str(a) for a in f.args]
    for extra in (f.picture, f.format, f.delimiter):
        if extra is not None:
            args.append(quoted(extra))
    if f.null_indicator is not None:
        args.append(f"null({quoted(f.null_indicator)})")
    return f.type + (f"({', '.join(args)})" if args else "")


def emit_field(f: FieldSpec, pad: str) -> list[str]:
    prefix = f"{f.encoding} " if f.encoding else ""
    if f.fields or f.type == "record":
        return [f"{pad}{prefix}record", *emit_fields(f.fields, pad + "  "), f"{pad}end{_dims(f)} {f.name}{_tail(f)}"]
    return [f"{pad}{prefix}{_type(f)}{_dims(f)} {f.name}{_tail(f)}"]


def emit_fields(fields: tuple[FieldSpec, ...], pad: str) -> list[str]:
    out, i = [], 0
    while i < len(fields):
        c = fields[i].condition
        if c is None:
            out += emit_field(fields[i], pad)
            i += 1
            continue
        out.append(f"{pad}if ({c[0]} {'==' if c[1] == '=' else c[1]} {_literal(c[2])}) then")
        for holds in (True, False):
            if not holds and i < len(fields) and fields[i].condition == (*c[:3], False):
                out.append(f"{pad}else")
            while i < len(fields) and fields[i].condition == (*c[:3], holds):
                out += emit_field(fields[i], pad + "  ")
                i += 1
        out.append(f"{pad}end;")
    return out


def emit_dml(r: RecordSpec) -> str:
    """Text of one record; parse_dml(emit_dml(r))[r.name] has the same fields."""
    head = [f"/* {r.comment} */"] if r.comment else []
    return "\n".join([*head, f"{r.encoding + ' ' if r.encoding else ''}record", *emit_fields(r.fields, "  "), f"end {r.name};", ""])
