"""XML samples and XSD as record schemas."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import replace

from ..schema.spec import FieldSpec, RecordSpec, SchemaError, with_layout

XS = "{http://www.w3.org/2001/XMLSchema}"
NUL = "\0"
# Built-in simple types with the type that they become.
BUILT_IN = {
    "string": "string", "normalizedString": "string", "token": "string", "anyURI": "string", "ID": "string", "IDREF": "string", "NMTOKEN": "string", "QName": "string", "language": "string",
    "time": "string", "duration": "string", "gYear": "string", "gMonth": "string", "gDay": "string", "anyType": "string", "base64Binary": "binary", "hexBinary": "binary",
    "boolean": "boolean", "date": "date", "dateTime": "datetime", "decimal": "decimal", "float": "float4", "double": "float8",
    "integer": "integer8", "long": "integer8", "int": "integer4", "short": "integer2", "byte": "integer1", "nonNegativeInteger": "integer8", "positiveInteger": "integer8",
    "negativeInteger": "integer8", "nonPositiveInteger": "integer8", "unsignedLong": "integer8", "unsignedInt": "integer8", "unsignedShort": "integer4", "unsignedByte": "integer2",
}


def _root(text: str) -> ET.Element:
    if re.search(r"<!(DOCTYPE|ENTITY)", text, re.I):
        raise SchemaError("document types and entities aren't read")
    try:
        return ET.fromstring(text.strip())
    except ET.ParseError as why:
        raise SchemaError(f"no well-formed XML: {why}") from None


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].rsplit(":", 1)[-1]


def _scalar(name: str, texts: list[str], comment: str) -> FieldSpec:
    number = [x.strip() for x in texts if x.strip()]
    kind = "decimal" if number and all(re.fullmatch(r"[-+]?\d+(\.\d+)?", x) for x in number) else "string"
    scale = max((len(x.partition(".")[2]) for x in number), default=0) if kind == "decimal" else 0
    return FieldSpec(name, kind, (38, scale) if scale else (), delimiter=NUL, comment=comment)


def _sampled(nodes: list[ET.Element], name: str) -> FieldSpec:
    """The field that all these elements of one name fit."""
    attributes = dict.fromkeys(_local(k) for n in nodes for k in n.attrib)
    children = dict.fromkeys(_local(c.tag) for n in nodes for c in n)
    comment = f"element {name}"
    if not attributes and not children:
        return _scalar(name, [n.text or "" for n in nodes], comment)
    fields = []
    for a in attributes:
        values = [v for n in nodes for k, v in n.attrib.items() if _local(k) == a]
        fields.append(_scalar(a if a not in children else f"{a}_attr", values, f"attribute {a} of {name}"))
    for c in children:
        found = [[x for x in n if _local(x.tag) == c] for n in nodes]
        f = _sampled([x for xs in found for x in xs], c)
        fields.append(replace(f, dims=(None,)) if max(map(len, found)) > 1 else f)
    texts = [(n.text or "") for n in nodes]
    if not children and any(t.strip() for t in texts):
        fields.append(_scalar("_value", texts, f"text of {name}"))
    return FieldSpec(name, "record", fields=tuple(fields), comment=comment)


class _Xsd:
    def __init__(self, root: ET.Element):
        self.types = {t.get("name"): t for t in root if t.tag in (XS + "complexType", XS + "simpleType")}
        self.elements = {e.get("name"): e for e in root if e.tag == XS + "element"}
        self.open: list[str] = []

    def built_in(self, name: str, kind: str) -> FieldSpec:
        made = BUILT_IN.get(kind, "string")
        base, digits = re.fullmatch(r"(\D+)(\d*)", made).groups()  # type: ignore[union-attr]
        return FieldSpec(name, base, (int(digits),) if digits else (), delimiter=NUL if base in ("string", "decimal") else None)

    def named(self, name: str, kind: str) -> FieldSpec:
        local = _local(kind)
        if local in self.types:
            if local in self.open:
                raise SchemaError(f"type {local} holds itself")
            self.open.append(local)
            out = self.of(name, self.types[local])
            self.open.pop()
            return out
        return self.built_in(name, local)

    def simple(self, name: str, t: ET.Element) -> FieldSpec:
        r = t.find(XS + "restriction")
        if r is None:
            return self.built_in(name, "string")
        f = self.named(name, r.get("base") or "string") if r.get("base") else self.simple(name, r.find(XS + "simpleType"))  # type: ignore[arg-type]
        facet = {_local(x.tag): x.get("value") for x in r}
        if f.type == "decimal":
            p, s = facet.get("totalDigits"), facet.get("fractionDigits")
            if p or s:
                f = replace(f, args=(int(p or 38), int(s or 0)), delimiter=None)
        if f.type == "string" and (n := facet.get("length") or facet.get("maxLength")):
            f = replace(f, annotations=(("maxLength", n),))
        return f

    def of(self, name: str, t: ET.Element) -> FieldSpec:
        if t.tag == XS + "simpleType":
            return self.simple(name, t)
        return FieldSpec(name, "record", fields=tuple(self.content(t)))

    def content(self, t: ET.Element) -> list[FieldSpec]:
        out: list[FieldSpec] = []
        for node in t:
            tag = _local(node.tag)
            if tag in ("sequence", "all", "choice", "group"):
                out += self.group(node, optional=tag == "choice" or node.get("minOccurs") == "0", many=node.get("maxOccurs") not in (None, "0", "1"))
            elif tag == "attribute":
                f = self.named(node.get("name") or _local(node.get("ref") or ""), node.get("type") or "string") if node.find(XS + "simpleType") is None else self.simple(node.get("name") or "", node.find(XS + "simpleType"))  # type: ignore[arg-type]
                out.append(replace(f, nullable=node.get("use") != "required", annotations=(*f.annotations, ("style", "attribute"))))
            elif tag in ("simpleContent", "complexContent"):
                for ext in node:
                    base = self.named("_value", ext.get("base") or "string")
                    out += [*(base.fields if base.fields else (base,) if tag == "simpleContent" else ()), *self.content(ext)]
        return out

    def group(self, node: ET.Element, optional: bool, many: bool) -> list[FieldSpec]:
        out = []
        for e in node:
            tag = _local(e.tag)
            if tag in ("sequence", "all", "choice"):
                out += self.group(e, optional or tag == "choice" or e.get("minOccurs") == "0", many or e.get("maxOccurs") not in (None, "0", "1"))
            elif tag == "element":
                f = self.element(e)
                if many or e.get("maxOccurs") not in (None, "0", "1"):
                    n = e.get("maxOccurs")
                    f = replace(f, dims=(int(n) if n and n.isdigit() and e.get("minOccurs") == n else None,))
                out.append(replace(f, nullable=optional or e.get("minOccurs") == "0" or e.get("nillable") == "true"))
        return out

    def element(self, e: ET.Element) -> FieldSpec:
        if e.get("ref"):
            ref = _local(e.get("ref") or "")
            if ref not in self.elements:
                raise SchemaError(f"no element {ref}")
            return self.element(self.elements[ref])
        name = e.get("name") or ""
        for kind in ("complexType", "simpleType"):
            inner = e.find(XS + kind)
            if inner is not None:
                return self.of(name, inner)
        return self.named(name, e.get("type") or "string")


def import_xml(text: str) -> tuple[RecordSpec, str]:
    """(record, mode): of an XSD's first element (xsd), or inferred from a document (sample)."""
    root = _root(text)
    if root.tag == XS + "schema":
        x = _Xsd(root)
        if not x.elements:
            raise SchemaError("the XSD declares no element")
        f, mode = x.element(next(iter(x.elements.values()))), "xsd"
    else:
        f, mode = _sampled([root], _local(root.tag)), "sample"
    fields = f.fields if f.type == "record" else (f,)
    return with_layout(RecordSpec(f.name, fields, encoding="utf8", comment="from an XML sample or schema")), mode
