"""Dataflow graphs: parsing, parameters, order, lineage, and a catalog of them."""

from __future__ import annotations

import heapq
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class GraphError(ValueError):
    """A graph that can't be bound."""


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    source_port: str = "out"
    target_port: str = "in"


@dataclass(frozen=True)
class Node:
    id: str
    name: str
    type: str
    props: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Graph:
    name: str
    nodes: dict[str, Node]
    edges: tuple[Edge, ...]
    params: dict[str, str] = field(default_factory=dict)

    def inputs(self, node: str) -> list[Edge]:
        """Edges into a node, in the order of the document."""
        return [e for e in self.edges if e.target == node]

    def successors(self, node: str) -> list[str]:
        return list(dict.fromkeys(e.target for e in self.edges if e.source == node))

    def order(self) -> list[str]:
        """Node ids, each after what it reads; of those that could come next, the first by name."""
        waits = {n: len({e.source for e in self.inputs(n)}) for n in self.nodes}
        ready = [n for n, k in waits.items() if not k]
        heapq.heapify(ready)
        out = []
        while ready:
            n = heapq.heappop(ready)
            out.append(n)
            for s in self.successors(n):
                waits[s] -= 1
                if not waits[s]:
                    heapq.heappush(ready, s)
        if len(out) < len(self.nodes):
            raise GraphError(f"the graph has a cycle through {', '.join(sorted(set(self.nodes) - set(out)))}")
        return out

    def roots(self) -> list[str]:
        return [n for n in self.nodes if not self.inputs(n)]

    def leaves(self) -> list[str]:
        return [n for n in self.nodes if not self.successors(n)]

    def downstream(self, node: str) -> list[str]:
        """All that node's result reaches, itself excluded, by name."""
        seen: set[str] = set()
        todo = [node]
        while todo:
            todo += [s for s in self.successors(todo.pop()) if s not in seen and not seen.add(s)]
        return sorted(seen - {node})

    def to_dict(self) -> dict[str, Any]:
        return {"name": self.name, "nodes": [asdict(n) for n in self.nodes.values()], "edges": [asdict(e) for e in self.edges], "params": self.params}

    @classmethod
    def from_dict(cls, d: Mapping[str, Any]) -> Graph:
        return cls(d["name"], {n["id"]: Node(**n) for n in d["nodes"]}, tuple(Edge(**e) for e in d["edges"]), dict(d["params"]))


# -- parameters


def interpolate(value: Any, params: Mapping[str, str], strict: bool = False) -> Any:
    """${NAME} replaced within strings, lists and dicts, eight times over; unknown ones stay, or fail if strict."""
    if isinstance(value, str):
        for _ in range(8):
            before = value
            value = re.sub(r"\$\{(\w+)\}", lambda m: str(params.get(m[1], m[0])), value)
            if value == before:
                break
        if strict and (m := re.search(r"\$\{(\w+)\}", value)):
            raise GraphError(f"no value for parameter {m[1]}")
        return value
    if isinstance(value, Mapping):
        return {k: interpolate(v, params, strict) for k, v in value.items()}
    return [interpolate(v, params, strict) for v in value] if isinstance(value, list) else value


# -- the graph language

_ATTRIBUTE = re.compile(r"""(=\s*)("[^"]*"|'[^']*')""")


def escape_attributes(text: str) -> str:
    """Bare <, > and & within attribute values as entities."""

    def fix(m: re.Match) -> str:
        body = re.sub(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)", "&amp;", m[2][1:-1])
        return m[1] + m[2][0] + body.replace("<", "&lt;").replace(">", "&gt;") + m[2][0]

    # Comments stay: they may hold anything.
    return "".join(p if p.startswith("<!--") else _ATTRIBUTE.sub(fix, p) for p in re.split(r"(<!--.*?-->|<\?.*?\?>)", text, flags=re.S))


def _tag(e: ET.Element) -> str:
    return e.tag.lower() if isinstance(e.tag, str) else ""


def parse_graph(text: str, params: Mapping[str, str] | None = None, strict: bool = False) -> Graph:
    """The graph of a document, with params over its own.

    Edges come from ports first and from connection lists after; one of a list whose
    ends a port already connects adds nothing.
    """
    if re.search(r"<!(DOCTYPE|ENTITY)", text, re.I):
        raise GraphError("document types and entities aren't read")
    try:
        root = ET.fromstring(escape_attributes(text.strip()))
    except ET.ParseError as why:
        raise GraphError(f"no well-formed XML: {why}") from None
    own: dict[str, str] = {}
    for group in root:
        if _tag(group) in ("parameters", "params"):
            for p in group:
                own[p.get("name") or ""] = p.get("value") if p.get("value") is not None else (p.text or "").strip()  # type: ignore[assignment]
    own |= {k: str(v) for k, v in (params or {}).items()}
    own = {k: interpolate(v, own) for k, v in own.items()}
    nodes: dict[str, Node] = {}
    ports: list[Edge] = []
    listed: list[Edge] = []
    places = [root, *[g for g in root if _tag(g) in ("components", "nodes")]]
    for c in (c for g in places for c in g if _tag(c) in ("component", "node")):
        ident, props = c.get("id") or c.get("name") or "", {}
        for x in c:
            tag = _tag(x)
            if tag in ("property", "param", "parameter"):
                props[x.get("name") or ""] = x.get("value") if x.get("value") is not None else (x.text or "").strip()
            elif tag == "port" and x.get("source"):
                source, _, port = (x.get("source") or "").partition(".")
                ports.append(Edge(source, ident, port or "out", x.get("name") or "in"))
        if ident in nodes:
            raise GraphError(f"two components have the id {ident}")
        nodes[ident] = Node(ident, c.get("name") or ident, c.get("type") or "", interpolate(props, own, strict))
    for group in root:
        if _tag(group) in ("connections", "edges", "flows"):
            for e in group:
                ends = [(e.get(k) or "").partition(".") for k in ("from", "to")]
                listed.append(Edge(ends[0][0], ends[1][0], e.get("from_port") or ends[0][2] or "out", e.get("to_port") or ends[1][2] or "in"))
    edges = list(dict.fromkeys(ports))
    known = {(e.source, e.target) for e in edges}
    edges += [e for e in dict.fromkeys(listed) if (e.source, e.target) not in known]
    for e in edges:
        for end in (e.source, e.target):
            if end not in nodes:
                raise GraphError(f"an edge names the component {end}, which isn't there")
    return Graph(root.get("name") or "graph", nodes, tuple(edges), own)


# -- catalog


class Catalog:
    """Graphs by id, each a JSON file; saving again replaces."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def _path(self, ident: str) -> Path:
        if not re.fullmatch(r"[\w.-]+", ident):
            raise GraphError(f"{ident!r} can't be an id")
        return self.folder / f"{ident}.json"

    def save(self, ident: str, graph: Graph) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        self._path(ident).write_text(json.dumps(graph.to_dict()))

    def load(self, ident: str) -> Graph:
        path = self._path(ident)
        if not path.exists():
            raise GraphError(f"no graph {ident}")
        return Graph.from_dict(json.loads(path.read_text()))

    def delete(self, ident: str) -> None:
        self._path(ident).unlink(missing_ok=True)

    def ids(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.json"))


def edges_frame(spark: SparkSession, graph: Graph) -> DataFrame:
    return spark.createDataFrame([(e.source, e.target) for e in graph.edges], "source string, target string")


def downstream_frame(edges: DataFrame, start: Iterable[str] | None = None, max_rounds: int = 1000) -> DataFrame:
    """(origin, reached): the closure of edges(source, target), for all nodes or for those of start.

    Joins until nothing new is reached, so that edges may be more than a driver holds.
    """
    steps = edges.select(F.col("source").alias("s"), F.col("target").alias("t")).where("s <> t").distinct()
    found = steps.select(F.col("s").alias("origin"), F.col("t").alias("reached"))
    if start is not None:
        found = found.where(F.col("origin").isin(list(start)))
    n, kept = found.count(), None
    for _ in range(max_rounds):
        more = found.join(steps, found["reached"] == steps["s"]).select("origin", F.col("t").alias("reached"))
        found = found.unionByName(more).where("origin <> reached").distinct()
        if edges.sparkSession.sparkContext.getCheckpointDir():
            found, before = found.checkpoint(), None
        else:
            found, before = found.cache(), kept
            kept = found
        now = found.count()
        if before is not None:
            before.unpersist()
        if now == n:
            return found
        n = now
    raise GraphError("the closure did not end")
