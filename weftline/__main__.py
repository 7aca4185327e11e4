"""Command line: python -m weftline COMMAND ...

run, validate, order, lineage NODE and explain take one .mp file with .dml and .xfr files;
export writes a script that runs them. dml tells how a schema file is read; hive, cobol
and xml print the schema of a foreign one.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .importers import import_cobol, import_hive, import_xml
from .plans.engine import Engine
from .schema.dml import explain_dml
from .schema.emit import emit_dml
from .sources.files import recommend_format

_SCRIPT = '''"""Runs the graph {name}. spark-submit {file} [--param NAME=VALUE ...] [--output SINK=PATH ...]"""
import argparse

from pyspark.sql import SparkSession

from weftline.plans.engine import Engine

GRAPH = {graph!r}
SCHEMAS = {schemas!r}
TRANSFORMS = {transforms!r}

if __name__ == "__main__":
    p = argparse.ArgumentParser()
    p.add_argument("--param", action="append", default=[])
    p.add_argument("--output", action="append", default=[])
    p.add_argument("--retries", type=int, default=0)
    a = p.parse_args()
    pairs = lambda xs: dict(x.split("=", 1) for x in xs)
    engine = Engine.from_text(GRAPH, SCHEMAS, TRANSFORMS, pairs(a.param))
    print(engine.run(SparkSession.builder.appName({name!r}).getOrCreate(), outputs=pairs(a.output), retries=a.retries).to_json())
'''


def export_script(paths: list[str], out: str) -> str:
    """A script for spark-submit that holds the texts and takes parameters and outputs."""
    texts = {s: "\n".join(Path(p).read_text() for p in paths if p.endswith(s)) for s in (".mp", ".dml", ".xfr")}
    name = Engine.from_files(*paths).graph.name
    script = _SCRIPT.format(name=name, file=Path(out).name, graph=texts[".mp"], schemas=texts[".dml"], transforms=texts[".xfr"])
    Path(out).write_text(script)
    return script


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weftline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["run", "validate", "order", "lineage", "explain", "export", "dml", "hive", "cobol", "xml"])
    p.add_argument("files", nargs="+")
    p.add_argument("--param", action="append", default=[], metavar="NAME=VALUE")
    p.add_argument("--output", action="append", default=[], metavar="SINK=PATH")
    p.add_argument("--node")
    p.add_argument("--out")
    p.add_argument("--retries", type=int, default=0)
    a = p.parse_args(argv)
    params, outputs = (dict(x.split("=", 1) for x in xs) for xs in (a.param, a.output))
    text = Path(a.files[0]).read_text()
    if a.command == "dml":
        found = explain_dml(text, params)
        if not found["ok"]:
            print(found["error"], file=sys.stderr)
            return 1
        print(json.dumps({n: {"type": found["types"][n], **found["layouts"][n], "format": recommend_format(r)[0]} for n, r in found["records"].items()}, indent=2))
    elif a.command == "hive":
        print(import_hive(text).dml)
    elif a.command == "cobol":
        print("\n".join(emit_dml(r) for r in import_cobol(text)))
    elif a.command == "xml":
        print(emit_dml(import_xml(text)[0]))
    elif a.command == "export":
        export_script(a.files, a.out or "pipeline.py")
    else:
        engine = Engine.from_files(*a.files, params=params)
        if a.command == "validate":
            wrong = engine.validate()
            print("\n".join(wrong) or "nothing wrong")
            return int(bool(wrong))
        if a.command == "order":
            print("\n".join(engine.graph.order()))
        elif a.command == "lineage":
            print("\n".join(engine.graph.downstream(a.node or engine.graph.roots()[0])))
        elif a.command == "explain":
            print("\n\n".join(f"{n}\n{t}" for n, t in engine.explain(_session()).items()))
        else:
            print(engine.run(_session(), outputs=outputs, retries=a.retries).to_json())
    return 0


if __name__ == "__main__":
    sys.exit(main())
