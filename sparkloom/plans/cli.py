"""python -m sparkloom.plans.cli COMMAND ...: the operators for a folder of files on a terminal."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from ..functions import code
from ..operators import features, graph, references, scoring, secrets
from ..session import session
from ..sources import project_tree
from . import api, skill
from . import pack as packs


def csv(value: str | None) -> list[str]:
    return [p.strip() for p in (value or "").split(",") if p.strip()]


def parser() -> argparse.ArgumentParser:
    own = argparse.ArgumentParser(prog="sparkloom")
    own.add_argument("--master", default="local[*]")
    sub = own.add_subparsers(dest="command", required=True)
    for name in ("compress", "signatures", "dependencies", "api", "debug"):
        sub.add_parser(name).add_argument("path")
    for name in ("collect", "tokens", "select", "analyze", "pack", "tree"):
        p = sub.add_parser(name)
        p.add_argument("path")
        p.add_argument("--include")
        p.add_argument("--ignore")
        if name == "pack":
            p.add_argument("--output")
            p.add_argument("--no-llm", action="store_true")
            p.add_argument("--no-cache", action="store_true")
            p.add_argument("--max-tokens", type=int)
            p.add_argument("--model", default="GPT-4o")
    p = sub.add_parser("search")
    p.add_argument("path")
    p.add_argument("pattern")
    p.add_argument("-C", "--context", type=int, default=0)
    p.add_argument("-i", "--ignore-case", action="store_true")
    p = sub.add_parser("detail")
    p.add_argument("pack")
    p.add_argument("file")
    p.add_argument("--start", type=int)
    p.add_argument("--end", type=int)
    p = sub.add_parser("freshness")
    p.add_argument("path")
    p.add_argument("pack")
    p = sub.add_parser("skill")
    p.add_argument("pack")
    p.add_argument("--output")
    sub.add_parser("init").add_argument("path")
    return own


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    show = lambda x: print(json.dumps(x, ensure_ascii=False, indent=2))
    if a.command == "init":
        try:
            print(project_tree.init_config(a.path))
        except FileExistsError:
            print("there is a configuration already")
            return 1
        return 0
    spark = session(a.master)
    if a.command in ("compress", "signatures", "dependencies", "api", "debug"):
        content = project_tree.decode(Path(a.path).read_bytes())
        if content is None:
            print("not a text file")
            return 1
        if a.command == "debug":
            for depth, kind, text in code.outline(content, Path(a.path).suffix):
                print("  " * depth + f"{kind}: {text!r}")
            return 0
        row = features.features(spark.createDataFrame([(Path(a.path).name, content)], "file string, content string")).head()
        print(row["compressed"]) if a.command == "compress" else show(list(row[a.command]))
        return 0
    if a.command in ("search", "detail", "freshness", "skill"):
        if a.command == "search":
            for m in api.search_project(a.path, a.pattern, a.context, a.ignore_case):
                print(f"{m['file']}:{m['line_number']}: {m['line']}")
        elif a.command == "detail":
            print(api.get_detail(a.pack, a.file, a.start, a.end))
        elif a.command == "freshness":
            show(api.check_freshness(a.path, a.pack))
        else:
            print(skill.export(spark, a.pack, a.output))
        return 0
    scanned = secrets.scan(project_tree.read(spark, a.path, csv(a.include), csv(a.ignore)))
    files = secrets.safe(scanned)
    if a.command in ("collect", "select"):
        for r in secrets.numbered(files.select("file")).orderBy("place").collect():
            print(f"{r['place']}. {r['file']}")
        for r in secrets.dangerous(scanned).orderBy("file").collect():
            print(f"withheld: {r['file']}:{r['line']} ({r['reason']})")
    elif a.command == "tokens":
        show([r.asDict() for r in scoring.savings(files, F.col("content"), scoring.compressed_of(files)).collect()])
    elif a.command == "analyze":
        from . import enrich

        own = features.features(files).where((F.size("signatures") > 0) | (F.size("dependencies") > 0))
        show({r["file"]: r["summary"] for r in enrich.summarize(own).orderBy("file").collect()})
    elif a.command == "tree":
        parsed = features.features(files)
        edges = graph.build(references.with_references(parsed, references.references(parsed)).select("file", "dependencies"))
        lists = {r["file"]: {"internal": list(r["internal"]), "external": list(r["external"])} for r in graph.adjacency(edges, files).collect()}
        print("\n".join(graph.tree_lines(sorted(lists), lists)))
    else:
        name = Path(a.path).resolve().name
        out = a.output or f"result/{name}"
        previous = None
        if not a.no_cache and Path(out).exists():
            previous = packs.load(spark, out)
        made = packs.build(spark, scanned.select("file", "content"), name, use_llm=not a.no_llm, previous=previous)
        if made is None:
            print("no files")
            return 1
        packs.save(made, out)
        packs.export_json(packs.load(spark, out), f"{out}.json")
        print(out)
        if a.max_tokens is not None:
            fits, used = scoring.within_budget(packs.load(spark, out).tokens, a.max_tokens, a.model)
            if not fits:
                print(f"{a.model}: {used} tokens, more than {a.max_tokens}" if used is not None else f"unknown model: {a.model}")
                return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
