"""A pack as a small set of documents for an assistant: an index, an overview, files, relationships and texts."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph
from . import pack as packs

DETAIL = "references/detail.json"


def file_lines(files: DataFrame) -> DataFrame:
    """(file, line): rows of a Markdown table."""
    summary = F.replace(F.replace(F.coalesce("summary", F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return files.select("file", F.concat(F.lit("| `"), "file", F.lit("` | "), F.format_string("%.2f", F.coalesce("confidence", F.lit(1.0))), F.lit(" | "), summary, F.lit(" |")).alias("line"))


def relationship_lines(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(file, line): a section per file."""
    item = lambda c, note: F.transform(c, lambda x: F.concat(F.lit(f"- depends on{note}: `"), x, F.lit("`")))
    own = graph.adjacency(edges, files)
    items = F.concat(item("internal", ""), item("external", " (external)"))
    return own.select("file", F.concat(F.lit("\n## `"), "file", F.lit("`\n"), F.when(F.size(items) == 0, F.lit("- (no dependencies)")).otherwise(F.array_join(items, "\n"))).alias("line"))


def _in_order(lines: DataFrame) -> list[str]:
    return [r["line"] for r in lines.orderBy("file").collect()]


def documents(spark: SparkSession, pack: packs.Pack) -> dict[str, str]:
    """All documents by path, for small projects; export() writes the texts without gathering them."""
    detail = {r["file"]: {"compressed": r["compressed"]} for r in pack.detail.orderBy("file").collect()}
    return rendered(spark, pack) | {DETAIL: json.dumps(detail, ensure_ascii=False, indent=2)}


def rendered(spark: SparkSession, pack: packs.Pack) -> dict[str, str]:
    """The documents by path, but for the texts; rendered by executors, put together on the driver."""
    p = pack.project.head()
    n = pack.files.count()
    rules = list(p["rules"] or [])
    note = f"Summaries, confidence, rules and the dependency graph of {p['name']}. Read it for questions about the structure of this project, about what a file does and about what depends on what, before you open sources."
    head = spark.range(1).select(text.slug(F.lit(p["name"] or "")).alias("slug"), text.yaml_quoted(F.lit(note)).alias("note")).head()
    overview = ["# Overview", "", f"**Project**: {p['name'] or '(unnamed)'}", f"**Files**: {n}", "", "## Guide", "", (p["prompt"] or "").strip() or "(none)", "", "## Rules", ""]
    overview += [f"- {r}" for r in rules] or ["(none)"]
    if p["tech_stack"]:
        overview += ["", "## Built with", ""]
        for s in p["tech_stack"]:
            names = ", ".join([*s["dependencies"], *["..."] * bool(s["dependencies_truncated"])])
            overview.append(f"- **{s['language']}** ({s['manifest']}, {s['package_manager']})" + (f": {names}" if names else ""))
    overview += ["", "## Tokens", "", "| Model | Sources | Pack | Saved |", "|---|---|---|---|"]
    overview += [f"| {r['model']} | {r['original']:,} | {r['compressed']:,} | {r['saved_pct']}% |" for r in pack.tokens.collect()]
    index = f"""---
name: {head['slug']}
description: "{head['note']}"
---

# {p['name']}

{(p['prompt'] or '').strip()}

A snapshot of {n} files with {len(rules)} rules; the project may have changed since.

1. `references/overview.md`: guide, rules, token numbers.
2. `references/files.md`: a line and a confidence per file; where that is low, look at the file itself.
3. `references/relationships.md`: what each file depends on.
4. `{DETAIL}`: shortened texts by path; look up single files.
"""
    return {
        "SKILL.md": index,
        "references/overview.md": "\n".join(overview) + "\n",
        "references/files.md": "\n".join(["# Files", "", f"{n} files by path.", "", "| File | Confidence | Summary |", "|---|---|---|", *_in_order(file_lines(pack.files))]) + "\n",
        "references/relationships.md": "\n".join(["# Dependency graph", "", "What each file depends on.", *_in_order(relationship_lines(pack.edges, pack.files))]) + "\n",
    }


def export(spark: SparkSession, pack_path: str, folder: str | None = None) -> str:
    """Write the documents; gives the folder."""
    pack = packs.load(spark, pack_path)
    made = rendered(spark, pack)
    root = Path(folder or f"{pack_path}-skill")
    for name, content in made.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content, encoding="utf-8")
    packs.write_object(pack.detail, F.struct("compressed"), str(root / DETAIL))
    return str(root)
