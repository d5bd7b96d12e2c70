"""The eight questions to a pack or a project.

Every question exists as a DataFrame (``*_df``), for any size, and as plain Python values for tools and transports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, search, secrets, snapshots
from ..sources import project_tree
from . import pack as packs


def _spark() -> SparkSession:
    return SparkSession.builder.getOrCreate()


def live_files(project_path: str) -> DataFrame:
    """The project's files as they are now, within its configuration and without those that hold secrets."""
    return secrets.safe(secrets.scan(project_tree.read(_spark(), project_path))).select("file", "content")


def freshness_df(project_path: str, pack_path: str) -> DataFrame:
    return snapshots.compare(snapshots.manifest(live_files(project_path)), packs.load(_spark(), pack_path).manifest)


def check_freshness(project_path: str, pack_path: str) -> dict:
    """is_stale and the sorted files that changed, were added, were removed or stayed."""
    found: dict[str, list[str]] = {"changed": [], "added": [], "removed": [], "unchanged": []}
    for r in freshness_df(project_path, pack_path).orderBy("file").collect():
        found[r["status"]].append(r["file"])
    return {"is_stale": bool(found["changed"] or found["added"] or found["removed"]), **found}


def _warning(project_path: str | None, pack_path: str) -> dict | None:
    """What has drifted, or None: also where there is no readable manifest to compare with."""
    if project_path is None:
        return None
    try:
        report = check_freshness(project_path, pack_path)
    except Exception:  # noqa: BLE001 - a warning must not take the answer down
        return None
    return {k: report[k] for k in ("changed", "added", "removed")} if report["is_stale"] else None


def _with_warning(answer: dict, project_path: str | None, pack_path: str) -> dict:
    warning = _warning(project_path, pack_path)
    return answer | ({"_stale": warning} if warning else {})


def get_overview(pack_path: str, project_path: str | None = None) -> dict:
    """The project, its rules, token savings and number of files."""
    p = packs.load(_spark(), pack_path)
    project = p.project.head()
    stacks = [s.asDict() for s in project["tech_stack"] or []] if project else []
    answer = {
        "project": {"name": project["name"], "prompt": project["prompt"], "tech_stack": stacks} if project else {},
        "rules": list(project["rules"] or []) if project else [],
        "tokens": {r["model"]: {"original": r["original"], "compressed": r["compressed"], "saved_pct": r["saved_pct"]} for r in p.tokens.collect()},
        "file_count": p.files.count(),
    }
    return _with_warning(answer, project_path, pack_path)


def list_files_df(pack_path: str) -> DataFrame:
    own = packs.load(_spark(), pack_path).files
    return own.select("file", "ord", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def list_files(pack_path: str, project_path: str | None = None) -> dict:
    """Summary and confidence by file, in the pack's order."""
    rows = list_files_df(pack_path).orderBy("ord").collect()
    return _with_warning({r["file"]: {"summary": r["summary"], "confidence": r["confidence"]} for r in rows}, project_path, pack_path)


def get_relationships(pack_path: str) -> dict:
    """internal and external dependencies by file."""
    p = packs.load(_spark(), pack_path)
    rows = graph.adjacency(p.edges, p.files).collect()
    return {r["file"]: {"internal": list(r["internal"]), "external": list(r["external"])} for r in sorted(rows, key=lambda r: r["file"])}


def get_dependents(pack_path: str, file: str) -> list[str]:
    return [r["file"] for r in graph.dependents(packs.load(_spark(), pack_path).edges, file).orderBy("file").collect()]


def get_blast_radius(pack_path: str, file: str) -> list[str]:
    return [r["file"] for r in graph.blast_radius(packs.load(_spark(), pack_path).edges, file).orderBy("file").collect()]


def get_detail(pack_path: str, file: str, start_line: int | None = None, end_line: int | None = None) -> str:
    """A file's shortened text, or some of its lines (from 1, both included)."""
    own = packs.load(_spark(), pack_path).detail.where(F.col("file") == file)
    found = search.line_range(own, start_line, end_line).head()
    if found is None:
        raise ValueError(f"{file!r} is not in {pack_path}")
    return found["text"]


def search_project_df(project_path: str, pattern: str, context_lines: int = 0, ignore_case: bool = False, engine: str = "jvm") -> DataFrame:
    return search.search(live_files(project_path), pattern, context_lines, ignore_case, engine=engine)


def search_project(project_path: str, pattern: str, context_lines: int = 0, ignore_case: bool = False) -> list[dict]:
    """Matches in the project as it is now, by file and line."""
    return [r.asDict() for r in search_project_df(project_path, pattern, context_lines, ignore_case).orderBy("file", "line_number").collect()]


def file_page(pack_path: str, file: str) -> dict:
    """All that is known about one file: its entry, edges, dependents, reach and shortened text."""
    p = packs.load(_spark(), pack_path)
    entry = p.files.where(F.col("file") == file).head()
    lists = graph.adjacency(p.edges).where(F.col("file") == file).head()
    return {
        "summary": entry["summary"] if entry else "", "confidence": entry["confidence"] if entry else 1.0,
        "internal": list(lists["internal"]) if lists else [], "external": list(lists["external"]) if lists else [],
        "dependents": get_dependents(pack_path, file), "blast_radius": get_blast_radius(pack_path, file), "detail": get_detail(pack_path, file),
    }


def filter_files(files: DataFrame, query: str, *, by: str | None = None, descending: bool = False) -> DataFrame:
    """Files whose name or summary holds the query, in any case; in the pack's order, or by a column."""
    q = F.lower(F.lit(query))
    found = files.where(F.contains(F.lower("file"), q) | F.contains(F.lower(F.coalesce("summary", F.lit(""))), q))
    return found.orderBy(F.desc(by) if descending else F.asc(by), "ord") if by else found.orderBy("ord")


def around(line: int, margin: int = 5) -> tuple[int, int]:
    """The range of lines to show around a match."""
    return max(1, line - margin), line + margin


QUESTIONS = {f.__name__: f for f in (get_overview, list_files, get_relationships, get_dependents, get_blast_radius, get_detail, check_freshness, search_project)}


def shown_name(path: str, most: int = 24) -> str:
    return _spark().range(1).select(text.tail(F.lit(path), most)).head()[0]
