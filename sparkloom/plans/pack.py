"""Building a pack, the folder of tables that the query API reads, and changing one."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import features, graph, references, scoring, secrets, snapshots, tech_stack
from ..schema import TABLES
from . import enrich

#: The tables that a question needs before any file's text; the others are read only when asked for.
LEAN = ("files", "edges", "project", "tokens")
STRUCTURE_ONLY = "This pack was made without a language model; summaries list what each file defines or refers to."


class Cancelled(Exception):
    """The pack was stopped between two stages."""


class SummariesFailed(Exception):
    """The model gave no rules or no guide; stages up to there are kept for another try."""


#: What a policy answers to a failure.
RETRY, EXIT = "retry", "exit"


@dataclass(frozen=True)
class Policy:
    """What to do where a person would be asked; the defaults are for runs without one.

    failed(field) after the model gave no rules or no guide: RETRY, EXIT (stages are kept) or the value to take, a list of
    rules or a guide.  resume() if there are stages of an earlier run: go on from them, or start anew.  keep() after a run
    was cancelled: keep the stages, or discard them.
    """

    failed: Callable[[str], str | list[str]] = lambda field: EXIT
    resume: Callable[[], bool] = lambda: True
    keep: Callable[[], bool] = lambda: True

    def asked(self, field: str, ask: Callable[[], object]) -> object:
        """What ask() gives, or what the policy takes in its place."""
        while (found := ask()) is None:
            answer = self.failed(field)
            if answer == EXIT:
                raise SummariesFailed(field)
            if answer != RETRY:
                return answer
        return found


@dataclass(frozen=True)
class Pack:
    files: DataFrame
    detail: DataFrame
    manifest: DataFrame
    edges: DataFrame
    project: DataFrame
    tokens: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in TABLES}


def save(pack: Pack, path: str, only: tuple[str, ...] | None = None) -> str:
    """Write the tables beside the old ones, which a new pack may still be read from, then put each in its old one's place."""
    made = {}
    for name, df in pack.tables().items():
        if only is None or name in only:
            made[name] = f"{path}/.new-{uuid.uuid4().hex}-{name}"
            df.write.parquet(made[name])
    spark = pack.files.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name, new in made.items():
        old = hadoop(f"{path}/{name}")
        fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(old, True)
        fs.rename(hadoop(new), old)
        spark.catalog.refreshByPath(f"{path}/{name}")
    return path


def load(spark: SparkSession, path: str) -> Pack:
    return Pack(**{n: spark.read.schema(ddl).parquet(f"{path}/{n}") for n, ddl in TABLES.items()})


def build(
    spark: SparkSession,
    files: DataFrame,
    name: str,
    *,
    use_llm: bool = True,
    provider: str | None = None,
    names: DataFrame | None = None,
    overrides: DataFrame | None = None,
    previous: Pack | None = None,
    stages: str | None = None,
    cancelled: Callable[[], bool] = lambda: False,
    regenerate_failed: bool = False,
    manifests: DataFrame | None = None,
    external: secrets.Scanner | None = None,
    policy: Policy = Policy(),  # noqa: B008 - it is frozen
) -> Pack | None:
    """A pack of files (file, content): scan, select, parse, summarize, score, connect, count.  None if nothing is selected.

    Everything per file is one lazy plan over one parse.  ``stages`` names a folder where the parse and the summaries are
    written by file and content and, if there, read again, so a run that was stopped goes on from them, whatever files it
    had; it is deleted at the end.  Unchanged
    files of ``previous`` keep their summaries.  ``external`` scans for secrets where it can, and ``policy`` answers for a person.
    """

    def hadoop(path: str):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def drop_stages() -> None:
        at, fs = hadoop(stages)
        fs.delete(at, True)

    if stages is not None:
        at, fs = hadoop(stages)
        if fs.exists(at) and not policy.resume():
            drop_stages()

    def stage(step: str, wanted: DataFrame, keys: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """make(wanted); what an earlier run has made for rows of the same keys is read instead."""
        if cancelled():
            if stages is not None and not policy.keep():
                drop_stages()
            raise Cancelled(step)
        if stages is None:
            return make(wanted).persist()  # recomputed where an executor is lost
        at, fs = hadoop(f"{stages}/{step}")
        done = [str(s.getPath()) for s in (fs.listStatus(at) if fs.exists(at) else ()) if fs.exists(hadoop(f"{s.getPath()}/_SUCCESS")[0])]
        path, schema = f"{stages}/{step}/{uuid.uuid4().hex}", make(wanted).schema
        have = spark.read.schema(schema).parquet(*done).join(wanted.select(*keys), keys, "left_semi").dropDuplicates(keys) if done else None
        make(wanted if have is None else wanted.join(have.select(*keys), keys, "left_anti")).write.parquet(path)
        made = spark.read.schema(schema).parquet(path)
        return made if have is None else have.select(*made.columns).union(made)

    selected = secrets.select_files(secrets.scan(files, external=external), names, overrides)
    if selected.isEmpty():
        return None
    wanted = selected.select("file", "content", "overridden", text.fingerprint(F.col("content")).alias("sha256"))
    parsed = stage("features", wanted, ["file", "sha256", "overridden"], features.features)
    saved = snapshots.manifest(parsed)
    known = parsed.select("file").limit(0).withColumn("summary", F.lit(""))
    if previous is not None:
        known = snapshots.reusable_summaries(saved, previous.manifest, previous.files)
        if regenerate_failed:
            known = known.where(F.col("summary") != scoring.FAILED)
    pending = parsed.join(known, "file", "left_anti")
    summarize = lambda df: (enrich.summarize(df, provider) if use_llm else enrich.structural(df)).join(df.select("file", "sha256"), "file")
    fresh = stage("summaries", pending, ["file", "sha256"], summarize)
    summaries = known.select("file", "summary").unionByName(fresh.select("file", "summary"))

    # references join the dependencies only now: summaries are about the file's own imports
    linked = references.with_references(parsed, references.references(parsed))
    scored = parsed.select("file", "signatures", "overridden").join(summaries, "file").select("file", "overridden", "summary", scoring.confidence(F.col("summary"), F.col("signatures")).alias("confidence"))
    placed = secrets.numbered(scored.withColumn("_name", F.col("file")).withColumn("file", F.concat(F.col("overridden").cast("string"), F.lit("/"), "file")))
    table = placed.select(F.col("_name").alias("file"), F.col("place").alias("ord"), "summary", "confidence")
    edges = graph.build(linked.select("file", "dependencies"))

    own_rules, guide = [], STRUCTURE_ONLY
    if use_llm:
        signed = parsed.where(F.size("signatures") > 0).select("file", "signatures")
        own_rules = policy.asked("rules", lambda: enrich.rules_of_all(signed, provider))
        guide = policy.asked("guide", lambda: enrich.guide(name, own_rules, provider))
    stack = tech_stack.tech_stack(manifests if manifests is not None else files)
    entry = F.struct(*(F.col(c) for c in ("manifest", "language", "package_manager", "dependencies", "dependencies_truncated")))
    stacks = stack.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", entry.alias("e")))), lambda x: x["e"]).alias("tech_stack"))
    project = stacks.select(F.lit(name).alias("name"), F.lit(guide).alias("prompt"), F.lit(json.dumps(own_rules)).alias("_r"), "tech_stack").select("name", "prompt", F.from_json("_r", "array<string>").alias("rules"), "tech_stack")
    counted = parsed.join(summaries, "file")
    tokens = scoring.savings(counted, F.col("content"), scoring.payload(F.col("summary")))
    made = Pack(table, parsed.select("file", "compressed"), saved, edges, project, tokens)
    if stages is not None:
        path = f"{stages}/../{Path(stages).name}.pack"
        save(made, path)
        made = load(spark, path)
        drop_stages()
    return made


# ---- edits


def edit_project(pack: Pack, *, name: str | None = None, prompt: str | None = None, rules: list[str] | None = None) -> Pack:
    """Other values for what isn't None; a blank name or guide keeps the old one."""
    p = pack.project
    for column, value in (("name", name), ("prompt", prompt)):
        if value and value.strip():
            p = p.withColumn(column, F.lit(value))
    if rules is not None:
        p = p.withColumn("rules", F.from_json(F.lit(json.dumps(rules)), "array<string>"))
    return replace(pack, project=p)


def rules_of(pack: Pack) -> list[str]:
    return list((pack.project.select("rules").head() or [[]])[0] or [])


def add_rule(pack: Pack, rule: str) -> Pack:
    return edit_project(pack, rules=[*rules_of(pack), rule])


def remove_rule(pack: Pack, index: int) -> Pack:
    rules = rules_of(pack)
    del rules[index]  # raises IndexError
    return edit_project(pack, rules=rules)


def edit_summaries(pack: Pack, edits: DataFrame, *, strict: bool = False) -> Pack:
    """Other summaries from (file, summary); blank ones keep the old, unknown files are ignored, or raise if strict."""
    if strict and (unknown := edits.join(pack.files, "file", "left_anti").head()):
        raise KeyError(unknown["file"])
    new = edits.select("file", F.col("summary").alias("_new"))
    files = pack.files.join(new, "file", "left").withColumn("summary", F.coalesce(F.nullif(F.trim("_new"), F.lit("")), "summary")).drop("_new")
    return replace(pack, files=files.select("file", "ord", "summary", "confidence"))


def edit_edges(pack: Pack, change: Callable[..., DataFrame], *names: str) -> Pack:
    """graph.link, graph.unlink or graph.move applied to the pack."""
    return replace(pack, edges=change(pack.edges, pack.files, *names))


CORRECTIONS = "ord int, field string, file string, value string"


def apply_corrections(pack: Pack, corrections: DataFrame) -> tuple[Pack, list[str]]:
    """(the pack with a table of corrections applied in their order, what couldn't be applied and why).

    Fields: name, prompt, rule_add (value), rule_remove (value: its number from 1), rule_replace (file: its number, value),
    summary (file, value), link, unlink and move (file, value: the other file).  One that fails is reported, and the rest
    goes on.  A person makes them, so they are few; summaries are applied together as a table.
    """
    problems: list[str] = []
    for r in corrections.where("field <> 'summary'").orderBy("ord").collect():
        try:
            if r["field"] in ("name", "prompt"):
                pack = edit_project(pack, **{r["field"]: r["value"]})
            elif r["field"] == "rule_add":
                pack = add_rule(pack, r["value"])
            elif r["field"] in ("rule_remove", "rule_replace"):
                rules, place = rules_of(pack), int(r["value"] if r["field"] == "rule_remove" else r["file"]) - 1
                if not 0 <= place < len(rules):
                    raise ValueError(f"no rule {place + 1}")
                rules[place : place + 1] = [] if r["field"] == "rule_remove" else [r["value"]]
                pack = edit_project(pack, rules=rules)
            elif r["field"] in ("link", "unlink", "move"):
                pack = edit_edges(pack, getattr(graph, r["field"]), r["file"], r["value"])
            else:
                raise ValueError(f"unknown field: {r['field']}")
        except (ValueError, TypeError) as e:  # a CycleError is a ValueError
            problems.append(f"{r['field']} {r['file'] or ''} {r['value'] or ''}: {e}")
    summaries = corrections.where("field = 'summary'").groupBy("file").agg(F.max_by("value", "ord").alias("summary"))
    problems += [f"summary {r['file']}: unknown file" for r in summaries.join(pack.files, "file", "left_anti").orderBy("file").collect()]
    return edit_summaries(pack, summaries), problems


def edit_saved_edges(spark: SparkSession, path: str, change: Callable[..., DataFrame], *names: str) -> None:
    """The same in place; only the edge table is written again.  One writer at a time holds the pack's lock file."""
    lock = f"{path.removeprefix('file://')}/.lock"
    handle = os.open(lock, os.O_CREAT | os.O_EXCL)
    try:
        pack = load(spark, path)
        save(edit_edges(pack, change, *names), path, only=("edges",))
    finally:
        os.close(handle)
        os.unlink(lock)


# ---- documents


def document(pack: Pack) -> dict:
    """The pack as one JSON document without files' texts, for exchange; a project's size, on the driver."""
    rows = pack.files.orderBy("ord").collect()
    lists = {r["file"]: {"internal": list(r["internal"]), "external": list(r["external"])} for r in graph.adjacency(pack.edges, pack.files).collect()}
    project = pack.project.head()
    return {
        "project": {"name": project["name"], "prompt": project["prompt"], "tech_stack": [s.asDict() for s in project["tech_stack"] or []]},
        "rules": list(project["rules"] or []),
        "tokens": {r["model"]: {"original": r["original"], "compressed": r["compressed"], "saved_pct": r["saved_pct"]} for r in pack.tokens.collect()},
        "files": {r["file"]: {"summary": r["summary"], "confidence": r["confidence"]} for r in rows},
        "relationships": {r["file"]: lists[r["file"]] for r in rows},
    }


def overview_text(pack: Pack) -> str:
    """Name, guide and rules as Markdown."""
    p = pack.project.head()
    return f"# {p['name']}\n\n{p['prompt'] or ''}\n\n## Rules\n" + "\n".join(f"- {r}" for r in p["rules"] or [])


def file_text(pack: Pack, file: str) -> str:
    """A file's summary and shortened text as Markdown."""
    entry, detail = (df.where(F.col("file") == file).head() for df in (pack.files, pack.detail))
    if detail is None:
        raise ValueError(f"unknown file: {file}")
    return f"# {file}\n\n{(entry['summary'] if entry else '') or ''}\n\n```\n{detail['compressed']}\n```"


def export_json(pack: Pack, path: str) -> list[str]:
    """<name>.json, <name>.detail.json and, if there is a manifest, <name>.cache.json; gives the paths."""
    base = path.removesuffix(".json")
    Path(base).parent.mkdir(parents=True, exist_ok=True)
    Path(f"{base}.json").write_text(json.dumps(document(pack), ensure_ascii=False, indent=2), encoding="utf-8")
    write_object(pack.detail, F.struct("compressed"), f"{base}.detail.json")
    out = [f"{base}.json", f"{base}.detail.json"]
    if not pack.manifest.isEmpty():
        out.append(f"{base}.cache.json")
        write_object(pack.manifest, F.col("sha256"), out[-1])
    return out


def write_object(df: DataFrame, value: Column, path: str) -> None:
    """One JSON object {file: value} in order of files, as json.dumps with an indent of 2 writes it.

    Rows come to the driver a partition at a time, so its memory is bounded by the largest partition, not by the table.
    """
    with open(path, "w", encoding="utf-8") as out:
        before = "{"
        for r in df.orderBy("file").select("file", value.alias("v")).toLocalIterator():
            v = r["v"].asDict() if isinstance(r["v"], Row) else r["v"]
            inner = json.dumps(v, ensure_ascii=False, indent=2).replace("\n", "\n  ")
            out.write(f"{before}\n  {json.dumps(r['file'], ensure_ascii=False)}: {inner}")
            before = ","
        out.write("{}" if before == "{" else "\n}")


def output_path(name: str, path: str | None = None, folder: str = "result") -> str:
    return path or f"{folder}/{name}.json"


def remove(path: str) -> None:
    shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def slug_of(spark: SparkSession, name: str) -> str:
    return spark.range(1).select(text.slug(F.lit(name))).head()[0]
