"""Packs made in the background of a driver: started, watched, reviewed, finished or stopped."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, scoring, secrets
from ..sources import project_tree
from . import pack as packs

KEPT = 20
LOCKS = 200


class PathLocks:
    """A lock per path, so that changes of different packs don't wait for each other.

    Beyond ``kept`` paths the oldest ones that nobody holds or waits for are forgotten.
    """

    def __init__(self, kept: int = LOCKS):
        self.kept, self.guard = kept, threading.Lock()
        self.known: dict[str, tuple[threading.Lock, list[None]]] = {}

    @contextmanager
    def of(self, path: str) -> Iterator[None]:
        with self.guard:
            lock, users = self.known.setdefault(os.path.normpath(path), (threading.Lock(), []))
            users.append(None)
        try:
            with lock:
                yield
        finally:
            with self.guard:
                users.pop()
                free = [p for p, (_, u) in self.known.items() if not u]
                for old in free[: max(0, len(self.known) - self.kept)]:
                    del self.known[old]


@dataclass
class Job:
    id: str
    project: str
    output: str
    retry: dict
    state: str = "running"
    log: list[str] = field(default_factory=list)
    error: str | None = None
    result: str | None = None
    pack: packs.Pack | None = None
    stop: threading.Event = field(default_factory=threading.Event)
    keep: bool = True
    lock: threading.RLock = field(default_factory=threading.RLock)
    thread: threading.Thread | None = None


class Jobs:
    def __init__(self, spark: SparkSession, kept: int = KEPT):
        self.spark, self.kept, self.jobs, self.lock = spark, kept, {}, threading.Lock()

    def selectable(self, project: str) -> dict:
        """Safe files by name, and dangerous ones with the reason."""
        scanned = secrets.scan(project_tree.read(self.spark, project))
        return {"safe": [r["file"] for r in secrets.safe(scanned).select("file").orderBy("file").collect()], "dangerous": [r.asDict() for r in secrets.dangerous(scanned).orderBy("file").collect()]}

    def start(self, project: str, output: str, *, selected: list[str] | None = None, use_cache: bool = True, use_llm: bool = True, provider: str | None = None) -> str:
        job = Job(uuid.uuid4().hex, project, output, {"project": project, "output": output, "selected": selected, "use_cache": use_cache, "use_llm": use_llm})
        with self.lock:
            done = [j for j in self.jobs.values() if j.state in ("done", "error", "cancelled")]
            for old in done[: max(0, len(done) - self.kept + 1)]:
                del self.jobs[old.id]
            self.jobs[job.id] = job
        job.thread = threading.Thread(target=self._run, args=(job, selected, use_cache, use_llm, provider), daemon=True)
        job.thread.start()
        return job.id

    def _run(self, job: Job, selected: list[str] | None, use_cache: bool, use_llm: bool, provider: str | None) -> None:
        try:
            files = project_tree.read(self.spark, job.project)
            previous = None
            if use_cache:
                try:
                    previous = packs.load(self.spark, job.output)
                    previous.manifest.head()
                except Exception:  # noqa: BLE001 - no pack there yet
                    previous = None
            names = self.spark.createDataFrame([(n,) for n in selected], "file string") if selected else None
            job.log.append("parsing and summarizing")
            pack = packs.build(self.spark, files, job.project.rstrip("/").rpartition("/")[2], use_llm=use_llm, provider=provider, names=names, previous=previous, cancelled=job.stop.is_set, stages=f"{job.output}.stages", policy=packs.Policy(keep=lambda: job.keep))
            with job.lock:
                if job.stop.is_set():
                    job.state, job.error = "cancelled", "stopped"
                elif pack is None:
                    job.state, job.error = "error", "no files selected"
                else:
                    # the review reads the pack again and again, so it is stored before
                    held = f"{job.output}.review-{job.id}"
                    job.pack, job.state = packs.load(self.spark, packs.save(pack, held)), "reviewing"
                    packs.remove(f"{job.output}.stages.pack")
                    job.log.append("ready for review")
        except packs.Cancelled:
            job.state, job.error = "cancelled", "stopped"
        except Exception as e:  # noqa: BLE001 - a job's failure is its result
            job.state, job.error = "error", f"{type(e).__name__}: {e}"[:500]

    def _job(self, job_id: str, *states: str) -> Job:
        job = self.jobs.get(job_id)
        if job is None:
            raise ValueError(f"unknown job: {job_id}")
        if states and job.state not in states:
            raise ValueError(f"the job is {job.state}")
        return job

    def status(self, job_id: str, since: int = 0) -> dict:
        """The state, and the log from line ``since`` on."""
        job = self._job(job_id)
        return {"state": job.state, "log": job.log[since:], "log_len": len(job.log), "result": job.result, "error": job.error, "retry": job.retry if job.state == "error" else None}

    def reviewing(self) -> bool:
        return any(j.state == "reviewing" for j in self.jobs.values())

    def review(self, job_id: str) -> dict:
        """Files to look at first, the rest, and the graph as it is now."""
        pack = self._job(job_id, "reviewing").pack
        low, rest = scoring.triage(pack.files)
        return {"needs_review": [r.asDict() for r in low.collect()], "auto_kept": [r["file"] for r in rest.select("file").collect()], "relationships": packs.document(pack)["relationships"]}

    def _edit(self, job_id: str, change: Callable[..., DataFrame], src: str, dst: str) -> dict:
        job = self._job(job_id, "reviewing")
        with job.lock:
            job.pack = packs.edit_edges(job.pack, change, src, dst)
            return packs.document(job.pack)["relationships"]

    def link(self, job_id: str, src: str, dst: str) -> dict:
        return self._edit(job_id, graph.link, src, dst)

    def unlink(self, job_id: str, src: str, dst: str) -> dict:
        return self._edit(job_id, graph.unlink, src, dst)

    def stop(self, job_id: str, save: bool = True) -> None:
        """Ask a running job to end at its next stage, and to keep what it has done for the next run, or not."""
        job = self._job(job_id, "running")
        job.keep = save
        job.stop.set()

    def discard(self, job_id: str) -> None:
        job = self._job(job_id, "reviewing")
        packs.remove(f"{job.output}.review-{job.id}")
        job.pack, job.state, job.error = None, "cancelled", "discarded"

    def finish(self, job_id: str, *, name: str | None = None, prompt: str | None = None, rules: list[str] | None = None, summaries: dict[str, str] | None = None) -> str:
        """Apply the edits and save; blank fields keep their old values, unknown files are ignored."""
        job = self._job(job_id, "reviewing")
        with job.lock:
            job.state = "finalizing"
            pack = packs.edit_project(job.pack, name=name, prompt=prompt, rules=rules)
            if summaries:
                pack = packs.edit_summaries(pack, self.spark.createDataFrame(list(summaries.items()), "file string, summary string"))
            job.result = packs.save(pack, job.output)
            packs.remove(f"{job.output}.review-{job.id}")
            job.pack, job.state = None, "done"
        return job.result


def newest(entries: DataFrame, most: int = 8) -> DataFrame:
    """The newest entry (pack, opened) of each pack, a few of them."""
    return entries.groupBy("pack").agg(F.max("opened").alias("opened")).orderBy(F.desc("opened")).limit(most)
