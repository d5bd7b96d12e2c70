"""Summaries, rules and a guide from a language model behind a small protocol.

Requests hold several files each, run inside executors (``applyInPandas`` over numbered batches, so the number of
requests at once is the number of partitions), and what fails falls back to one request per file, then to a placeholder.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scoring
from ..operators.secrets import numbered

BATCH, WORKERS, PREFIX = 8, 4, 500


class Provider(Protocol):
    def generate(self, prompt: str) -> str:
        """The model's reply to a prompt, JSON; "{}" if there is none."""


class Mock:
    """Fixed replies of the right shape, chosen by the field that a prompt asks for."""

    def generate(self, prompt: str) -> str:
        asked = next((k for k in ("rules", "relationships", "prompt", "summaries") if f'"{k}"' in prompt), "summary")
        if asked == "summaries":
            return json.dumps({asked: {n: "A fixed summary." for n in re.findall(r"(?m)^File: (.+)$", prompt)}})
        return json.dumps({asked: {"rules": ["a fixed rule"], "relationships": {}, "prompt": "A fixed guide."}.get(asked, "A fixed summary.")})


class Rest:
    """A model behind an HTTP endpoint; busy replies (429, 503) are tried again after 5, 10, ... seconds."""

    def __init__(self, url: str, send: Callable[[str, str], tuple[int, str]] | None = None, tries: int = 5, wait: float = 5.0):
        self.url, self.send, self.tries, self.wait = url, send or _post, tries, wait

    def generate(self, prompt: str) -> str:
        for k in range(self.tries):
            try:
                status, reply = self.send(self.url, prompt)
            except OSError:
                break
            if status == 200:
                return unfenced(reply)
            if status not in (429, 503):
                break
            time.sleep(self.wait * (k + 1))
        return "{}"


def _post(url: str, prompt: str) -> tuple[int, str]:
    from urllib import error, request

    try:
        with request.urlopen(request.Request(url, json.dumps({"prompt": prompt}).encode(), {"Content-Type": "application/json"})) as r:  # noqa: S310
            return r.status, r.read().decode()
    except error.HTTPError as e:
        return e.code, ""


PROVIDERS: dict[str, Callable[[], Provider]] = {"mock": Mock, "rest": lambda: Rest(os.environ["SPARKLOOM_LLM_URL"])}


def maker(name: str | Callable[[], Provider] | None = None) -> Callable[[], Provider]:
    """What makes a provider; looked up on the driver and sent to workers, which need not know the name."""
    return name if callable(name) else PROVIDERS[name or os.environ.get("SPARKLOOM_LLM", "mock")]


def provider(name: str | Callable[[], Provider] | None = None) -> Provider:
    return maker(name)()


def unfenced(reply: str) -> str:
    """A reply without the lines of Markdown fences."""
    return "\n".join(line for line in reply.splitlines() if not line.strip().startswith("```")).strip()


def parsed(reply: str) -> dict:
    try:
        data = json.loads(unfenced(reply))
    except ValueError:
        return {}
    return data if isinstance(data, dict) else {}


def described(file: str, signatures: list[str], dependencies: list[str], content: str) -> str:
    """A file's part of a prompt: its structure if it has any, else how it begins."""
    if len(signatures) or len(dependencies):
        return f"File: {file}\nFunctions: {', '.join(signatures)}\nImports: {', '.join(dependencies)}"
    return f"File: {file}\nBegins:\n{content[:PREFIX]}"


def summarize(pending: DataFrame, name: str | None = None, *, batch: int = BATCH, workers: int = WORKERS) -> DataFrame:
    """(file, summary) for (file, signatures, dependencies, compressed)."""
    made_by = maker(name)

    def ask(group: pd.DataFrame) -> pd.DataFrame:
        model, parts = provider(made_by), {}
        for r in group.itertuples():
            parts[r.file] = described(r.file, list(r.signatures), list(r.dependencies), r.compressed or "")
        together = "Say in one line what each file does.\n" + "\n\n".join(parts.values()) + '\nReply as {"summaries": {"<file>": "..."}}'
        found = parsed(model.generate(together)).get("summaries")
        found = found if isinstance(found, dict) else {}
        out = []
        for file, part in parts.items():
            summary = found.get(file)
            if not isinstance(summary, str) or not summary:
                summary = parsed(model.generate(f'Say in one line what the file does.\n{part}\nReply as {{"summary": "..."}}')).get("summary")
            out.append((file, summary if isinstance(summary, str) and summary else scoring.FAILED))
        return pd.DataFrame(out, columns=["file", "summary"])

    dealt = numbered(pending.select("file", "signatures", "dependencies", "compressed")).withColumn("_batch", F.floor((F.col("place") - 1) / batch))
    return dealt.repartition(workers, "_batch").groupBy("_batch").applyInPandas(ask, "file string, summary string")


def structural(pending: DataFrame) -> DataFrame:
    """(file, summary) without a model."""
    return pending.select("file", scoring.structural_summary(F.col("signatures"), F.col("dependencies")).alias("summary"))


def rules(signatures: dict[str, list[str]], name: str | Callable[[], Provider] | None = None) -> list[str] | None:
    """Coding rules that the signatures suggest; None if the model gave none."""
    listing = "\n".join(f"{f}: {', '.join(s)}" for f, s in signatures.items())
    found = parsed(provider(name).generate(f'Which coding rules do these functions follow?\n{listing}\nReply as {{"rules": ["..."]}}')).get("rules")
    return [r for r in found if isinstance(r, str)] if isinstance(found, list) else None


#: Signatures in a request for rules, at most.
SIGNATURES = 2000


def rules_of_all(signed: DataFrame, name: str | None = None, *, most: int = SIGNATURES) -> list[str] | None:
    """Rules from all signatures of (file, signatures): asked for in executors, a block of files at a time, and put together.

    None if no block gave any and there is something to ask about.
    """
    parts = signed.select("file", F.posexplode("signatures").alias("pos", "signature"))
    placed = numbered(parts.withColumn("_own", F.col("file")).withColumn("file", F.concat_ws("\0", "file", F.lpad(F.col("pos").cast("string"), 9, "0"))))
    dealt = placed.select(F.col("_own").alias("file"), "signature", "place", F.floor((F.col("place") - 1) / most).alias("_block"))

    made_by = maker(name)

    def ask(block: pd.DataFrame) -> pd.DataFrame:
        listing = {f: list(g["signature"]) for f, g in block.sort_values("place").groupby("file", sort=False)}
        found = rules(listing, made_by)
        return pd.DataFrame([(int(block["_block"].iloc[0]), k, r) for k, r in enumerate(found or [])] or [(int(block["_block"].iloc[0]), -1, "" if found is None else "-")], columns=["block", "k", "rule"])

    rows = dealt.groupBy("_block").applyInPandas(ask, "block bigint, k int, rule string").orderBy("block", "k").collect()  # a model's replies
    if rows and all(r["k"] < 0 and not r["rule"] for r in rows):
        return None
    return list(dict.fromkeys(r["rule"] for r in rows if r["k"] >= 0))


def guide(project: str, own_rules: list[str], name: str | None = None) -> str | None:
    """A guide to the project; None if the model gave none."""
    found = parsed(provider(name).generate(f'Write a short guide to the project {project}. Rules: {"; ".join(own_rules)}\nReply as {{"prompt": "..."}}')).get("prompt")
    return found if isinstance(found, str) else None
