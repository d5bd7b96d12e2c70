"""Shortened forms of JSON, Markdown and plain text, and the choice among them by extension."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from itertools import groupby

from . import code

MARK = "⋮----"
#: What a mark says about what was left out.
LEFT_OUT = {"lines": "줄 생략", "items": "개 항목 생략", "rows": "개 행 생략", "text": "생략"}
TEXT, ARRAY, LIST, TABLE, FENCE, BLOCK = 200, 3, 5, 5, 10, 10


def mark(kind: str, n: int | None = None) -> str:
    return f"{MARK} ({'' if n is None else n}{LEFT_OUT[kind]})"


def shortened(text: str) -> str:
    return text if len(text) <= TEXT else f"{text[:TEXT]} {mark('text')}"


def capped(lines: list[str], most: int, kind: str) -> list[str]:
    return lines if len(lines) <= most else [*lines[:most], mark(kind, len(lines) - most)]


def compress_json(text: str) -> str:
    def short(v):
        if isinstance(v, dict):
            return {k: short(x) for k, x in v.items()}
        if isinstance(v, list):
            return [short(x) for x in v[:ARRAY]] + ([mark("items", len(v) - ARRAY)] if len(v) > ARRAY else [])
        return shortened(v) if isinstance(v, str) else v

    try:
        return json.dumps(short(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return text


def compress_txt(text: str) -> str:
    out: list[str] = []
    block: list[str] = []
    for line in [*text.splitlines(), None]:
        if line is not None and line.strip():
            block.append(shortened(line))
            continue
        out += capped(block, BLOCK, "lines")
        block = []
        if line is not None:
            out.append(line)
    return "\n".join(out)


FENCED = {"py": ".py", "python": ".py", "gd": ".gd", "gdscript": ".gd", "lua": ".lua", "java": ".java", "js": ".js", "javascript": ".js", "jsx": ".js", "ts": ".ts", "tsx": ".ts", "typescript": ".ts"}
_KINDS = (("fence", re.compile(r"\s*(```|~~~)")), ("list", re.compile(r"\s*(?:[-*+]|\d+[.)])\s+")), ("table", re.compile(r"\s*\|.*\|\s*$")), ("kept", re.compile(r"\s*#{1,6}\s")))


def _kind(line: str) -> str:
    return "kept" if not line.strip() else next((k for k, p in _KINDS if p.match(line)), "paragraph")


def compress_markdown(text: str) -> str:
    lines, out, k = text.splitlines(), [], 0
    while k < len(lines):
        kind, start = _kind(lines[k]), k
        k += 1
        if kind == "fence":
            tick = _KINDS[0][1].match(lines[start])[1]
            while k < len(lines) and not lines[k].strip().startswith(tick):
                k += 1
            body, tag = lines[start + 1 : k], lines[start].strip().removeprefix(tick).strip().lower()
            if tag in FENCED:
                body = code.parse("\n".join(body), FENCED[tag])["compressed"].splitlines()
            out += [lines[start], *capped(body, FENCE, "lines"), *lines[k : k + 1]]
            k += 1
            continue
        while kind != "kept" and k < len(lines) and _kind(lines[k]) == kind:
            k += 1
        run = lines[start:k]
        if kind == "list":
            out += capped(run, LIST, "items")
        elif kind == "table":
            out += run[:2] + capped(run[2:], TABLE, "rows")
        elif kind == "paragraph" and len("\n".join(run)) > TEXT:
            out.append(shortened("\n".join(run)))
        else:
            out += run
    return "\n".join(out)


#: Unicode's space separators; lines of prose that hold nothing else are blank.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def compress_prose(text: str) -> str:
    """Markdown known to be paragraphs only: what looks like a list, table, heading or fence in it is text.

    Lines end in LF alone, a last LF opens no further line, and an empty text is one blank line.
    """
    out = []
    for blank, run in groupby(text.removesuffix("\n").split("\n"), lambda line: not line.strip(SPACES)):
        out += run if blank else [shortened("\n".join(run))]
    return "\n".join(out)


COMPRESSORS: dict[str, Callable[[str], str]] = {".json": compress_json, ".md": compress_markdown, ".txt": compress_txt}


def compress(text: str, ext: str) -> str:
    """By the code scanner, else by the extension's compressor, else unchanged."""
    parsed = code.parse(text, ext)
    return parsed["compressed"] if parsed else COMPRESSORS.get(ext, lambda t: t)(text)
