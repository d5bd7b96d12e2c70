"""Signatures, imports, HTTP routes and bodies of code in six languages.

No grammar is at hand, so each language has a scanner: comments and literals are blanked out first, which leaves brackets
and keywords that can be trusted, and blocks are then found by indentation, braces or ``end``.  Broken code is read as far
as it makes sense and never raises.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from pathlib import PurePosixPath

BODY_MARK = "    ⋮----"


@dataclass
class Source:
    """A text, the same with comments and literals blanked, and its string literals (start, end, value)."""

    text: str
    blank: str = ""
    strings: list[tuple[int, int, str]] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)

    def row(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def string_in(self, start: int, end: int) -> list[str]:
        return [v for s, e, v in self.strings if s >= start and e <= end]


_LITERALS = {
    ".py": r"(?P<c>#[^\n]*)|(?P<s>[rbufRBUF]{0,2}(?P<q>'''|\"\"\"|'|\"))",
    ".gd": r"(?P<c>#[^\n]*)|(?P<s>(?P<q>\"\"\"|'''|'|\"))",
    ".java": r"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>(?P<q>\"\"\"|'|\"))",
    ".js": r"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>(?P<q>'|\"|`))|(?P<r>(?<=[=(,:;!&|?{}\[\n])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\n])*\]|[^/\n\\])+/[a-z]*)",
    ".lua": r"(?P<c>--\[(?P<ce>=*)\[.*?(?:\](?P=ce)\]|\Z)|--[^\n]*)|(?P<l>\[(?P<le>=*)\[.*?(?:\](?P=le)\]|\Z))|(?P<s>(?P<q>'|\"))",
}
_LITERALS[".ts"] = _LITERALS[".js"]
_LITERALS = {k: re.compile(v, re.DOTALL) for k, v in _LITERALS.items()}
LANGUAGES = tuple(_LITERALS)


def scan(text: str, ext: str) -> Source:
    out, at, found = [], 0, []
    blanked = lambda s: re.sub(r"[^\n]", " ", s)
    pattern = _LITERALS[ext]
    while m := pattern.search(text, at):
        out.append(text[at : m.start()])
        end = m.end()
        if m.lastgroup == "s" or m.group("s") is not None:
            q = m.group("q")
            multi = len(q) == 3 or q == "`"
            close = re.compile(r"\\.|" + re.escape(q) + ("" if multi else r"|\n"), re.DOTALL)
            end = len(text)
            for c in close.finditer(text, m.end()):
                if c.group()[0] != "\\":
                    end = c.end() if c.group() != "\n" else c.start()
                    break
            inner = text[m.end() : end - len(q)] if text.endswith(q, m.end(), end) else text[m.end() : end]
            found.append((m.start(), end, inner))
        elif m.groupdict().get("l") is not None:
            found.append((m.start(), end, m.group("l")[2 + len(m.group("le")) : -2 - len(m.group("le"))]))
        piece = blanked(text[m.start() : end])
        if m.group("c") is None and len(piece) > 1:  # a literal is an expression, so it leaves a trace
            piece = "0" + piece[1:] if piece[0] == " " else piece
        out.append(piece)
        at = max(end, m.start() + 1)
    out.append(text[at:])
    starts = [0, *(m.end() for m in re.finditer(r"\n", text))]
    return Source(text, "".join(out), found, starts)


def closing(blank: str, at: int, pair: str = "()") -> int:
    """Where the bracket opened at ``at`` closes, or -1."""
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(blank, at):
        depth += 1 if m.group() == pair[0] else -1
        if not depth:
            return m.start()
    return -1


@dataclass
class Function:
    signature: str | None
    row: int  # of the definition's first token
    first: int  # the body's first and last place
    last: int
    end: int  # where the scan goes on
    braces: bool = False


def _indents(src: Source) -> list[tuple[int | None, int, int]]:
    """Per row: its indent (None for rows without code and for rows inside brackets or literals), first and last place of code."""
    rows, depth = [], 0
    inside = set()
    for s, e, _ in src.strings:
        inside.update(range(src.row(s) + 1, src.row(max(s, e - 1)) + 1))
    for k, start in enumerate(src.starts):
        end = src.starts[k + 1] - 1 if k + 1 < len(src.starts) else len(src.blank)
        line = src.blank[start:end]
        code = line.strip()
        continued = depth > 0 or k in inside
        rows.append((None if continued or not code else len(line) - len(line.lstrip()), start + len(line) - len(line.lstrip()) if code else -1, start + len(line.rstrip()) - 1 if code else -1))
        depth = max(0, depth + sum(map(code.count, "([{")) - sum(map(code.count, ")]}")))
        if code.endswith("\\"):
            inside.add(k + 1)
    return rows


def _block(rows: list[tuple[int | None, int, int]], head: int, indent: int) -> tuple[int, int]:
    """First and last row of the block below the head's row; the last is the first minus one if there is none."""
    first = last = -1
    for k in range(head + 1, len(rows)):
        if rows[k][0] is not None and rows[k][0] <= indent:
            break
        if rows[k][1] >= 0:
            first, last = (k if first < 0 else first), k
    return (first, last) if first >= 0 else (head + 1, head)


def _indented(src: Source, pattern: re.Pattern, constructor: str | None = None) -> list[Function]:
    rows, found, at = _indents(src), [], 0
    while m := pattern.search(src.blank, at):
        at = m.end()
        close = closing(src.blank, m.end() - 1)
        if close < 0:
            continue
        colon = src.blank.find(":", close)
        if colon < 0:
            continue
        tail = src.text[close + 1 : colon].strip()
        ret = tail[2:].strip() if tail.startswith("->") else ""
        name = m.group("name")
        signature = None if name == constructor else f"{name}{src.text[m.end() - 1 : close + 1]}" + (f" -> {ret}" if ret else "")
        row, colon_row = src.row(m.start("def")), src.row(colon)
        rest_end = src.starts[colon_row + 1] if colon_row + 1 < len(src.starts) else len(src.blank)
        rest = src.blank[colon + 1 : rest_end]
        if rest.strip():
            first = colon + 1 + len(rest) - len(rest.lstrip())
            last = colon + len(rest.rstrip())
            last_row = src.row(last)
        else:
            a, b = _block(rows, colon_row, m.start("def") - src.starts[row])
            if b < a:
                found.append(Function(signature, row, -1, -1, colon))
                continue
            first, last, last_row = rows[a][1], rows[b][2], b
        end = src.starts[last_row + 1] if last_row + 1 < len(src.starts) else len(src.blank)
        found.append(Function(signature, row, first, last, end))
        at = max(at, end)
    return found


_PY_DEF = re.compile(r"(?m)^[ \t]*(?P<def>(?:async[ \t]+)?def)[ \t]+(?P<name>\w+)[ \t]*(?:\[[^\]]*\][ \t]*)?\(")
_GD_DEF = re.compile(r"(?m)^[ \t]*(?:@\w+[ \t]+)*(?P<def>(?:static[ \t]+)?func)[ \t]+(?P<name>\w+)[ \t]*\(")
_NOT_NAMES = frozenset("if for while switch catch synchronized return new else throw do try function super this typeof await yield assert case instanceof in of delete void import with".split())
_MODIFIER = r"public|private|protected|static|final|abstract|native|synchronized|strictfp|default|async|override|readonly|get|set|declare|transient"
_JAVA_NAME = re.compile(r"(?P<type>[\w\]>?])\s+(?P<name>[A-Za-z_$]\w*)\s*\(")
_JS_FUNCTION = re.compile(r"(?P<def>(?:\basync\s+)?\bfunction)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^(){}]*>\s*)?\(")
_JS_METHOD = re.compile(r"(?P<name>#?[A-Za-z_$][\w$]*)\s*(?:<[^(){};]*>\s*)?\(")


def _braced(src: Source, ext: str) -> list[Function]:
    found, at, blank = [], 0, src.blank
    java = ext == ".java"
    while True:
        matches = [m for p in ((_JAVA_NAME,) if java else (_JS_FUNCTION, _JS_METHOD)) if (m := p.search(blank, at))]
        if not matches:
            return found
        m = min(matches, key=lambda m: (m.start(), -m.end()))
        at = m.end() - 1 if java else m.end()
        name, opened = m.group("name"), m.end() - 1
        is_function = m.re is _JS_FUNCTION
        if name in _NOT_NAMES:
            continue
        close = closing(blank, opened)
        if close < 0:
            continue
        before = blank[: m.start("type") + 1 if java else m.start("def") if is_function else m.start("name")].rstrip()
        rest = blank[close + 1 :]
        lead = len(rest) - len(rest.lstrip())
        ret = ""
        if java:
            word = re.search(r"(\w+)$", before)
            if word and (word[1] in _NOT_NAMES - {"void"} or re.fullmatch(_MODIFIER, word[1])):
                continue
            k = re.match(r"\s*(?:\[\s*\]\s*)*(?:throws\s+[\w.,\s<>@]+?)?\s*([{;])", rest)
            if not k:
                continue
            brace = close + 1 + k.start(1)
            begin = max(before.rfind(c) for c in ";{}") + 1
        else:
            if is_function:
                if before and before[-1] in "=(,:?&|+!~[<>" or re.search(r"\b(?:return|new|typeof|await|yield|void|in|of)$", before):
                    continue
            elif re.search(r"(?:\.|\bnew|\bfunction|\bfunction\s*\*|[=?&|+!<>~^%/)\]-])$", re.sub(rf"(?:\s*\b(?:{_MODIFIER})\b)*\s*\*?$", "", before)):
                continue
            brace = close + 1 + lead
            if blank[brace : brace + 1] == ":":  # a return type
                k = _type_end(blank, brace + 1)
                ret, brace = src.text[brace:k].strip(), k
            if blank[brace : brace + 1] != "{":
                continue
            begin = m.start("def") if is_function else len(before) - len(re.search(rf"(?:\b(?:{_MODIFIER})\b\s*)*\*?$", before).group())
        begin += len(blank[begin : m.end()]) - len(blank[begin : m.end()].lstrip())
        signature = f"{name}{src.text[opened : close + 1]}" + (f" -> {ret}" if ret else "")
        if blank[brace] == ";":
            found.append(Function(signature, src.row(begin), -1, -1, brace))
            at = brace
            continue
        end = closing(blank, brace, "{}")
        end = len(blank) - 1 if end < 0 else end
        found.append(Function(signature, src.row(begin), brace, end, end + 1, blank[end : end + 1] == "}"))
        at = end + 1


def _type_end(blank: str, at: int) -> int:
    """Where a TypeScript return type ends: the brace of the body at depth 0 that doesn't open an object type."""
    depth, k, seen = 0, at, False
    while k < len(blank):
        c = blank[k]
        if c == "{" and depth == 0 and seen:
            return k
        if c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and blank[k - 1] != "=":
            depth -= 1
            if depth < 0:
                return k
        elif c == ";" and depth == 0:
            return k
        if not c.isspace():
            seen = c not in "|&:"
        k += 1
    return k


_LUA_DEF = re.compile(r"(?P<def>(?:\blocal\s+)?\bfunction)\s+(?P<name>[\w.:]+)\s*\(")
_LUA_WORD = re.compile(r"\b(function|do|if|repeat|end|until)\b")


def _lua(src: Source) -> list[Function]:
    found, at = [], 0
    while m := _LUA_DEF.search(src.blank, at):
        at = m.end()
        close = closing(src.blank, m.end() - 1)
        if close < 0:
            continue
        depth, end = 1, len(src.blank)
        for w in _LUA_WORD.finditer(src.blank, close):
            depth += -1 if w[1] in ("end", "until") else 1
            if not depth:
                end = w.start()
                break
        body = src.blank[close + 1 : end]
        first = close + 1 + len(body) - len(body.lstrip()) if body.strip() else -1
        found.append(Function(f"{m['name']}{src.text[m.end() - 1 : close + 1]}", src.row(m.start("def")), first, close + len(body.rstrip()) if body.strip() else -1, end))
        at = end
    return found


def functions(src: Source, ext: str) -> list[Function]:
    if ext == ".py":
        return _indented(src, _PY_DEF)
    if ext == ".gd":
        return _indented(src, _GD_DEF, "_init")
    return _lua(src) if ext == ".lua" else _braced(src, ext)


_PY_IMPORT = re.compile(r"(?m)(?:^|;|:)[ \t]*(?:from[ \t]+(?P<module>\.*[ \t]*[\w.]*)[ \t]+import\b|import[ \t]+(?P<names>[\w.]+(?:[ \t]+as[ \t]+\w+)?(?:[ \t]*,[ \t]*[\w.]+(?:[ \t]+as[ \t]+\w+)?)*))")
_JAVA_IMPORT = re.compile(r"(?m)^\s*import\s+(?:static\s+)?([^;]+?)\s*;")
_JS_IMPORT = re.compile(r"(?m)(?:^|[;}])[ \t]*import\b(?!\s*[(.])")
_LUA_REQUIRE = re.compile(r"(?<![\w.:])require\b\s*(\()?\s*")
_GD_LOAD = re.compile(r"(?<!\w)(?:preload|load)\s*\(|(?m:^[ \t]*extends\s+)")


def imports(src: Source, ext: str) -> list[str]:
    found: list[str] = []
    if ext == ".py":
        for m in _PY_IMPORT.finditer(src.blank):
            if m["module"] is not None:
                if (name := m["module"].replace(" ", "")) != "__future__" and name:
                    found.append(name)
            else:
                found += [n.strip() for n in m["names"].split(",") if not re.search(r"\sas\s", n)]
    elif ext == ".java":
        found = [m[1] for m in _JAVA_IMPORT.finditer(src.blank)]
    elif ext in (".ts", ".js"):
        for m in _JS_IMPORT.finditer(src.blank):
            following = next(((s, v) for s, _, v in src.strings if s >= m.end()), None)
            if following and ";" not in src.blank[m.end() : following[0]]:
                found.append(following[1])
    elif ext == ".lua":
        for m in _LUA_REQUIRE.finditer(src.blank):
            close = closing(src.blank, m.start(1)) if m[1] else -1
            found += src.string_in(m.end(), close) if m[1] else [v for s, _, v in src.strings if s == m.end()]
    elif ext == ".gd":
        for m in _GD_LOAD.finditer(src.blank):
            if m.group().endswith("("):
                own = src.string_in(m.end(), closing(src.blank, m.end() - 1))
            else:
                own = [v for s, _, v in src.strings if s == m.end()]
            found += [PurePosixPath(v).stem for v in own]
    return found


_CHAIN = re.compile(r"[A-Za-z_]\w*(?:\s*\.\s*\w+)+")
_VERBS = ("get", "post", "put", "delete", "patch")


def routes(src: Source, ext: str) -> list[str]:
    """``GET /path`` of the first decorator of each decorated Python definition that isn't inside another one."""
    if ext != ".py":
        return []
    rows, found, k = _indents(src), [], 0
    while k < len(rows):
        indent, first, _ = rows[k]
        if indent is None or src.blank[first] != "@":
            k += 1
            continue
        after = k + 1
        while after < len(rows) and rows[after][0] is None:
            after += 1
        end = src.starts[after] if after < len(rows) else len(src.blank)
        chain = _CHAIN.search(src.blank, first, end)
        path = next((v for v in src.string_in(first, end) if v), None)
        verb = next((v for v in _VERBS if chain and f".{v}" in chain.group()), None)
        if verb and path:
            found.append(f"{verb.upper()} {path}")
        head = after
        while head < len(rows) and (rows[head][0] is None or src.blank[rows[head][1]] == "@"):
            head += 1
        k = max(head, _block(rows, head, indent)[1]) + 1
    return found


def compressed(src: Source, ext: str, own: list[Function] | None = None) -> str:
    """The text with each body's lines replaced by one mark."""
    spans: dict[int, int] = {}
    for f in own if own is not None else functions(src, ext):
        if f.first < 0:
            continue
        first, last = src.row(f.first), src.row(f.last)
        first += first == f.row
        last -= f.braces
        if last >= first:
            spans.setdefault(first, last)
    kept, lines, k = [], src.text.splitlines(), 0
    while k < len(lines):
        if k in spans:
            kept.append(BODY_MARK)
            k = spans[k] + 1
        else:
            kept.append(lines[k])
            k += 1
    return "\n".join(kept)


def parse(text: str, ext: str) -> dict | None:
    """All four features from one scan, or None for other kinds of files."""
    if ext not in _LITERALS:
        return None
    src = scan(text, ext)
    own = functions(src, ext)
    return {"signatures": [f.signature for f in own if f.signature], "dependencies": imports(src, ext), "api": routes(src, ext), "compressed": compressed(src, ext, own)}


def outline(text: str, ext: str) -> list[tuple[int, str, str]]:
    """(depth, kind, first 30 characters) of what the scanner sees: a debugging aid."""
    if ext not in _LITERALS:
        return []
    src = scan(text, ext)
    rows = [(0, "module", text[:30])]
    rows += [(1, "import", i[:30]) for i in imports(src, ext)]
    for f in functions(src, ext):
        rows.append((1, "function", (f.signature or "")[:30]))
        if f.first >= 0:
            rows.append((2, "body", text[f.first : f.first + 30]))
    return rows
