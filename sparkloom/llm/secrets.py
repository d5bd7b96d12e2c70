"""Secret scans over every layer of a text.

A worklist holds layers.  Each is scanned, then unwrapped: escapes of URLs and of Unicode (percent, \\u, \\x, HTML
references) are replaced throughout the layer; runs of base64, joined over line breaks, are decoded from each of their
first four letters, and what they hold of the known compressed formats is inflated.  Of decoded bytes the readable
stretches are scanned, whatever lies beside them.  What comes out is a new layer unless its digest was seen before at the same span of the original text,
so that the work ends at a fixpoint even where layers contain each other, and a layer that occurs at several places is
followed at each of them.  Every layer maps its positions to its parent's; a secret found inside is reported
as the span of the original text that it came from.

Nulls, ties, repeats: a null text is an empty one; rows are scanned each for itself, so repeats give repeats; findings at
the same start are ordered by kind (assign, access, hex), then end.  Compressed layers are inflated however deep they lie
in each other, streams right behind one another together; a stream of more than LARGEST bytes (a decompression bomb) is
scanned in blocks of that size, so that memory is bounded, and each begins with the OVERLAP bytes before it: only what
is longer than those and crosses a block's border can be lost.  A finding inside is left out only if earlier ones of its
kind cover it.  Of a damaged stream, what came before is scanned.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import lzma
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, chain
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Out

KINDS = ("assign", "access", "hex")
LARGEST = 64 << 20
#: What two neighbouring blocks of a larger stream share.
OVERLAP = 8 << 20
#: Bytes that go into a decoder and come out of it at once.
CHUNK, PIECE = 1 << 12, 1 << 16

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
_KEYS = ("passw", "secret", "token", "api")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:quot|apos|amp|lt|gt|equals|colon|sol|lowbar|plus|period);")
#: Runs of 16 letters at least, or over line breaks; each starts at a letter that no other precedes.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{16}|[A-Za-z0-9+/_-]++[ \t]*+[\r\n])[A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r\n?|\n)[ \t]*+[A-Za-z0-9+/_-]++)*+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: Findings are of ASCII and have 14 letters at least; these are bytes that may hold one, also as UTF-16.
_STRETCH = re.compile(rb"[\t-\r\x20-\x7e]{14}")
_WIDE = [(re.compile(rb"(?:[\t-\r\x20-\x7e]\x00){14,}"), 0), (re.compile(rb"(?:\x00[\t-\r\x20-\x7e]){14,}"), 1)]
_PRINTED = bytes(c if 9 <= c <= 13 or 32 <= c <= 126 else 0 for c in range(256))
_HEAD = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")
LONGEST_HEAD = 6
_ZLIB = type(zlib.decompressobj())

Span = tuple[str, int, int]


def plain_spans(text: str) -> list[Span]:
    """The contract's findings in one text: leftmost, non-overlapping for each kind, too short ones dropped."""
    found = []
    lower = text.lower()
    if any(k in lower for k in _KEYS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A text with the way back: pieces of it, each copied from its parent (a shift) or standing for one of its spans."""

    def __init__(self, text: str, parent: Layer | None = None, starts: list[int] | None = None, origins: list[tuple[int, int, bool]] | None = None):
        self.text, self.parent, self.starts, self.origins = text, parent, starts or [], origins or []

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The original text's span behind text[start:end]."""
        layer, a, b = self, start, end
        while layer.parent is not None:
            layer, (a, b) = layer.parent, layer.up(a, b)
        return a, b

    def up(self, a: int, b: int) -> tuple[int, int]:
        """The parent's span behind text[a:b]."""
        (s, e, copied), at = self.origins[k := bisect_right(self.starts, a) - 1], self.starts[k]
        low = s + a - at if copied else s
        (s, e, copied), at = self.origins[k := bisect_right(self.starts, b - 1) - 1], self.starts[k]
        return low, s + b - at if copied else e


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match decoded; decode gives (characters, letters of the match for each, 0: all of it)."""
    parts, starts, origins, at, size = [], [], [], 0, 0

    def put(text: str, start: int, end: int, copied: bool) -> None:
        nonlocal size
        if text:
            parts.append(text)
            starts.append(size)
            origins.append((start, end, copied))
            size += len(text)

    for m in pattern.finditer(layer.text):
        got = decode(m.group())
        if got is None:
            continue
        chars, step = got
        put(layer.text[at : m.start()], at, m.start(), True)
        at = m.end()
        if step:
            for k, c in enumerate(chars):
                put(c, m.start() + step * k, m.start() + step * (k + 1), False)
        else:
            put(chars, m.start(), m.end(), False)
    if not at:
        return None
    put(layer.text[at:], at, len(layer.text), True)
    return Layer("".join(parts), layer, starts, origins)


def _percent(run: str) -> tuple[str, int] | None:
    data = bytes.fromhex(run.replace("%", ""))
    if data.isascii():
        return data.decode(), 3
    try:
        return data.decode(), 0
    except UnicodeDecodeError:
        return None


def _escape(run: str) -> tuple[str, int] | None:
    if run[0] == "&":
        return html.unescape(run), 0
    code = int(run[2:], 16)
    return (chr(code), 0) if code < 0xD800 or 0xDFFF < code < 0x110000 else None


def _fed(made, data: bytes) -> Iterator[bytes]:
    """What comes out when data goes in, in pieces of bounded size."""
    while True:
        if out := made.decompress(data, PIECE):
            yield out
        data = getattr(made, "unconsumed_tail", b"")
        if made.eof or (not data and len(out) < PIECE if isinstance(made, _ZLIB) else made.needs_input):
            return


class Inflated:
    """What a compressed stream and those right behind it hold, in pieces; end is where they end, sound whether undamaged."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.end, self.sound = chunks, 0, True

    def __iter__(self) -> Iterator[bytes]:
        held = b""
        while True:
            while len(held) < LONGEST_HEAD and (more := next(self.chunks, b"")):
                held += more
            if self.end and held[:1] == b"\0":  # padding between streams
                self.end += len(held) - len(held := held.lstrip(b"\0"))
                continue
            if not (head := _HEAD.match(held)):
                return
            made = zlib.decompressobj(31) if head[0][:1] == b"\x1f" else zlib.decompressobj(15) if head[0][:1] == b"x" else bz2.BZ2Decompressor() if head[0][:1] == b"B" else lzma.LZMADecompressor()
            while not made.eof:
                data = held[:CHUNK] or next(self.chunks, b"")
                held = held[CHUNK:]
                if not data:
                    self.sound = False
                    return
                self.end += len(data)
                spare, put = made.copy() if isinstance(made, _ZLIB) else None, 0
                try:
                    for out in _fed(made, data):
                        put += len(out)
                        yield out
                except (zlib.error, OSError, EOFError, lzma.LZMAError):
                    self.sound = False
                    if spare is not None:
                        yield from _before_damage(spare, data, put)
                    return
            self.end -= len(made.unused_data)
            held = made.unused_data + held


def _before_damage(made, data: bytes, put: int) -> Iterator[bytes]:
    """zlib gives nothing of the call that meets the damage: byte by byte, then, but for the first put bytes."""
    try:
        for k in range(len(data)):
            for out in _fed(made, data[k : k + 1]):
                if len(out) > put:
                    yield out[put:]
                put = max(0, put - len(out))
    except zlib.error:
        return


def _chunks(data: bytes, at: int = 0) -> Iterator[bytes]:
    return (data[k : k + CHUNK] for k in range(at, len(data), CHUNK))


def inflate(data: bytes, largest: int = LARGEST) -> bytes | None:
    """The first bytes of data inflated, if it starts like gzip, zlib, bzip2 or xz; what comes out of a damaged stream before the damage."""
    parts, size = [], 0
    for part in Inflated(_chunks(data)):
        parts.append(part[: largest - size])
        size += len(parts[-1])
        if size >= largest:
            break
    return b"".join(parts) or None


def _blocks(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The pieces as blocks of about LARGEST bytes at most; each begins with the end of the one before it."""
    held, size, fresh = [], 0, False
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        fresh = True
        if size >= LARGEST:
            block = b"".join(held)
            yield block
            held, size, fresh = [block[-OVERLAP:]], min(size, OVERLAP), False
    if fresh:
        yield b"".join(held)


class Packed(NamedTuple):
    """Bytes that stand for a part of a layer; place gives the layer's span behind data[a:b]."""

    data: bytes
    layer: Layer
    place: Callable[[int, int], tuple[int, int]]


class Reading(Layer):
    """Bytes as a text: its k-th letter is the one at offset + step * k."""

    def __init__(self, text: str, packed: Packed, offset: int, step: int):
        super().__init__(text, packed.layer)
        self.place, self.offset, self.step = packed.place, offset, step

    def up(self, a: int, b: int) -> tuple[int, int]:
        return self.place(self.offset + self.step * a, self.offset + self.step * b)


def _contents(stream: Inflated, layer: Layer, span: tuple[int, int]) -> Iterator[Packed]:
    """All that a stream holds; what is too large for one block is inflated further as it comes, or given in blocks."""
    pieces = iter(stream)
    blocks = _blocks(pieces)
    first = next(blocks, None)
    if first is not None and len(first) >= LARGEST and _HEAD.match(first):
        yield from _contents(Inflated(chain(_chunks(first), pieces)), layer, span)
    elif first is not None:
        for block in chain([first], blocks):
            yield Packed(block, layer, lambda a, b: span)


def _unpacked(packed: Packed) -> Iterator[Layer | Packed]:
    """The readable stretches of the bytes, and what streams anywhere in them hold."""
    data, layer, place = packed
    if _STRETCH.search(data):
        yield Reading(data.translate(_PRINTED).decode("ascii"), packed, 0, 1)
    if b"\0" in data:
        for pattern, first in _WIDE:
            for m in pattern.finditer(data):
                yield Reading(m.group()[first::2].decode("ascii"), packed, m.start(), 2)
    at = 0
    while m := _HEAD.search(data, at):
        at, ahead = m.start() + 1, Inflated(_chunks(data, m.start()))
        if any([bool(piece) for piece in ahead]):  # read once for its end, and then for what it holds
            yield from _contents(Inflated(_chunks(data, m.start())), layer, place(m.start(), m.start() + ahead.end))
            at = m.start() + ahead.end if ahead.sound else at


def _base64_layers(layer: Layer) -> Iterator[Packed]:
    """Runs decoded from each of their first four letters, as it isn't known where a code begins; places are whole lines."""
    for m in _BASE64.finditer(layer.text):
        if m.end() - m.start() < 16:
            continue
        lines = [line.span() for line in _LINE.finditer(layer.text, *m.span())]
        run = "".join([layer.text[a:b] for a, b in lines]).rstrip("=").replace("-", "+").replace("_", "/")
        starts = list(accumulate((b - a for a, b in lines[:-1]), initial=0))
        for skip in range(4):
            code = run[skip : len(run) - ((len(run) - skip) % 4 == 1)]
            data = base64.b64decode(code + "=" * (-len(code) % 4))
            if _STRETCH.search(data) or _HEAD.search(data) or (b"\0" in data and any(p.search(data) for p, _ in _WIDE)):

                def place(a: int, b: int, skip=skip, lines=lines, starts=starts) -> tuple[int, int]:
                    return lines[bisect_right(starts, skip + 4 * a // 3) - 1][0], lines[bisect_right(starts, skip + (8 * b - 1) // 6) - 1][1]

                yield Packed(data, layer, place)


def _inside(layer: Layer) -> Iterator[Layer | Packed | None]:
    """What a layer unwraps to."""
    if "%" in layer.text:
        yield _replaced(layer, _PERCENT, _percent)
    if "\\" in layer.text or "&" in layer.text:
        yield _replaced(layer, _ESCAPE, _escape)
    yield from _base64_layers(layer)


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """(the plain findings, all findings), ordered by start, kind and end."""
    text = text or ""
    base = plain_spans(text)
    spans = list(base)
    taken: dict[str, list[tuple[int, int]]] = {k: [(s, e) for kind, s, e in base if kind == k] for k in KINDS}  # sorted, disjoint
    first = Layer(text)
    work, seen = [_inside(first)], {(_digest(text), False, 0, len(text))}
    while work:  # iterators of what is to be done, so that only one block of a large stream is held
        new = next(work[-1], work)
        if new is work:
            work.pop()
            continue
        if new is None:
            continue
        packed = isinstance(new, Packed)
        mark = (_digest(new.data), True, *new.layer.back(*new.place(0, len(new.data)))) if packed else (_digest(new.text), False, *new.back(0, len(new.text)))
        if mark in seen:
            continue
        seen.add(mark)
        work.append(_unpacked(new) if packed else _inside(new))
        for kind, start, end in [] if packed else plain_spans(new.text):
            a, b = new.back(start, end)
            own, k = taken[kind], bisect_right(taken[kind], a, key=lambda span: span[1])
            if k == len(own) or a < own[k][0] or own[k][1] < b:
                end = bisect_left(own, b, key=lambda span: span[0])
                own[k:end] = [(min(a, own[k][0]), max(b, own[end - 1][1]))] if k < end else [(a, b)]
                spans.append((kind, a, b))
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=order), sorted(spans, key=order)


def _digest(data: str | bytes) -> bytes:
    return hashlib.blake2b(data if isinstance(data, bytes) else data.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if out is None:
                out = Out(pa.schema([("doc_id", batch.schema.field("doc_id").type), *((n, pa.int64()) for n in ("n_assign", "n_access", "n_hex")), ("base_sha256", pa.string()), ("spans", pa.string())]))
            for k in range(batch.num_rows):
                base, spans = scan(batch.column("text")[k].as_py())
                counts = [sum(kind == k for kind, _, _ in base) for k in KINDS]
                out.add(batch.column("doc_id")[k].as_py(), *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans))
                if out.full():
                    yield out.take()
        if out is not None:
            yield out.take()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def masked(text: str, spans: list[Span], mark: str = "[{}]") -> str:
    """text with each span, overlapping ones together, replaced by the first one's kind in brackets."""
    parts, at, merged = [], 0, []
    for kind, start, end in spans:
        if merged and start < merged[-1][2]:
            merged[-1] = (*merged[-1][:2], max(end, merged[-1][2]))
        else:
            merged.append((kind, start, end))
    for kind, start, end in merged:
        parts += [text[at:start], mark.format(kind)]
        at = end
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns, with every finding in text masked; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            clean = [t if t is None else masked(t, s) if (s := scan(t)[1]) else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
