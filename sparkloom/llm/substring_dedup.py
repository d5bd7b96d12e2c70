"""Removal of repeated passages, found by difference-cover anchors.

The contract: a window is WINDOW consecutive words of one document; every word is removed that lies in a window whose
words also start in a document with a smaller doc_id.

{1, 2, 4} is a difference cover modulo 7: whatever the two places of a match, some offset of 0 to 6 brings both to places
that are 1, 2 or 4 modulo 7.  So hashing only the 7-word anchors at those places (three of seven) is enough for any match
of 13 words to share one aligned anchor.  Anchors that two documents share are then extended: only the windows around
them are hashed in full and compared.

Documents travel in blocks of about BLOCK_BYTES of text.  A block sends each distinct hash once, whatever the number of
its copies there, so that a passage of a third of all documents is one entry per block; entries go to bins by their top
bits, so bins are even and bounded.  A bin answers with one bit per entry in the order sent: for anchors, whether another
document has it, for windows, whether a document below the block's smallest has it.  The block, which is joined with its
answers, repeats the computation and reads them off.  No text is grouped by its content and no pairs are formed.

Nobody sends more than FAN messages.  Where more bins than that are needed, entries take two steps: a block sends to wide
bins, each of them FAN relays; a relay merges what its blocks send, equal hashes into one, and sends on to FAN bins.  The
answers come back the same way.  So a message holds hundreds of entries with FAN times FAN bins as well, and a passage of
all documents is FAN entries in its bin instead of one per block.

Nulls, ties, repeats: a null or empty text has no words (kept_sha256 is that of the empty string); a document with a null
doc_id is not compared and keeps its words; rows with the same doc_id don't remove each other's words; an empty table
gives an empty result; other columns are ignored.  Windows are compared by hashes of 64 to 96 bits, as many as keep the
expected number of false matches among all windows below 1 in a million.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, cut, hashes, mix, rows_of, word_hash, words

WINDOW = 13
PERIOD = 7
COVER = (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
BLOCK_BYTES = 6_000_000
BLOCK_DOCS = 20_000
#: Entries of a bin, on average.
BIN_ENTRIES = 1_000_000
#: Messages of a block or relay, at most.
FAN = 4096

_BLOCK = "block bigint, ids binary, nulls binary, sizes binary, packed binary, n_words bigint"
_NONE = np.int64(2**63 - 1)


def blocks(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("block", pa.int64()), *((n, pa.binary()) for n in ("ids", "nulls", "sizes", "packed")), ("n_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        ids, texts, size, k = [], [], 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            plain = np.array([_NONE if i is None else i for i in ids], np.int64)
            row = [k, plain.tobytes(), np.array([i is None for i in ids], bool).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), squeeze.compress(b"".join(texts)), sum(len(words(t)) for t in texts)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for doc_id, text in rows_of(batches, "doc_id", "text"):
            ids.append(doc_id)
            texts.append(text or b"")
            size += len(texts[-1])
            if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                yield flush()
                ids, texts, size, k = [], [], 0, k + 1
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _BLOCK)


class Block:
    """A block's words with, for each, its document, its place there and the number of words from it to the end."""

    def __init__(self, row: dict, memo: Memo):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.nulls = np.frombuffer(row["nulls"], bool)
        text, at, self.words = zstandard.ZstdDecompressor().decompress(row["packed"]), 0, []
        for n in np.frombuffer(row["sizes"], np.int64).tolist():
            self.words.append(words(text[at : at + n]))
            at += n
        lengths = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.cumsum(lengths) - lengths
        self.h = np.concatenate([np.empty(0, np.uint64), *(hashes(w, memo) for w in self.words)])
        self.owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.place = np.arange(len(self.h)) - self.starts[self.owner]
        self.left = lengths[self.owner] - self.place
        self.left[self.nulls[self.owner]] = 0

    def hashed(self, at: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in range(width):
            out = out * np.uint64(base) + self.h[at + k]
        return mix(out)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places of anchors, their row among the distinct hashes, the distinct hashes, whether two documents here have each)."""
        at = np.flatnonzero((self.left >= ANCHOR) & _COVERED[self.place % PERIOD])
        found, row = np.unique(self.hashed(at, ANCHOR), return_inverse=True)
        ids = self.ids[self.owner[at]]
        low, high = np.full(len(found), _NONE), np.full(len(found), np.iinfo(np.int64).min)
        np.minimum.at(low, row, ids)
        np.maximum.at(high, row, ids)
        return at, row, found, low < high

    def windows(self, shared: np.ndarray, more: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts of windows around the shared anchors, their row among the distinct ones, the distinct ones' hashes, ``more`` bytes of a second hash, the smallest doc_id of each)."""
        near = np.zeros(len(self.h) + 1, np.int32)
        np.add.at(near, np.maximum(shared - (PERIOD - 1), self.starts[self.owner[shared]]), 1)
        np.add.at(near, shared + 1, -1)
        at = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (self.left >= WINDOW))
        key = self.hashed(at, WINDOW)
        check = self.hashed(at, WINDOW, 0xC2B2AE3D27D4EB4F) & np.uint64(2 ** (8 * more) - 1) if more else np.zeros(len(at), np.uint64)
        first, row = _distinct(key, check)
        low = np.full(len(first), _NONE)
        np.minimum.at(low, row, self.ids[self.owner[at]])
        return at, row, key[first], check[first], low


def _distinct(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each distinct pair, in order, is first; the row of each entry among them)."""
    order = np.lexsort((check, key))
    k, c = key[order], check[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    row = np.empty(len(k), np.int64)
    row[order] = np.cumsum(new) - 1
    return order[new], row


_COVERED = np.isin(np.arange(PERIOD), COVER)


def _bins(found: np.ndarray, n: int) -> np.ndarray:
    """The bin of each of the sorted hashes; bins follow the order."""
    return ((found >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _cut_bins(found: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    own, first = np.unique(_bins(found, n), return_index=True)
    ends = [*first[1:].tolist(), len(found)]
    for k, b in enumerate(own.tolist()):
        yield b, slice(int(first[k]), ends[k])


def _low_bytes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _from_bytes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


def _answers(answers: list[dict] | None, found: np.ndarray, n: int) -> np.ndarray:
    """The bits of the bins put back into the order of found."""
    bits = {a["bin"]: a["bits"] for a in answers or ()}
    out = np.zeros(len(found), bool)
    for b, part in _cut_bins(found, n):
        out[part] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=part.stop - part.start).astype(bool)
    return out


class Anchors:
    """Messages of anchors: low bytes of hashes and whether two documents have each."""

    fields = (("entries", "binary"), ("multi", "binary"))

    def __init__(self, width: int):
        self.width = width

    def pack(self, key: np.ndarray, multi: np.ndarray) -> dict:
        return {"entries": _low_bytes(key, self.width), "multi": np.packbits(multi).tobytes()}

    def unpack(self, row: dict) -> tuple[np.ndarray, ...]:
        key = _from_bytes(row["entries"], self.width)
        return key, np.unpackbits(np.frombuffer(row["multi"], np.uint8), count=len(key)).astype(bool)

    def merge(self, parts: list[tuple[np.ndarray, ...]]) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """(the distinct entries in order, the row of each entry among them)."""
        found, row, count = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True, return_counts=True)
        multi = count > 1
        multi[row[np.concatenate([p[1] for p in parts])]] = True
        return (found, multi), row

    def bits(self, merged: tuple[np.ndarray, ...], row: np.ndarray, parts: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        return merged[1][row]

    def bins(self, key: np.ndarray, wide: int, n: int, fan: int) -> np.ndarray:
        """The bin in a wide one of the sorted entries: by the top bits that they have."""
        return _bins(key << np.uint64(64 - 8 * self.width), fan)


class Windows:
    """Messages of windows: hashes, bytes of second hashes and the smallest doc_id of each, above a base."""

    fields = (("entries", "binary"), ("checks", "binary"), ("base", "bigint"), ("low", "binary"))

    def __init__(self, more: int):
        self.more = more

    def pack(self, key: np.ndarray, check: np.ndarray, low: np.ndarray) -> dict:
        base = int(low.min()) if len(low) else 0
        wide = "<u8" if len(low) and int(low.max()) - base >= 2**32 else "<u4"
        return {"entries": key.astype("<u8").tobytes(), "checks": _low_bytes(check, self.more) if self.more else b"", "base": base, "low": (low - base).astype(wide).tobytes()}

    def unpack(self, row: dict) -> tuple[np.ndarray, ...]:
        key = np.frombuffer(row["entries"], "<u8").astype(np.uint64)
        check = _from_bytes(row["checks"], self.more) if self.more else np.zeros(len(key), np.uint64)
        return key, check, np.frombuffer(row["low"], f"<u{len(row['low']) // len(key)}").astype(np.int64) + row["base"]

    def merge(self, parts: list[tuple[np.ndarray, ...]]) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        key, check, low = (np.concatenate([p[k] for p in parts]) for k in range(3))
        first, row = _distinct(key, check)
        least = np.full(len(first), _NONE)
        np.minimum.at(least, row, low)
        return (key[first], check[first], least), row

    def bits(self, merged: tuple[np.ndarray, ...], row: np.ndarray, parts: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        return merged[2][row] < np.concatenate([p[2] for p in parts])

    def bins(self, key: np.ndarray, wide: int, n: int, fan: int) -> np.ndarray:
        return _bins(key, n * fan) - wide * fan


def _sent(kind: Anchors | Windows, block: int, own: list[tuple[int, tuple[np.ndarray, ...]]]) -> pa.RecordBatch:
    """A sender's messages (bin, block, the kind's fields)."""
    rows = [kind.pack(*arrays) for _, arrays in own]
    columns = {"bin": pa.array([b for b, _ in own], pa.int64()), "block": pa.array([block] * len(own), pa.int64())}
    return pa.record_batch(columns | {n: pa.array([r[n] for r in rows], pa.int64() if t == "bigint" else pa.binary()) for n, t in kind.fields})


def _asked(messages: DataFrame, kind: Anchors | Windows, n: int, fan: int, two: bool) -> DataFrame:
    """(bin, block, bits): the answers to messages to n bins, or to n wide ones if they take two steps."""
    schema = "bin bigint, block bigint, " + ", ".join(f"{f} {t}" for f, t in kind.fields)

    def decide(group: pa.Table) -> pa.Table:
        parts = [kind.unpack(r) for r in group.to_pylist()]
        return _reply(group, kind.bits(*kind.merge(parts), parts), [len(p[0]) for p in parts])

    if not two:
        return messages.groupBy("bin").applyInArrow(decide, "bin bigint, block bigint, bits binary")
    held = cut(messages.withColumn("relay", F.col("bin") * fan + F.pmod(F.xxhash64("block"), F.lit(fan))), "messages")

    def parted(merged: tuple[np.ndarray, ...], wide: int) -> list[tuple[int, slice]]:
        own, first = np.unique(kind.bins(merged[0], wide, n, fan), return_index=True)
        ends = [*first[1:].tolist(), len(merged[0])]
        return [(wide * fan + b, slice(a, z)) for b, a, z in zip(own.tolist(), first.tolist(), ends, strict=True)]

    def send_on(group: pa.Table) -> pa.Table:
        merged, _ = kind.merge([kind.unpack(r) for r in group.to_pylist()])
        wide, relay = group.column("bin")[0].as_py(), group.column("relay")[0].as_py()
        return pa.Table.from_batches([_sent(kind, relay, [(b, tuple(x[part] for x in merged)) for b, part in parted(merged, wide)])])

    def send_back(group: pa.Table, answers: pa.Table) -> pa.Table:
        parts = [kind.unpack(r) for r in group.to_pylist()]
        merged, row = kind.merge(parts)
        bits = {a["bin"]: a["bits"] for a in answers.to_pylist()}
        yes = np.zeros(len(merged[0]), bool)
        for b, part in parted(merged, group.column("bin")[0].as_py()):
            yes[part] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=part.stop - part.start).astype(bool)
        return _reply(group, yes[row] | kind.bits(merged, row, parts), [len(p[0]) for p in parts])

    answered = held.groupBy("relay").applyInArrow(send_on, schema).groupBy("bin").applyInArrow(decide, "bin bigint, block bigint, bits binary")
    back = held.groupBy("relay").cogroup(answered.withColumnRenamed("block", "relay").groupBy("relay"))
    return back.applyInArrow(send_back, "bin bigint, block bigint, bits binary")


def repeated(docs: DataFrame, *, bin_entries: int = BIN_ENTRIES, fan: int = FAN) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, kept_text."""
    return _removed(docs, bin_entries, fan, True)


def digests(docs: DataFrame, *, bin_entries: int = BIN_ENTRIES, fan: int = FAN) -> DataFrame:
    """repeated() without the text."""
    return _removed(docs, bin_entries, fan, False)


def _removed(docs: DataFrame, bin_entries: int, fan: int, with_text: bool) -> DataFrame:
    spark = docs.sparkSession
    held = cut(blocks(docs), "blocks")
    total = held.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).collect()[0]["n"]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bins = max(2 * partitions, total // bin_entries, 1)
    two = bins > fan
    n = min(-(-bins // fan), fan) if two else bins
    of_anchor = Anchors(next(w for w in range(5, 9) if w == 8 or 2 ** (8 * w) * n >= 2**17 * max(total, 1)))  # a chance of 1 in 2**17 that an anchor meets another's bytes
    of_window = Windows(next(w for w in range(5) if w == 4 or 2 ** (64 + 8 * w) >= 2**19 * total**2))  # total**2 / 2 pairs

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block]]:
        memo = Memo(word_hash)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                yield row, Block(row, memo)

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in each(batches):
            _, _, found, multi = block.anchors()
            yield _sent(of_anchor, row["block"], [(b, (found[part], multi[part])) for b, part in _cut_bins(found, n)])

    fields = lambda kind: "bin bigint, block bigint, " + ", ".join(f"{f} {t}" for f, t in kind.fields)
    first = _asked(held.mapInArrow(send_anchors, fields(of_anchor)), of_anchor, n, fan, two)
    first = cut(first.groupBy("block").agg(F.collect_list(F.struct("bin", "bits")).alias("anchors")), "anchors")

    def shared_places(block: Block, row: dict) -> np.ndarray:
        at, own, found, _ = block.anchors()
        return at[_answers(row["anchors"], found, n)[own]]

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in each(batches):
            _, _, found, check, low = block.windows(shared_places(block, row), of_window.more)
            yield _sent(of_window, row["block"], [(b, (found[part], check[part], low[part])) for b, part in _cut_bins(found, n)])

    second = _asked(held.join(first, "block").mapInArrow(send_windows, fields(of_window)), of_window, n, fan, two)
    second = second.groupBy("block").agg(F.collect_list(F.struct("bin", "bits")).alias("windows"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in each(batches):
            at, own, found, _, low = block.windows(shared_places(block, row), of_window.more)
            hit = at[_answers(row["windows"], found, n)[own] | (block.ids[block.owner[at]] > low[own])]
            under = np.zeros(len(block.h) + 1, np.int32)
            np.add.at(under, hit, 1)
            np.add.at(under, hit + WINDOW, -1)
            gone = np.cumsum(under[:-1]) > 0
            removed, kept = [], []
            for own_words, start in zip(block.words, block.starts.tolist(), strict=True):
                mask = gone[start : start + len(own_words)]
                removed.append(int(mask.sum()))
                kept.append(b" ".join(own_words if not removed[-1] else [w for w, g in zip(own_words, mask.tolist(), strict=True) if not g]))
            out = {"doc_id": pa.array(block.ids, pa.int64(), mask=block.nulls), "n_words": pa.array([len(w) for w in block.words], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())}
            yield pa.record_batch(out | ({"kept_text": pa.array([t.decode() for t in kept], pa.string())} if with_text else {}))

    return held.join(first, "block", "left").join(second, "block", "left").mapInArrow(remove, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text)


def _reply(group: pa.Table, bits: np.ndarray, sizes: list[int]) -> pa.Table:
    """The bits as one row per row of group."""
    ends = np.cumsum(sizes)
    packed = [np.packbits(bits[z - s : z]).tobytes() for z, s in zip(ends.tolist(), sizes, strict=True)]
    return pa.table({"bin": group.column("bin"), "block": group.column("block"), "bits": pa.array(packed, pa.binary())})
