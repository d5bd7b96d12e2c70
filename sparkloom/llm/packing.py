"""Best-fit packing by minimum bin slack.

The lengths' histogram has at most ``capacity`` rows however many documents there are, so the choice of bins is made on
the driver from it alone.  Per bin, a bitset subset-sum finds the fullest combination that the lengths left allow; the
combination is taken as often as the histogram allows and removed.  The documents then look up their place by their rank
among the pieces of their length, which windows over (length, bucket) count, so no task holds all pieces of a length.

Nulls, ties, repeats: a null text is an empty one (the end id alone); rows with the same doc_id are packed each for
itself; equal lengths are ranked by doc_id, piece and then at will; an empty table gives an empty result; columns other
than the named ones are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, Out, cut, rows_of

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Pieces in a bucket of one length, on average; buckets spread a common length over tasks.
BUCKET_ROWS = 200_000

_PLAIN = re.compile(r"[!-~À-įı-ɏ]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ɏ]+|[0-9]|[^a-z0-9À-ÖØ-öø-ɏ]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable letter of each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return dict(zip(shown, map(chr, shown), strict=True)) | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}


#: How the default tokenizer normalizes and splits: fixed values, which _word() follows.
_NORMALIZED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def _set_up(tokenizer) -> bool:
    """Whether a tokenizer normalizes and splits as _word() does; its vocabulary doesn't matter."""
    own = json.loads(tokenizer.to_str())
    normalized, split = own["normalizer"] or {}, own["pre_tokenizer"] or {}
    added = all("<|" in t["content"] for t in own["added_tokens"])
    return added and own["model"]["type"] == "BPE" and normalized.get("normalizers") == _NORMALIZED and split.get("pretokenizers") == _SPLIT


class Encoder:
    """encode(text): the ids that the tokenizer gives without special tokens, as little-endian unsigned 32-bit numbers.

    A tokenizer set up like the default one drops white space and lets no token cross it, so a text's ids are its words'
    ids in a row and each distinct word is encoded once; words of ASCII and Latin letters go to the BPE model directly.
    Any other tokenizer is given whole texts.
    """

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_words = _set_up(self.tokenizer)
        letters = _byte_letters()
        self.letters = [letters[b] for b in range(256)]
        self.packed = [np.uint32(i).astype("<u4").tobytes() for i in range(self.tokenizer.get_vocab_size() + 1)]
        self.part_ids = Memo(self._part, 300_000)
        self.word_ids = Memo(self._word, 500_000)

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = "".join(map(self.letters.__getitem__, part.encode()))
        return b"".join([self.packed[t.id] for t in self.model.tokenize(part)])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.part_ids.__getitem__, _PARTS.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())))
        return self.whole(text)

    def encode(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.word_ids.__getitem__, text.split())) if self.by_words else self.whole(text.decode())


def tokenize_pieces(docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32 and, if wanted, ids."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        end = np.uint32(end_id).astype("<u4").tobytes()
        out = None
        for batch in batches:
            if out is None:
                out = Out(pa.schema([("doc_id", batch.schema.field("doc_id").type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids))
            for doc_id, text in rows_of([batch], "doc_id", "text"):
                ids = encoder.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    out.add(doc_id, k, at // 4, len(own) // 4, zlib.crc32(own), *[np.frombuffer(own, "<i4").tolist()] * with_ids, size=len(own) * with_ids)
                if out.full():
                    yield out.take()
        if out is not None:
            yield out.take()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def slack_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: number in the bin}), covering counts exactly.

    Each bin starts with the longest piece left.  Bit s of a bitset says whether the other lengths can fill s; longer
    lengths enter first and enter in halves of powers of two, and the search ends once the bin can be full.
    """
    left = {n: k for n, k in counts.items() if k > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    patterns = []
    while left:
        order = sorted(left, reverse=True)
        room = capacity - order[0]
        mask, bits, steps = (1 << (room + 1)) - 1, 1, []
        for n in order:
            most = min(left[n] - (n == order[0]), room // n)
            k = 1
            while most > 0 and not bits >> room:
                k = min(k, most)
                if (after := (bits | bits << k * n) & mask) != bits:
                    steps.append((n, k, bits))
                    bits = after
                most -= k
                k *= 2
            if bits >> room:
                break
        used, fill = {order[0]: 1}, bits.bit_length() - 1
        for n, k, before in reversed(steps):
            if not before >> fill & 1:
                fill -= k * n
                used[n] = used.get(n, 0) + k
        times = min(left[n] // k for n, k in used.items())
        patterns.append((times, used))
        for n, k in used.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return patterns


class Places:
    """Where the rank-th piece of a length goes: at most a few numbers per pattern and length, whatever the input."""

    def __init__(self, patterns: list[tuple[int, dict[int, int]]]):
        rows, sequence, seen = [], 0, {}
        for times, used in patterns:
            at = 0
            for n in sorted(used, reverse=True):
                rows.append((n, seen.get(n, 0), sequence, used[n], at))
                seen[n] = seen.get(n, 0) + times * used[n]
                at += n * used[n]
            sequence += times
        self.length, self.first, self.sequence, self.each, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
        self.key = (self.length << 48) + self.first

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.key, (length << 48) + rank, side="right") - 1
        rank = rank - self.first[row]
        return self.sequence[row] + rank // self.each[row], self.offset[row] + rank % self.each[row] * length


def pack(pieces: DataFrame, order: list[str], *, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces, which must be stored (it is read three times); order breaks ties of a length."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    places = spark.sparkContext.broadcast(Places(slack_patterns(histogram, capacity)))
    buckets = max(64, sum(histogram.values()) // BUCKET_ROWS)
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n")).select("length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)).cast("long") - 1).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_bucket", "_before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
            at = batch.schema.get_field_index("_rank")
            batch = pa.RecordBatch.from_arrays([c for k, c in enumerate(batch.columns) if k != at], names=[n for k, n in enumerate(batch.schema.names) if k != at])
            yield batch.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    plain = ranked.drop("_rank")
    return ranked.mapInArrow(place, plain.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema)


def pack_documents(docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    pieces = cut(tokenize_pieces(docs, path=path, capacity=capacity, end_id=end_id, with_ids=with_ids), "pieces")
    return pack(pieces, ["doc_id", "piece"], capacity=capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pack_documents(with_ids=True): sequence_id, ids, doc_ids; a sequence has at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"))
