"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, case-folded.  Documents meet benchmark items through shared seeds, the Karp-Rabin
hashes of MATCH consecutive words, rolled from word to word.  For a document and an item that share seeds, the longest
common run of unmarked words is found by extending seeds, marked on both sides, and so on until no run of MATCH words is
left; the order of the tiles is free, so a reordered passage is covered as well.  The share of the item's words under tiles
is its coverage; a document is contaminated if some item's coverage reaches COVERED.

1. Executors read the benchmark; of equal items the one with the smallest item_id stands for all.  Its seeds are a table.
2. A bit filter of the seeds is broadcast.  Its size follows the number of seeds up to FILTER_BITS, so it is bounded
   whatever the benchmark's size; a benchmark far beyond that lets more seeds through and changes no result.
3. One pass over the documents keeps, of each text that the filter says shares a seed, the words under such seeds, with a
   gap between runs: no tile can lie elsewhere.  Texts are known by their SHA-256, so copies are judged once.
4. Texts and items meet in a join on seeds.  An item's commonest seeds, as many as a covered text can do without, take no
   part in it, so that phrases that many items share make no pairs.  Only pairs with enough seeds in common are tiled.

Nulls, ties, repeats: a null or empty text and a null item match nothing; items of fewer than MATCH words match as a
whole, and only if they have ``shortest`` words (SHORTEST; 1 judges all of them); of equally covered items the smallest
item_id is reported; repeated rows are judged each for itself; without items every document is clean; an empty table gives
an empty result; other columns, whatever their names, are ignored by judge() and kept by decontaminate().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, Out, cut, hashes, mix, rows_of, unused, word_hash

#: Words of the shortest tile.
MATCH = 5
#: Items of fewer words are too short to tell a leak from chance.
SHORTEST = 4
#: Share of an item's words that makes a document contaminated.
COVERED = 0.6
#: Bits of the broadcast filter, at most (32 MB), and bits a seed below that.
FILTER_BITS = 1 << 28
SEED_BITS = 16
#: Contaminated texts whose digests are broadcast; more are joined by a shuffle.
BROADCAST_TEXTS = 500_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+")


def tokens(text: bytes | None) -> list[bytes]:
    """Runs of letters and digits of the case-folded text; every character beyond ASCII counts as a letter."""
    if not text:
        return []
    return _TOKEN.findall(text.lower() if text.isascii() else text.decode().casefold().encode())


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """The Karp-Rabin hash of each width consecutive words: sum of h[i + k] * BASE**(width - 1 - k), mixed.

    A hash follows from the one before it by taking a word out and one in; here all at once, as differences of sums of
    words times powers of 1 / BASE, which are exact modulo 2**64.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    down = _powers(_INVERSE, len(h))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * down, dtype=np.uint64)])
    return mix((sums[width:] - sums[:-width]) * _powers(_BASE, n + width - 1)[width - 1 :])


_known_powers = {int(b): np.ones(1, np.uint64) for b in (_BASE, _INVERSE)}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 to base**(n - 1); kept, as far as a short text needs them."""
    known = _known_powers[int(base)]
    if n > len(known):
        known = np.full(max(n, 10_000), base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if n <= 1_000_000:
            _known_powers[int(base)] = known
    return known[:n]


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The tiles (start in doc, start in item, length) of two sequences, longest first; no run of least or more is left."""
    doc_free, item_free = np.ones(len(doc), bool), np.ones(len(item), bool)
    seeds: dict[int, list[int]] = {}
    grams = rolled(item, least).tolist()
    known = set(grams)
    doc_grams = rolled(doc, least)
    for p in np.flatnonzero(np.isin(doc_grams, np.fromiter(known, np.uint64, len(known)))).tolist():
        seeds.setdefault(int(doc_grams[p]), []).append(p)
    tiles = []
    while True:
        best: list[tuple[int, int, int]] = []
        longest = least
        for i, g in enumerate(grams):
            if not item_free[i : i + longest].all() or i + longest > len(item):
                continue
            for p in seeds.get(g, ()):
                if not doc_free[p] or p + longest > len(doc):
                    continue
                most = min(len(item) - i, len(doc) - p)
                same = (item[i : i + most] == doc[p : p + most]) & item_free[i : i + most] & doc_free[p : p + most]
                n = most if same.all() else int(same.argmin())
                if n > longest:
                    longest, best = n, [(p, i, n)]
                elif n == longest:
                    best.append((p, i, n))
        if not best:
            return tiles
        for p, i, n in best:
            if doc_free[p : p + n].all() and item_free[i : i + n].all():
                doc_free[p : p + n] = item_free[i : i + n] = False
                tiles.append((p, i, n))


_SEEDS = "seed bigint, item_id bigint, times int, n int"


def _items(benchmark: DataFrame, shortest: int) -> DataFrame:
    """(item_id, n, words): the distinct items as hashes of their words."""
    schema = pa.schema([("item_id", pa.int64()), ("n", pa.int32()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, out = Memo(word_hash), Out(schema)
        for item_id, text in rows_of(batches, "item_id", "text"):
            item = hashes(tokens(text), memo)
            if len(item) >= shortest:
                out.add(item_id, len(item), item.tobytes(), size=item.nbytes)
            if out.full():
                yield out.take()
        yield out.take()

    read = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id bigint, n int, words binary")
    return read.groupBy("words").agg(F.min("item_id").alias("item_id"), F.first("n").alias("n")).select("item_id", "n", "words")


def _seeds(items: DataFrame, least: int) -> DataFrame:
    """(seed, item_id, times, n): an item's seeds, how often it has each, and its words; a shorter item is one seed as a whole."""
    schema = pa.schema([("seed", pa.int64()), ("item_id", pa.int64()), ("times", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item_id, data in rows_of(batches, "item_id", "words"):
            item = np.frombuffer(data, np.uint64)
            seed, times = np.unique(_grams(item, min(least, len(item))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(np.full(len(seed), item_id, np.int64)), pa.array(times.astype(np.int32)), pa.array(np.full(len(seed), len(item), np.int32))], schema=schema)

    return items.select("item_id", "words").mapInArrow(run, _SEEDS)


def _grams(h: np.ndarray, width: int) -> np.ndarray:
    """rolled(), with the width in the hash, so that widths don't meet."""
    return mix(rolled(h, width) + np.uint64(width))


def _filter(seeds: DataFrame, most: int) -> np.ndarray:
    """Two bits a seed in words of 64 bits, gathered by their places; the number of all bits is a power of two up to most."""
    n = seeds.count()
    bits = min(most, max(1 << 10, 1 << (SEED_BITS * n - 1).bit_length()))
    place = lambda shift: F.shiftrightunsigned("seed", shift).bitwiseAND(F.lit(bits - 1))
    at = seeds.select(F.explode(F.array(place(0), place(32))).alias("at"))
    rows = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def _passes(table: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Which seeds may be among the filter's."""
    mask, yes = np.uint64(len(table) * 64 - 1), np.ones(len(seed), bool)
    for shift in (0, 32):
        at = (seed >> np.uint64(shift)) & mask
        yes &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
    return yes


def _key(text: Column) -> Column:
    """What a text is known by."""
    return F.unhex(F.sha2(text, 256))


def _read(docs: DataFrame, sent, widths: list[int], least: int) -> DataFrame:
    """(doc_id, key, n_words, seeds, words): the seeds that pass the filter and the words under them, null where none does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, table, out = Memo(word_hash), sent.value, None
        for batch in batches:
            if out is None:
                out = Out(pa.schema([("doc_id", batch.schema.field("doc_id").type), ("key", pa.binary()), ("n_words", pa.int64()), ("seeds", pa.binary()), ("words", pa.binary())]))
            for doc_id, text in rows_of([batch], "doc_id", "text"):
                doc = hashes(tokens(text), memo)
                seeds, words = _under(doc, table, widths, least)
                found = len(seeds) > 0
                out.add(doc_id, hashlib.sha256(text).digest() if found else None, len(doc), seeds.tobytes() if found else None, words.tobytes() if found else None, size=seeds.nbytes + words.nbytes)
                if out.full():
                    yield out.take()
        if out is not None:
            yield out.take()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, key binary, n_words bigint, seeds binary, words binary")


def _under(doc: np.ndarray, table: np.ndarray, widths: list[int], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct seeds that pass, and the words under those of least words, each run of them behind a 0."""
    found, words = [], np.empty(0, np.uint64)
    for width in widths:
        grams = _grams(doc, width)
        at = np.flatnonzero(_passes(table, grams)) if len(grams) else np.empty(0, np.int64)
        found.append(grams[at])
        if width == least and len(at):
            under = np.zeros(len(doc) + 1, np.int64)
            np.add.at(under, at, 1)
            np.add.at(under, at + width, -1)
            own = np.cumsum(under[:-1]) > 0
            first = own & ~np.concatenate([[False], own[:-1]])
            words = np.zeros(int(own.sum() + first.sum()), np.uint64)
            words[np.arange(int(own.sum())) + np.cumsum(first)[own]] = doc[own]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64), words


def _verdicts(read: DataFrame, items: DataFrame, seeds: DataFrame, least: int, covered: float) -> DataFrame:
    """(key, item_id, n_tiles, n_covered, item_words, coverage): the most covered item that reaches covered, of each text."""
    common = seeds.groupBy("seed").agg(F.count("*").alias("held"))
    # seeds that cover less than enough of an item even where all of them are in a text: a covered text has one of the others
    before = Window.partitionBy("item_id").orderBy(F.desc("held"), "seed").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rare = seeds.join(common, "seed").withColumn("reach", F.sum("times").over(before) * least).where(F.col("reach") >= F.col("n") * covered).select("item_id", "seed")
    texts = cut(read.where("key is not null").groupBy("key").agg(F.first("seeds").alias("seeds"), F.first("words").alias("words")), "texts")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, data in rows_of(batches, "key", "seeds"):
            seed = np.frombuffer(data, np.int64)
            yield pa.record_batch({"key": pa.array([key] * len(seed), pa.binary()), "seed": pa.array(seed)})

    met = cut(texts.select("key", "seeds").mapInArrow(spread, "key binary, seed bigint").join(cut(rare, "rare"), "seed").select("key", "item_id").distinct(), "met")

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(pa.schema([("key", pa.binary()), ("item_id", pa.int64()), ("n_tiles", pa.int64()), ("n_covered", pa.int64()), ("item_words", pa.int64())]))
        for key, data, own, item_id, held in rows_of(batches, "key", "seeds", "doc", "item_id", "item"):
            item, doc = np.frombuffer(held, np.uint64), np.frombuffer(own, np.uint64)
            n = len(item)
            if n < least:
                out.add(key, item_id, 1, n, n)
            else:
                at = np.flatnonzero(np.isin(_grams(item, least), np.frombuffer(data, np.uint64)))
                under = np.zeros(n + 1, np.int64)
                np.add.at(under, at, 1)
                np.add.at(under, at + least, -1)
                if (np.cumsum(under[:-1]) > 0).sum() >= covered * n:  # a bound from above
                    tiles = tile(doc, item, least)
                    total = sum(t[2] for t in tiles)
                    if total >= covered * n:
                        out.add(key, item_id, len(tiles), total, n)
            if out.full():
                yield out.take()
        yield out.take()

    pairs = met.join(texts.select("key", "seeds", F.col("words").alias("doc")), "key").join(items.select("item_id", F.col("words").alias("item")), "item_id")
    found = pairs.select("key", "seeds", "doc", "item_id", "item").mapInArrow(tiled, "key binary, item_id bigint, n_tiles bigint, n_covered bigint, item_words bigint")
    coverage = F.col("n_covered") / F.col("item_words")
    best = found.groupBy("key").agg(F.min(F.struct((-coverage).alias("less"), "item_id", "n_tiles", "n_covered", "item_words")).alias("b"))
    return best.select("key", "b.item_id", "b.n_tiles", "b.n_covered", "b.item_words", (-F.col("b.less")).alias("coverage"))


def _judged(docs: DataFrame, benchmark: DataFrame, least: int, covered: float, shortest: int, filter_bits: int) -> tuple[DataFrame, DataFrame]:
    """(_read() of all documents, _verdicts()), both as tables."""
    items = cut(_items(benchmark, shortest), "items")
    seeds = cut(_seeds(items, least), "seeds")
    widths = sorted(r["w"] for r in items.select(F.least("n", F.lit(least)).alias("w")).distinct().collect())  # at most ``least`` numbers
    read = cut(_read(docs, docs.sparkSession.sparkContext.broadcast(_filter(seeds, filter_bits)), widths, least), "read")
    return read, cut(_verdicts(read, items, seeds, least, covered), "verdicts")


def judge(docs: DataFrame, benchmark: DataFrame, *, least: int = MATCH, covered: float = COVERED, shortest: int = SHORTEST, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, item_id, n_tiles, n_covered, item_words, coverage and contaminated."""
    read, verdicts = _judged(docs, benchmark, least, covered, shortest, filter_bits)
    zero = lambda c, t: F.coalesce(c, F.lit(0).cast(t)).alias(c)
    met = read.where("key is not null").select("doc_id", "n_words", "key").join(verdicts, "key", "left").drop("key")
    joined = met.unionByName(read.where("key is null").select("doc_id", "n_words"), allowMissingColumns=True)  # a null key would be one hot key
    return joined.select("doc_id", "n_words", "item_id", zero("n_tiles", "bigint"), zero("n_covered", "bigint"), "item_words", zero("coverage", "double"), F.col("item_id").isNotNull().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, least: int = MATCH, covered: float = COVERED, shortest: int = SHORTEST, filter_bits: int = FILTER_BITS) -> DataFrame:
    """docs without the contaminated ones."""
    _, verdicts = _judged(docs, benchmark, least, covered, shortest, filter_bits)
    key, named = unused(docs, "key"), verdicts.select("key")
    named = named.withColumnRenamed("key", key)
    if verdicts.count() <= BROADCAST_TEXTS:
        named = F.broadcast(named)
    own = F.coalesce(_key(F.col("text")), F.monotonically_increasing_id().cast("string").cast("binary"))  # null texts are no hot key
    return docs.withColumn(key, own).join(named, key, "left_anti").select(*docs.columns)
