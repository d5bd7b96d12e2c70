"""Near-duplicates by SuperMinHash, banding, verification on full sets and union-find.

SuperMinHash: every shingle of a set walks the same pseudo-random permutation of the slots; its j-th step offers the
value j + r to one slot.  A slot keeps its least value, and a set is done as soon as every slot holds less than the next
step could offer.  Values within a set are spread over the slots without repetition, which is what lowers the variance.

1. One representative (the smallest doc_id) stands for all documents with the same set, however many.
2. Signatures are cut into bands; documents that agree on a band meet in a bucket.
3. In each bucket every member meets the smallest one, and each document is compared, on full sets, with the one that
   it meets so most often; pairs grow with members, not with their squares.  Confirmed links are grouped.
4. Members of a bucket that are still in different components may be linked past the smallest one.  Only such buckets are
   looked at again, in pairs of bounded blocks: a block holds its members' full sets, counts their intersections at once
   and gives back the links that join components, at most one fewer than it has members.  Blocks of the smallest member's
   own component meet blocks of the others only, so a large group with a few strays costs no more than its size.  So no
   link is lost to step 3.

Hot buckets and hot partners are only ever sides of joins, which Spark splits, or keys of aggregates that combine before
the shuffle.  Links and components stay in tables; no document's set, link or component reaches the driver.

Nulls, ties, repeats: a null or empty text has the empty set and is linked with nothing; a row with a null doc_id is
linked with nothing, has a null component_id and is kept; rows repeated with their doc_id get equal results each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, Out, cut, hashes, lower_words, mix, rows_of, windows, word_hash
from .graph import components

WORDS = 5
PERCENT = 85
#: Bands of ROWS values: a pair of similarity 0.85 shares no band with a probability of 8e-7.
BANDS = 24
ROWS = 5
#: A bucket that needs it is compared in pairs of blocks of so many sets or shingles, on average.
BLOCK_SETS = 1200
BLOCK_SHINGLES = 300_000

_TOP = np.uint64(48)


def shingles(tokens: list[bytes], memo: Memo, width: int = WORDS) -> np.ndarray:
    """The set as sorted distinct hashes."""
    if not tokens:
        return np.empty(0, np.uint64)
    return np.unique(windows(hashes(tokens, memo), min(width, len(tokens))))


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """One row of m values (step in the top bits, r below) per non-empty set."""
    sizes = np.array([len(s) for s in sets])
    x, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    full = np.full((len(sets), m), np.uint64(m) << _TOP, np.uint64)
    ids, sig, order = np.arange(len(sets)), full, None
    for j in range(m):
        z = mix(x + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        to = j + ((z & np.uint64(0xFFFF)) * np.uint64(m - j) >> np.uint64(16)).astype(np.int64)
        if j == 0:
            slot, first = to, to
        else:
            if order is None:  # few elements get past the first step, so that the permutations are made only now
                order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(x), 1))
                order[np.arange(len(x)), first] = 0
                order[:, 0] = first
            row = np.arange(len(x))
            slot = order[row, to].astype(np.int64)
            order[row, to] = order[:, j]
            order[:, j] = slot
        np.minimum.at(sig.reshape(-1), owner * m + slot, (z >> np.uint64(16)) | (np.uint64(j) << _TOP))
        done = sig.max(1) < np.uint64(j + 1) << _TOP
        if done.any() or j == m - 1:
            full[ids] = sig
            if done.all():
                break
            stay = ~done
            keep = stay[owner]
            x, owner = x[keep], (np.cumsum(stay) - 1)[owner[keep]]
            first = first[keep]
            order = None if order is None else order[keep]
            ids, sig = ids[stay], sig[stay]
    return full


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per band; the band's number is part of it."""
    s = signatures.reshape(len(signatures), bands, rows)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), 1))
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
    return key.view(np.int64)


def signed(docs: DataFrame, *, width: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_hash (null for the empty set) and the band keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(word_hash)
        held, size, empty = [], 0, []

        def flush() -> pa.RecordBatch:
            out = Out(schema)
            if held:
                keys = band_keys(superminhash([s for _, s in held], bands * rows), bands, rows)
                for (doc_id, s), own in zip(held, keys, strict=True):
                    out.add(doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()), own)
            for doc_id in empty:
                out.add(doc_id, 0, None, None)
            return out.take()

        for doc_id, text in rows_of(batches, "doc_id", "text"):
            s = shingles(lower_words(text), memo, width)
            if len(s):
                held.append((doc_id, s))
            else:
                empty.append(doc_id)
            size += len(s)
            if size >= 60_000 or len(held) + len(empty) >= 1000:
                yield flush()
                held, size, empty = [], 0, []
        yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, set_hash binary, bands array<bigint>")


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and its text, compressed: what is shuffled to confirm pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        out = Out(pa.schema([("doc_id", pa.int64()), ("packed", pa.binary())]))
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            data = squeeze.compress(text or b"")
            out.add(doc_id, data, size=len(data))
            if out.full():
                yield out.take()
        yield out.take()

    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(run, "doc_id bigint, packed binary")


def _confirmed(pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b, packed_a, packed_b) whose full sets reach the similarity, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, widen = Memo(word_hash), zstandard.ZstdDecompressor()
        last, last_set = None, None
        for batch in batches:
            out = Out(pa.schema([("a", pa.int64()), ("b", pa.int64())]))
            for a, b, pa_, pb in rows_of([batch], "a", "b", "packed_a", "packed_b"):
                if b != last:  # rows come sorted by b more often than not
                    last, last_set = b, shingles(lower_words(widen.decompress(pb)), memo, width)
                own = shingles(lower_words(widen.decompress(pa_)), memo, width)
                both = _common(own, last_set)
                if 100 * both >= percent * (len(own) + len(last_set) - both):
                    out.add(a, b)
            yield out.take()

    return pairs.select("a", "b", "packed_a", "packed_b").mapInArrow(run, "a bigint, b bigint")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _links_of_block(sets: list[np.ndarray], ids: list[int], labels: list[int], sides: list[int], percent: int) -> list[tuple[int, int]]:
    """Links between the sides of a block (all of it if there is one) that join different labels: a spanning forest of them."""
    n = np.array([len(s) for s in sets], np.int64)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, common = np.repeat(np.arange(len(sets)), n), np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[common] = np.arange(len(common))
    column = place[code]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(common), 4096):  # the intersections' sizes, from the shingles that two sets share
        low, high = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((len(sets), min(4096, len(common) - at)), np.float32)
        part[row[low:high], column[low:high] - at] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    label, side = np.array(labels), np.array(sides)
    linked = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (label[:, None] < label[None, :])
    if len(set(sides)) > 1:
        linked &= side[:, None] != side[None, :]
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    found = []
    for a, b in np.argwhere(linked).tolist():
        ra, rb = find(labels[a]), find(labels[b])
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            found.append((ids[a], ids[b]))
    return found


def _across(dealt: DataFrame, width: int, percent: int) -> DataFrame:
    """The links between components among dealt (key, i, j, own, rep, c, packed), block by block; a block is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, widen = Memo(word_hash), zstandard.ZstdDecompressor()
        out, now, held = Out(pa.schema([("a", pa.int64()), ("b", pa.int64())])), None, []

        def judged() -> None:
            if len({h[2] for h in held}) > 1:
                sets = [shingles(lower_words(widen.decompress(h[3])), memo, width) for h in held]
                for a, b in _links_of_block(sets, [h[1] for h in held], [h[2] for h in held], [h[0] for h in held], percent):
                    out.add(max(a, b), min(a, b))

        for key, i, j, own, rep, c, packed in rows_of(batches, "key", "i", "j", "own", "rep", "c", "packed"):
            if (key, i, j) != now:
                judged()
                now, held = (key, i, j), []
                if out.full():
                    yield out.take()
            held.append((own, rep, c, packed))
        judged()
        yield out.take()

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep").mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, *, width: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = lambda a, b: (F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b))  # noqa: E731  else the sets can't be that similar
    signed_docs = cut(signed(docs, width=width, bands=bands, rows=rows), "signed")
    sets = signed_docs.where("doc_id is not null and set_hash is not null")
    reps = cut(sets.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "reps")

    keyed = reps.select("rep", "n", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.min_by("n", "rep").alias("hub_n"), F.count("*").alias("size")).where("size > 1").drop("size")
    met = cut(keyed.join(cut(buckets, "buckets"), "key"), "met")  # of two stored sides Spark can split a hot key

    pairs = met.where(F.col("rep") != F.col("hub")).where(sizes(F.col("n"), F.col("hub_n"))).groupBy("rep", "hub").agg(F.count("*").alias("shared"))
    pairs = cut(pairs, "pairs")
    best = pairs.groupBy("rep").agg(F.max_by("hub", F.struct("shared", -F.col("hub"))).alias("hub"))
    members = met.groupBy("rep").agg(F.lit(True).alias("met")).join(best, "rep", "left").join(pairs.select(F.col("hub").alias("rep"), F.lit(True).alias("is_hub")).distinct(), "rep", "left")
    texts = cut(_packed(docs).join(members.hint("merge"), F.col("doc_id") == F.col("rep")).select("doc_id", "packed", "hub", F.coalesce("is_hub", F.lit(False)).alias("is_hub")), "texts")

    hubs = texts.where("is_hub").select(F.col("doc_id").alias("b"), F.col("packed").alias("packed_b"))
    first = texts.where("hub is not null").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"), F.col("packed").alias("packed_a")).join(hubs, "b")
    links = cut(_confirmed(first, width, percent), "confirmed")
    grouped = components(links)

    labelled = met.join(grouped.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("c"))
    mixed = labelled.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min_by("c", "rep").alias("hub_c")).where("low <> high").select("key", "hub_c")
    sided = cut(labelled.join(cut(mixed, "mixed"), "key").withColumn("late", F.col("c") != F.col("hub_c")).drop("hub_c"), "sided")
    blocks = lambda own: F.ceil(F.greatest(F.count_if(own) / BLOCK_SETS, F.sum(F.when(own, F.col("n")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    sizes_of = cut(sided.groupBy("key").agg(blocks(~F.col("late")).alias("g"), blocks(F.col("late")).alias("h")), "sizes")
    place = F.xxhash64("rep")
    dealt = sided.join(sizes_of, "key").withColumn("own", F.when(F.col("late"), F.col("g") + F.pmod(place, F.col("h"))).otherwise(F.pmod(place, F.col("g"))).cast("int"))
    partners = F.sequence(F.when(F.col("late"), 0).otherwise(F.col("g")), F.col("g") + F.col("h") - 1)
    dealt = dealt.join(texts.select(F.col("doc_id").alias("rep"), "packed").hint("merge"), "rep").withColumn("other", F.explode(partners))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "c", "packed")
    across = cut(_across(dealt, width, percent), "across")
    if not across.isEmpty():
        grouped = components(links.union(across))

    named = reps.select("set_hash", "rep").join(grouped.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("component"))
    done = signed_docs.select("doc_id", "n_shingles", "set_hash").join(named, "set_hash", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return done.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group, the one with the smallest doc_id; rows with a null doc_id stay."""
    kept = near_duplicates(docs, **options).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))
