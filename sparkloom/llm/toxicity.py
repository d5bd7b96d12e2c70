"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(b + sum_i w_i + sum_{i<j} <v_i, v_j>) over a text's distinct terms.  The linear part weighs single terms;
the inner products weigh pairs, such as an insult together with the mention of a group, which no sum of single weights
can.  Terms are lower-cased runs of word characters, hashed to BUCKETS.  Those take part that a test relates to the label,
either alone (chi-square) or together with another term, whatever they are alone (``paired``, a score test of products
against what single terms leave unexplained); the rest would add noise that grows with the length of a text.

Training reads a bounded sample of labelled rows (``sample``, those with the smallest hash of doc_id), in which texts of
the same terms count once, and never a row whose crc32(doc_id as text) is a multiple of ``folds``.  RELATED, PAIRED, EPOCHS
and the decay were chosen on a part of the training rows (those with remainder 1), never on held-out ones.  Scoring reads
every text whole.

Nulls, ties, repeats: a null or empty text has no term and scores sigmoid(b); a row with a null doc_id is not held out
and not learnt from; a document with several labels is toxic if one of them says so, as are equal sets of terms; null
labels are left out; without labels of both kinds every score is 0; repeated rows are scored each for itself; an empty
table gives an empty result; other columns, whatever their names, are ignored by score() and kept by clean().
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, Out, rows_of

BUCKETS = 1 << 20
FACTORS = 8
#: A document whose score reaches this is toxic.
TOXIC = 0.5
#: Labelled rows learnt from, at most.
SAMPLE = 8000
FOLDS = 5
#: The chi-square statistic (one degree of freedom) from which a term takes part.
RELATED = 15.0
#: The same for a product of two terms, of which there are many more; the COMMON commonest terms and those related alone
#: are tested with every term of as many rows as the statistic could reach.
PAIRED = 35.0
COMMON = 256
EPOCHS = 50

_TERM = re.compile(rb"[a-z\x80-\xff]+")


def _bucket(term: bytes) -> int:
    return zlib.crc32(term) % BUCKETS


def terms(text: bytes | None, memo: Memo) -> np.ndarray:
    """The sorted distinct buckets of a text's terms."""
    if not text:
        return np.empty(0, np.int32)
    found = set(_TERM.findall(text.lower()))
    return np.unique(np.fromiter(map(memo.__getitem__, found), np.int32, len(found)))


@dataclass
class Machine:
    bias: float
    slot: np.ndarray  # bucket -> row of the weights; the last row is zero
    linear: np.ndarray
    factors: np.ndarray

    def score(self, buckets: np.ndarray) -> float:
        rows = self.slot[buckets]
        rows = rows[rows < len(self.linear) - 1]
        v = self.factors[rows]
        z = self.bias + self.linear[rows].sum() + 0.5 * float((v.sum(0) ** 2 - (v * v).sum(0)).sum())
        return float(1 / (1 + np.exp(-min(max(z, -60.0), 60.0))))


def related(rows: list[np.ndarray], labels: np.ndarray, least: float = RELATED) -> np.ndarray:
    """The buckets whose presence depends on the label, by a chi-square test with three rows of each kind at least."""
    n, pos = len(labels), int(labels.sum())
    each = np.bincount(np.concatenate(rows), minlength=BUCKETS).astype(float)
    hit = np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y]), minlength=BUCKETS).astype(float)
    expected = each * pos / n
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (hit - expected) ** 2 * n / (expected * (1 - each / n) * (n - pos))
    return np.flatnonzero((each >= 3) & (np.nan_to_num(chi, posinf=0) >= least))


def paired(rows: list[np.ndarray], labels: np.ndarray, p: np.ndarray, alone: np.ndarray, least: float = PAIRED, common: int = COMMON) -> np.ndarray:
    """The buckets of pairs whose joint presence goes with what p, a probability for each row, leaves of the label.

    The statistic of a pair is the square of the sum of label - p over the rows with both, divided by the variance that p
    implies or that is seen, whichever is larger; so it can't exceed the number of rows with both.
    """
    each = np.bincount(np.concatenate(rows), minlength=BUCKETS)
    often = np.flatnonzero(each >= least)
    top = often[np.argsort(-each[often], kind="stable")[:common]]
    probes = np.union1d(top, alone[each[alone] >= least])
    column = np.full(BUCKETS, -1)
    column[often] = np.arange(len(often))
    found, error, implied = [], labels - p, p * (1 - p)
    step = max(1, 4_000_000 // max(len(often), 1))  # so many cells at once
    for at in range(0, len(probes), step):
        some = probes[at : at + step]
        line = np.full(BUCKETS, -1)
        line[some] = np.arange(len(some))
        total, seen, model = (np.zeros((len(some), len(often))) for _ in range(3))
        for r, e, v in zip(rows, error.tolist(), implied.tolist(), strict=True):
            a, b = line[r], column[r]
            cells = np.ix_(a[a >= 0], b[b >= 0])
            total[cells] += e
            seen[cells] += e * e
            model[cells] += v
        total[np.arange(len(some)), column[some]] = 0
        i, j = np.nonzero(total**2 >= least * np.maximum(np.maximum(seen, model), 1e-12))
        found += [some[i], often[j]]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _batches(own: list[np.ndarray], rng: np.random.Generator, size: int = 64) -> list[tuple]:
    """(rows, their sizes, the terms in order of row, the row of each, the order by term, the distinct terms, where each begins)."""
    order, made = rng.permutation(len(own)), []
    for at in range(0, len(order), size):
        batch = order[at : at + size]
        sizes = np.array([len(own[k]) for k in batch])
        index = np.concatenate([own[k] for k in batch])
        by_term = np.argsort(index, kind="stable")
        terms_of, first = np.unique(index[by_term], return_index=True)
        made.append((batch, sizes, index, np.repeat(np.arange(len(batch)), sizes), by_term, terms_of, first))
    return made


def _gradients(batch: tuple, labels: np.ndarray, bias: float, linear: np.ndarray, vectors: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean logistic loss's derivatives by the bias, and by the weights and vectors of the batch's distinct terms."""
    rows, sizes, index, row, by_term, _, first = batch
    v, some = vectors[index], sizes > 0
    total = np.zeros((len(rows), vectors.shape[1]))
    if some.any():
        total[some] = np.add.reduceat(v, (np.cumsum(sizes) - sizes)[some])
    z = bias + np.bincount(row, linear[index], len(rows)) + 0.5 * ((total**2).sum(1) - np.bincount(row, (v * v).sum(1), len(rows)))
    error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels[rows]) / len(rows)
    own = error[row]
    if not len(first):
        return float(error.sum()), np.zeros(0), np.zeros((0, vectors.shape[1]))
    return float(error.sum()), np.add.reduceat(own[by_term], first), np.add.reduceat((own[:, None] * (total[row] - v))[by_term], first)


def _learn(rows: list[np.ndarray], labels: np.ndarray, kept: np.ndarray, factors: int, epochs: int, rate: float, decay: float, seed: int) -> Machine:
    """AdaGrad on the logistic loss, over batches of 64 rows in a seeded order; only kept terms take part."""
    m = len(kept)
    slot = np.full(BUCKETS, m, np.int32)
    slot[kept] = np.arange(m)
    rng = np.random.default_rng(seed)
    linear, vectors = np.zeros(m + 1), rng.normal(0, 0.02, (m + 1, factors))
    vectors[m] = 0
    share = labels.mean()
    bias = float(np.log(share / (1 - share)))
    batches = _batches([(s := slot[r])[s < m] for r in rows], rng)
    g_linear, g_vectors, g_bias = np.full(m + 1, 1e-6), np.full((m + 1, factors), 1e-6), 1e-6
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            own = batches[k][5]
            d_bias, d_linear, d_vectors = _gradients(batches[k], labels, bias, linear, vectors)
            d_linear += decay * linear[own]
            d_vectors += decay * vectors[own]
            g_linear[own] += d_linear**2
            g_vectors[own] += d_vectors**2
            g_bias += d_bias**2
            linear[own] -= rate * d_linear / np.sqrt(g_linear[own])
            vectors[own] -= rate * d_vectors / np.sqrt(g_vectors[own])
            bias -= rate * d_bias / np.sqrt(g_bias)
    return Machine(float(bias), slot, linear, vectors)


def fit(rows: list[np.ndarray], labels: np.ndarray, *, factors: int = FACTORS, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 0.0, seed: int = 7) -> Machine:
    """A linear machine of the terms related alone shows what they leave; then the terms of pairs related to that join in."""
    if not len(labels) or labels.all() or not labels.any():
        return Machine(-60.0, np.full(BUCKETS, 0, np.int32), np.zeros(1), np.zeros((1, factors)))
    alone = related(rows, labels)
    plain = _learn(rows, labels, alone, 0, 20, rate, decay, seed)
    more = paired(rows, labels, np.array([plain.score(r) for r in rows]), alone)
    return _learn(rows, labels, np.union1d(alone, more), factors, epochs, rate, decay, seed)


def held_out(folds: int = FOLDS):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, folds: int = FOLDS) -> Machine:
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(folds))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, out = Memo(_bucket), Out(pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("buckets", pa.binary())]))
        for doc_id, toxic, text in rows_of(batches, "doc_id", "toxic", "text"):
            found = terms(text, memo).tobytes()
            out.add(doc_id, toxic, found, size=len(found))
            if out.full():
                yield out.take()
        yield out.take()

    # the sample is bounded, so it may be sent to every executor
    picked = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select(F.col("doc_id").cast("long"), "toxic", "text")
    got = picked.mapInArrow(run, "doc_id bigint, toxic int, buckets binary").toArrow().to_pylist()
    toxic_of: dict[bytes, int] = {}
    for r in got:
        toxic_of[r["buckets"]] = max(r["toxic"], toxic_of.get(r["buckets"], 0))
    sets = sorted(toxic_of)
    return fit([np.frombuffer(x, np.int32) for x in sets], np.array([float(toxic_of[x] > 0) for x in sets]))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id with a score of 0 to 1."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(_bucket)
        for batch in batches:
            scores = [model.value.score(terms(text, memo)) for (text,) in rows_of([batch], "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def clean(docs: DataFrame, machine: Machine, least: float = TOXIC) -> DataFrame:
    """docs, all columns, without those whose score reaches least."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(_bucket)
        for batch in batches:
            yield batch.filter(pa.array([model.value.score(terms(text, memo)) < least for (text,) in rows_of([batch], "text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, folds: int = FOLDS) -> DataFrame:
    machine = train(docs, labels, sample=sample, folds=folds)
    return score(docs, machine).select("doc_id", held_out(folds).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
