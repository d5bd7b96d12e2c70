"""Quality rules with line labels: a linear-chain conditional random field marks each line as content or boilerplate.

A text's lines (split at LF, those without a word left out) are a chain; each has features of its own letters, symbols,
repetitions and words.  Viterbi decoding gives the likeliest labels of the whole chain, and the share of words in content
lines decides: a document with a share below CONTENT goes, as does one that fails the base rules.

The field is fitted by gradient ascent on its exact log-likelihood (forward-backward) from a bounded sample of labelled
documents (``sample``, those with the smallest hash of doc_id): the lines of documents of quality 1 are content, those of
quality 0 boilerplate.  Every line of a sampled text is learnt from, in chains of LINES neighbouring lines, and documents
of few lines count as much as long ones.

Nulls, ties, repeats: a null text has no words and fails the base rules; labels with nulls are left out, of several
labels of a document the smallest counts; ties in decoding go to content; without labels of both kinds every line is
content; repeated rows are judged each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, Out, hashes, rows_of, windows, word_hash

#: Labelled documents learnt from, at most.
SAMPLE = 3000
#: Lines of a chain in training; what follows goes on in the next.
LINES = 64
#: Share of words in content lines that a kept document has at least.
CONTENT = 0.5
SYMBOLS = b"#*$%&|<>"
WIDTH = 5

_NOTICE = re.compile(rb"(?i)copyright|licen[sc]e|all rights|cookie|https?:|www\.|\(c\)|@")
_END = (b".", b"!", b"?", b":", b";")


def base_counts(text: bytes | None, memo: Memo) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    tokens = text.split()
    joined = b"".join(tokens)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    lines = [x for x in text.split(b"\n") if x.split()]
    repeats = 0
    if len(tokens) > WIDTH:
        _, row, count = np.unique(windows(hashes(tokens, memo), WIDTH), return_inverse=True, return_counts=True)
        under = np.zeros(len(tokens) + 1, np.int64)
        at = np.flatnonzero(count[row] > 1)
        np.add.at(under, at, 1)
        np.add.at(under, at + WIDTH, -1)
        repeats = int((np.cumsum(under[:-1]) > 0).sum())
    return len(tokens), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


FEATURES = 24


def line_features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(one row of features per line with a word, the words of each)."""
    rows, sizes, seen = [], [], set()
    for line in (text or b"").split(b"\n"):
        tokens = line.split()
        if not tokens:
            continue
        n, size = len(tokens), len(line)
        symbols = size - len(line.translate(None, SYMBOLS))
        upper = sum(map(line.count, _UPPER))
        distinct = len(set(tokens)) / n
        wide = sum(map(len, tokens)) / n
        ended = sum(map(_is_end, tokens)) / n
        bang = line.count(b"!!")
        row = [0.0] * FEATURES
        row[0] = 1.0
        row[1 + (0 if n < 2 else 1 if n < 5 else 2 if n < 10 else 3 if n < 30 else 4)] = 1.0
        share = symbols / size
        row[6 + (0 if not symbols else 1 if share < 0.02 else 2 if share < 0.06 else 3)] = 1.0
        share = upper / size
        row[10 + (0 if share < 0.1 else 1 if share < 0.4 else 2)] = 1.0
        row[13 + (0 if distinct > 0.7 else 1 if distinct > 0.4 else 2)] = 1.0
        row[16] = min(bang / n, 1.0)
        row[17] = float(line in seen)
        row[18] = min(ended, 1.0)
        row[19] = float(wide > 9)
        row[20] = float(wide < 3)
        row[21] = float(_NOTICE.search(line) is not None)
        row[22] = min(sum(map(line.count, _DIGITS)) / size * 4, 1.0)
        row[23] = float(line.rstrip()[-1:] in _END)
        seen.add(line)
        rows.append(row)
        sizes.append(n)
    return np.array(rows).reshape(-1, FEATURES), np.array(sizes, np.int64)


_UPPER = [bytes([c]) for c in range(65, 91)]
_DIGITS = [bytes([c]) for c in range(48, 58)]


def _is_end(token: bytes) -> bool:
    return token[-1:] in _END


@dataclass
class Field:
    """Scores of label 1 (content) against 0 by feature, of label pairs, and of the first label."""

    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi: the likeliest labels."""
        n = len(x)
        if not n:
            return np.empty(0, np.int8)
        own = (x @ self.weights).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = float(self.first[0]), float(self.first[1]) + own[0]
        back = []
        for k in range(1, n):
            from_a, from_b = b + m10 < a + m00, b + m11 < a + m01  # the better label before 0 and before 1 is 0
            back.append((from_a, from_b))
            a, b = (a + m00 if from_a else b + m10), (a + m01 if from_b else b + m11) + own[k]
        label = int(b >= a)
        labels = [label]
        for from_a, from_b in reversed(back):
            label = int(not (from_b if label else from_a))
            labels.append(label)
        return np.array(labels[::-1], np.int8)

    def content_share(self, text: bytes | None) -> float:
        x, sizes = line_features(text)
        return float(sizes[self.decode(x) == 1].sum() / sizes.sum()) if len(sizes) else 0.0


def fit(chains: list[np.ndarray], labels: list[int], *, begins: list[bool] | None = None, of: list[int] | None = None, steps: int = 150, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Full-batch AdaGrad; chains of like length are run through forward-backward together.

    A chain may be a part of a longer one: ``begins`` says which are the first part, ``of`` how many lines the whole has.
    """
    begins = np.ones(len(chains), bool) if begins is None else np.array(begins, bool)
    of = np.array([len(x) for x in chains] if of is None else of)
    if len(set(labels)) < 2:
        return Field(np.zeros(FEATURES), np.zeros((2, 2)), np.array([-1.0, 1.0]))
    order = sorted((k for k in range(len(chains)) if len(chains[k])), key=lambda k: len(chains[k]))
    batches = []
    for at in range(0, len(order), 256):
        own = order[at : at + 256]
        longest = len(chains[own[-1]])
        x, mask = np.zeros((len(own), longest, FEATURES)), np.zeros((len(own), longest), bool)
        for r, k in enumerate(own):
            x[r, : len(chains[k])], mask[r, : len(chains[k])] = chains[k], True
        batches.append((x, mask, np.array([labels[k] for k in own]), begins[own].astype(float), of[own]))
    whole = np.array([len(x) for x in chains]) / np.maximum(of, 1)
    n, share = whole.sum(), np.average(labels, weights=whole)
    weight = np.array([0.5 / (1 - share), 0.5 / share])  # both kinds count the same
    w, moves, first = np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(2)
    squares = [np.full_like(v, 1e-6) for v in (w, moves, first)]
    for _ in range(steps):
        grads = [-decay * w, -decay * moves, -decay * first]
        for x, mask, y, begin, lines in batches:
            rows, longest, _ = x.shape
            each = weight[y] / (lines * n)
            emit = np.stack([np.zeros((rows, longest)), x @ w], -1)
            f, b = np.zeros((rows, longest, 2)), np.zeros((rows, longest, 2))
            f[:, 0] = begin[:, None] * first + emit[:, 0]
            for t in range(1, longest):
                f[:, t] = np.logaddexp(f[:, t - 1, :1] + moves[0], f[:, t - 1, 1:] + moves[1]) + emit[:, t]
            last = mask.sum(1) - 1
            z = np.logaddexp(*f[np.arange(rows), last].T)
            for t in range(longest - 2, -1, -1):
                ahead = emit[:, t + 1] + b[:, t + 1]
                b[:, t] = np.where(mask[:, t + 1, None], np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:]), 0)
            p = np.exp(f + b - z[:, None, None]) * mask[..., None]
            truth = np.stack([y == 0, y == 1], -1)[:, None, :] * mask[..., None]
            grads[0] += np.einsum("rtf,rt,r->f", x, truth[..., 1] - p[..., 1], each)
            grads[2] += ((truth - p)[:, 0] * (each * begin)[:, None]).sum(0)
            if longest > 1:
                pair = np.exp(f[:, :-1, :, None] + moves + (emit + b)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
                real = np.zeros_like(pair)
                real[np.arange(rows), :, y, y] = mask[:, 1:]
                grads[1] += np.einsum("rtij,r->ij", real - pair, each)
        for v, g, s in zip((w, moves, first), grads, squares, strict=True):
            s += g**2
            v += rate * g / np.sqrt(s)
    return Field(w, moves, first)


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, lines: int = LINES) -> Field:
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("at", pa.int64()), ("of", pa.int64()), ("x", pa.binary())]))
        for doc_id, quality, text in rows_of(batches, "doc_id", "quality", "text"):
            x = line_features(text)[0].astype(np.float32)
            for at in range(0, len(x), lines):
                part = x[at : at + lines]
                out.add(doc_id, quality, at, len(x), part.tobytes(), size=part.nbytes)
                if out.full():
                    yield out.take()
        yield out.take()

    # the sample is bounded, so it may be sent to every executor
    picked = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select(F.col("doc_id").cast("long"), "quality", "text")
    got = sorted(picked.mapInArrow(run, "doc_id bigint, quality int, at bigint, of bigint, x binary").toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["at"], r["of"], r["x"]))
    chains = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES).astype(float) for r in got]
    return fit(chains, [int(r["quality"] > 0) for r in got], begins=[r["at"] == 0 for r in got], of=[r["of"] for r in got])


def base(docs: DataFrame) -> DataFrame:
    """doc_id with the base counts and base_failed, without the field."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(word_hash)
        for batch in batches:
            found = [base_counts(text, memo) for (text,) in rows_of([batch], "text")]
            counts = {n: pa.array([f[k] for f in found], pa.int64()) for k, n in enumerate(names)}
            yield pa.record_batch({"doc_id": batch.column("doc_id")} | counts | {"base_failed": pa.array([base_failed(f[0], f[4]) for f in found], pa.bool_())})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, " + "".join(f"{n} bigint, " for n in names) + "base_failed boolean")


def judge(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, least: float = CONTENT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share."""
    field = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample=sample))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, out = Memo(word_hash), None
        for batch in batches:
            if out is None:
                out = Out(pa.schema([("doc_id", batch.schema.field("doc_id").type), *((n, pa.int64()) for n in counts), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64())]))
            for doc_id, text in rows_of([batch], "doc_id", "text"):
                found = base_counts(text, memo)
                failed = base_failed(found[0], found[4])
                share = field.value.content_share(text)
                out.add(doc_id, *found, failed, not failed and share >= least, share)
                if out.full():
                    yield out.take()
        if out is not None:
            yield out.take()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, " + "".join(f"{n} bigint, " for n in counts) + "base_failed boolean, kept boolean, content_share double")
