"""Language-model scores: the marginal probability of a text over all its segmentations into subwords.

The vocabulary is a public tokenizer's, as it is.  It has no unigram scores of its own (its numbers are ranks of merges), so
the pieces' probabilities come from the training documents: the tokenizer's segmentation of every training word, counted
as often as the word occurs, and then ROUNDS of expectation-maximization over the words' lattices (forward and backward).
A forward recursion over each distinct word's lattice adds up the probabilities of all its segmentations, in logarithms
from end to end, so that words of any length and of any characters have a finite score.  No piece crosses a word, so a
text's probability is the product of its words' and of the end's: that is ``score``.

Two scores stand beside it.  base_score is an add-one unigram score of whole words, from exact counts.  mixed_score has the
word itself, as seen in training, as one more path: the paths through pieces share the mass that Good and Turing leave for
unseen words (words seen once over all tokens), the whole words the rest.

Counts of all words form a table.  Words of at most LONG bytes, common enough that at most HEAD of them exist, are sent to
every executor; the rest of a text's words are joined with the table.  What a task holds is bounded in bytes, whatever the
words' lengths, but for the text at hand.

Nulls, ties, repeats: a null text is an empty one and scores its end alone; a row with a null doc_id is learnt from;
repeated rows count each; without training rows all counts are 0 and pieces are equally likely; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, Out, cut, lower_words, rows_of

VOCABULARY = "piece_bpe_32k.model"
FOLDS, HELD = 7, 2
#: Words sent to every executor, at most.
HEAD = 200_000
#: Bytes of a word that is sent or remembered, at most.
LONG = 200
#: Bytes of distinct words that a task counts before it passes them on, about.
COUNTED = 32_000_000
#: Added to each piece's count.
SMOOTHING = 0.1
#: Passes over the training words that weigh their segmentations.
ROUNDS = 2

_SPACE = "▁"
#: Letters of a batch of words whose lattices are run through together; a word longer than _ALONE is run through by itself.
_LETTERS, _ALONE = 60_000, 200


def held_out(folds: int = FOLDS, held: int = HELD):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False))


@lru_cache(maxsize=2)
def _tokenizer(path: str | None):
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return sentencepiece.SentencePieceProcessor(model_file=path)


class Pieces:
    """Probabilities of pieces, with the bytes that stand for characters without a piece."""

    def __init__(self, counts: dict[int, float], ends: float, path: str | None = None, smoothing: float = SMOOTHING):
        tokenizer = _tokenizer(path)
        size = tokenizer.get_piece_size()
        real = [i for i in range(size) if not (tokenizer.is_control(i) or tokenizer.is_unknown(i) or tokenizer.is_unused(i))]
        total = sum(counts.get(i, 0) for i in real) + ends + smoothing * (len(real) + 1)
        self.p, self.bytes = {}, [0.0] * 256
        for i in real:
            p = (counts.get(i, 0) + smoothing) / total
            if tokenizer.is_byte(i):
                self.bytes[int(tokenizer.id_to_piece(i)[3:5], 16)] = p
            else:
                self.p[tokenizer.id_to_piece(i)] = p
        self.log = {piece: math.log(p) for piece, p in self.p.items()}
        self.end = math.log10((ends + smoothing) / total)
        # a start is a dead end sooner if no piece begins so
        self.begins = {piece[:k] for piece in self.p for k in range(1, len(piece) + 1)}

    def _unknown(self, char: str) -> float:
        return math.prod(self.bytes[b] for b in char.encode())

    def edges(self, s: str, i: int) -> Iterator[tuple[int, str | None, float]]:
        """(end, piece or None for a character spelled in bytes, log p) of what can start at i."""
        if s[i] not in self.log:
            yield i + 1, None, math.log(self._unknown(s[i]))
        for j in range(i + 1, len(s) + 1):
            piece = s[i:j]
            if piece not in self.begins:
                return
            if (lp := self.log.get(piece)) is not None:
                yield j, piece, lp

    def forward(self, s: str) -> list[float]:
        """The logarithm of the sum over all segmentations of s[:k], for each k."""
        f = [0.0] + [-math.inf] * len(s)
        for i in range(len(s)):
            here = f[i]
            for j, _, lp in self.edges(s, i):
                f[j] = _plus(f[j], here + lp)
        return f

    def _log_sum(self, s: str) -> float:
        return self.forward(s)[-1]

    def word(self, word: bytes) -> float:
        """log10 of the sum over all segmentations."""
        return self._log_sum(_SPACE + word.decode()) / math.log(10)


def _plus(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -math.inf else a


class Lattices:
    """The same recursions over many words' lattices at once, by array operations."""

    def __init__(self, pieces: Pieces, path: str | None = None):
        tokenizer = _tokenizer(path)
        self.pieces = pieces
        self.ids = {piece: tokenizer.piece_to_id(piece) for piece in pieces.p}
        self.byte_ids = [tokenizer.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        begins = sorted(pieces.begins)
        key = np.array([self._key(s) for s in begins], np.uint64)
        order = np.argsort(key)
        self.key = key[order]
        self.piece = np.array([self.ids.get(s, -1) for s in begins])[order]
        self.log = np.array([pieces.log.get(s, -math.inf) for s in begins])[order]
        self.spelled = Memo(lambda c: math.log(pieces._unknown(chr(c))))

    @staticmethod
    def _key(s: str) -> int:
        h = 0
        for c in s:
            h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _edges(self, letters: np.ndarray, length: np.ndarray, start: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """(words, end, piece or -1 - character, log p) of what can start at a place; a word is in each of them once at most."""
        word, end = np.flatnonzero(length > start), start
        h = np.zeros(len(word), np.uint64)
        while len(word):
            h = h * np.uint64(0x9E3779B97F4A7C15) + letters[word, end].astype(np.uint64) + np.uint64(1)
            end += 1
            at = np.searchsorted(self.key, h)
            at[at == len(self.key)] = 0
            known = self.key[at] == h
            whole = known & (self.piece[at] >= 0)
            yield word[whole], end, self.piece[at[whole]], self.log[at[whole]]
            if end == start + 1 and not whole.all():  # a character without a piece is spelled in bytes
                odd = word[~whole]
                char = letters[odd, start].astype(np.int64)
                yield odd, end, -1 - char, np.array([self.spelled[c] for c in char.tolist()])
            more = known & (end < length[word])
            word, h = word[more], h[more]

    @staticmethod
    def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        length = np.array([len(w) for w in words])
        letters = np.zeros((len(words), int(length.max())), np.uint32)
        letters[np.arange(letters.shape[1]) < length[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        return letters, length

    @staticmethod
    def _forward(steps: Iterable[Iterable[tuple]], length: np.ndarray) -> np.ndarray:
        f = np.full((int(length.max()) + 1, len(length)), -np.inf)
        f[0] = 0
        for i, step in enumerate(steps):
            for word, end, _, lp in step:
                f[end, word] = np.logaddexp(f[end, word], f[i, word] + lp)
        return f

    def sums(self, words: list[str]) -> np.ndarray:
        """log10 of the sums over all segmentations."""
        out = np.zeros(len(words))
        for part in _batches(words):
            own = [words[k] for k in part]
            if len(own) == 1:
                out[part] = self.pieces._log_sum(own[0])
            else:
                letters, length = self._letters(own)
                steps = (self._edges(letters, length, i) for i in range(letters.shape[1]))
                out[part] = self._forward(steps, length)[length, np.arange(len(own))]
        return out / math.log(10)

    def expect(self, words: list[str], into: Counter, times: list[float] | None = None) -> None:
        """Add the pieces' expected counts in words, each counted so many times, to a counter."""
        for part in _batches(words):
            own, weight = [words[k] for k in part], np.array([1.0 if times is None else times[k] for k in part])
            found = self._expected_alone(own[0], float(weight[0])) if len(own) == 1 else self._expected(own, weight)
            for i, x in found:
                for k in [i] if i >= 0 else [self.byte_ids[c] for c in chr(-1 - i).encode()]:
                    into[k] += x

    def _expected(self, words: list[str], weight: np.ndarray) -> Iterator[tuple[int, float]]:
        letters, length = self._letters(words)
        steps = [list(self._edges(letters, length, i)) for i in range(letters.shape[1])]  # of a batch, so bounded
        f, n = self._forward(steps, length), np.arange(len(words))
        total, b = f[length, n], np.full(f.shape, -np.inf)
        b[length, n] = 0
        pieces, expected = [], []
        for i in range(letters.shape[1] - 1, -1, -1):
            for word, end, piece, lp in steps[i]:
                ahead = lp + b[end, word]
                b[i, word] = np.logaddexp(b[i, word], ahead)
                pieces.append(piece)
                expected.append(np.exp(f[i, word] + ahead - total[word]) * weight[word])
        kinds, kind = np.unique(np.concatenate(pieces), return_inverse=True)
        yield from zip(kinds.tolist(), np.bincount(kind, np.concatenate(expected)).tolist(), strict=True)

    def _expected_alone(self, s: str, weight: float) -> Iterator[tuple[int, float]]:
        f = self.pieces.forward(s)
        b = [-math.inf] * len(s) + [0.0]
        for i in range(len(s) - 1, -1, -1):
            for j, piece, lp in self.pieces.edges(s, i):
                ahead = lp + b[j]
                b[i] = _plus(b[i], ahead)
                yield -1 - ord(s[i]) if piece is None else self.ids[piece], math.exp(f[i] + ahead - f[-1]) * weight


def _batches(words: list[str]) -> Iterator[list[int]]:
    """The words' places by length, as many as their longest allows; words longer than _ALONE one by one."""
    order, at = sorted(range(len(words)), key=lambda k: len(words[k])), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (size := len(words[order[end]])) <= _ALONE and size * (end - at + 1) <= _LETTERS:
            end += 1
        yield order[at:end]
        at = end


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, n): how often each lower-cased word occurs in training documents and in all."""
    marked = docs.select("text", held_out().alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, rest, read = Counter(), Counter(), 0

        def flush() -> pa.RecordBatch:
            keys = list(train.keys() | rest.keys())
            made = pa.record_batch({"word": pa.array(keys, pa.binary()), "c": pa.array([train[w] for w in keys], pa.int64()), "n": pa.array([train[w] + rest[w] for w in keys], pa.int64())})
            train.clear()
            rest.clear()
            return made

        for text, held in rows_of(batches, "text", "held"):
            (rest if held else train).update(lower_words(text))
            read += len(text or b"")
            if read >= COUNTED and (read := sum(map(len, train)) + sum(map(len, rest))) >= COUNTED // 2 or len(train) + len(rest) >= 1_000_000:
                yield flush()
                read = 0
        yield flush()

    return marked.mapInArrow(run, "word binary, c bigint, n bigint").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _segmented(words: list[str], times: list[int], tokenizer, into: Counter) -> None:
    """Count the pieces of the tokenizer's own segmentation; it would normalize odd characters, so those count one by one."""
    odd = [_ODD.search(w) is not None for w in words]
    plain = [c for c, o in zip(times, odd, strict=True) if not o]
    for ids, c in zip(tokenizer.encode([w for w, o in zip(words, odd, strict=True) if not o], num_threads=1), plain, strict=True):
        for i in ids:
            into[i] += c
    space = tokenizer.piece_to_id(_SPACE)
    for w, c in ((w, c) for w, c, o in zip(words, times, odd, strict=True) if o):
        into[space] += c
        for char in w:
            i = tokenizer.piece_to_id(char)
            for k in [i] if not tokenizer.is_unknown(i) else [tokenizer.piece_to_id(f"<0x{b:02X}>") for b in char.encode()]:
                into[k] += c


_ODD = re.compile(r"[^!-~À-ɏ]")


def piece_counts(counts: DataFrame, ends: int, path: str | None = None, rounds: int = ROUNDS) -> dict[int, float]:
    """How often each piece occurs in the training words, one number per piece of the vocabulary.

    The tokenizer's segmentations come first; in each further round every word adds its pieces' expected counts.
    """
    spark, found = counts.sparkSession, {}
    for k in range(rounds + 1):
        sent = spark.sparkContext.broadcast(found) if k else None

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tokenizer, made = _tokenizer(path), Counter()
            lattices = Lattices(Pieces(sent.value, ends, path), path) if sent else None
            for batch in batches:
                for at in range(0, batch.num_rows, 10_000):
                    part = batch.slice(at, 10_000)
                    words, times = [w.decode() for w in part.column("word").to_pylist()], part.column("c").to_pylist()
                    if lattices is None:
                        _segmented(words, times, tokenizer, made)
                    else:
                        lattices.expect([_SPACE + w for w in words], made, times)
            yield pa.record_batch({"piece": pa.array(list(made), pa.int64()), "k": pa.array(list(map(float, made.values())), pa.float64())})

        rows = counts.where("c > 0").select("word", "c").mapInArrow(run, "piece bigint, k double").groupBy("piece").agg(F.sum("k").alias("k")).collect()
        found = {r["piece"]: r["k"] for r in rows}
    return found


def score(docs: DataFrame, *, path: str | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mixed_score."""
    return _scored(docs, path, head, models=True)


def base(docs: DataFrame, *, head: int = HEAD) -> DataFrame:
    """score()'s columns up to base_score, by the same counts and passes over the texts, without pieces and lattices, which only the others need."""
    return _scored(docs, None, head, models=False).drop("score", "mixed_score")


def _scored(docs: DataFrame, path: str | None, head: int, models: bool) -> DataFrame:
    """score(); without models each word's logarithms are 0 in score and mixed_score."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counts = cut(word_counts(docs), "words")
    ends = docs.where(~held_out()).count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once")).collect()[0]
    total, kinds = sums["c"] + ends, sums["v"] + (ends > 0)
    bottom = total + kinds + 1
    unseen = min(max((sums["once"] + 1) / (total + 1), 1e-4), 1.0)

    def mixed(c: int, lp: float) -> float:
        """log10 of the word's share of the seen mass and its lattice's of the unseen."""
        parts = [math.log((1 - unseen) * c / total)] if c and unseen < 1 else []
        return _plus(parts[0] if parts else -math.inf, math.log(unseen) + lp * math.log(10)) / math.log(10)

    pieces = Pieces(piece_counts(counts, ends, path), ends, path) if models else None
    end = pieces.end if models else 0.0
    sent_pieces = spark.sparkContext.broadcast(pieces) if models else None

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(sent_pieces.value, path)
        for batch in batches:
            lp = lattices.sums([_SPACE + w.decode() for w in batch.column("word").to_pylist()]).tolist()
            own = [mixed(c, x) for c, x in zip(batch.column("c").to_pylist(), lp, strict=True)]
            yield batch.append_column("lp", pa.array(lp, pa.float64())).append_column("mp", pa.array(own, pa.float64()))

    level = F.floor(8 * F.log2(F.col("n"))).cast("int")
    least, seen = 0, 0
    short = F.length("word") <= LONG
    for r in sorted(counts.where(short).groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["level"]):  # at most 8 levels per doubling
        seen += r["k"]
        least = r["level"] + 1 if seen > head else least
        if seen > head:
            break
    table = cut(counts.select("word", "c", "n").mapInArrow(weigh, "word binary, c bigint, n bigint, lp double, mp double"), "scored") if models else counts.withColumns({"lp": F.lit(0.0), "mp": F.lit(0.0)})
    sent = short & (level >= least)
    common = table.where(sent).select("word", "c", "lp", "mp").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(common.column("word").to_pylist(), zip(*(common.column(n).to_pylist() for n in ("c", "lp", "mp")), strict=True), strict=True)))
    del common

    row = "doc_id {0}, row bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, mixed_score double".format(dict(docs.dtypes)["doc_id"])

    def by_models():
        common = Memo(lambda w: (r := known.value.get(w)) and (r[0], math.log10((r[0] + 1) / bottom), r[1], r[2]))

        def weighed(tokens: list[bytes]) -> tuple:
            n_known, base, lp, mp, rest = int(ends > 0), math.log10((ends + 1) / bottom), end, mixed(ends, end), []
            for w, tf in Counter(tokens).items():
                if (r := common[w] if len(w) <= LONG else None) is None:
                    rest.append({"word": w, "tf": tf})
                else:
                    n_known += tf * (r[0] > 0)
                    base += tf * r[1]
                    lp += tf * r[2]
                    mp += tf * r[3]
            return n_known, base, lp, mp, rest

        return weighed

    def by_counts():
        counted = {w: float(r[0]) for w, r in known.value.items()}

        def weighed(tokens: list[bytes]) -> tuple:
            c = np.array(list(map(counted.get, tokens)), np.float64)  # nan for words that aren't sent
            sent = ~np.isnan(c)
            rest = [] if sent.all() else [{"word": w, "tf": tf} for w, tf in Counter(compress(tokens, ~sent)).items()]
            c = np.append(c[sent], float(ends))
            return int((c > 0).sum()), float((np.log10((c + 1) / bottom)).sum()), 0.0, 0.0, rest

        return weighed

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighed, out = (by_models if models else by_counts)(), None
        for batch in batches:
            if out is None:
                out = Out(pa.schema([("doc_id", batch.schema.field("doc_id").type), ("row", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("mixed_score", pa.float64()), ("rest", pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())])))]))
            for doc_id, k, held, text in rows_of([batch], "doc_id", "row", "held", "text"):
                tokens = lower_words(text)
                n_known, base, lp, mp, rest = weighed(tokens)
                out.add(doc_id, k, held, len(tokens) + 1, n_known, base, lp, mp, rest, size=sum(40 + len(r["word"]) for r in rest))
                if out.full():
                    yield out.take()
        if out is not None:
            yield out.take()

    halves = cut(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), held_out().alias("held"), "text").mapInArrow(read, row + ", rest array<struct<word: binary, tf: bigint>>"), "halves")
    rest = halves.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.tf").join(table.where(~sent).select("word", "c", "lp", "mp"), "word")
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("k"), F.sum(F.col("tf") * F.log10((F.col("c") + 1) / F.lit(bottom))).alias("b"), F.sum(F.col("tf") * F.col("lp")).alias("s"), F.sum(F.col("tf") * F.col("mp")).alias("m"))
    plus = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x)
    return halves.drop("rest").join(rest, "row", "left").select("doc_id", "held_out", "n_tokens", plus("n_known", "k"), F.lit(total).cast("long").alias("train_tokens"), plus("base_score", "b"), plus("score", "s"), plus("mixed_score", "m"))
