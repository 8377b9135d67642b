"""Language-model scores from a subword lattice: all segmentations into an existing vocabulary's pieces count.

The pieces of a SentencePiece vocabulary, every single byte and an end mark are the units of a unigram model. Pieces
hold the blank mark at their start only, so a text's lattice falls apart into those of its words, mark in front: its
probability is the product of its words' marginals (the sum over all segmentations, by a forward recursion in log
space) and the end's. Each distinct word is thus scored once, wherever it occurs, and the words are counted, trained on
and scored as a table over all tasks.

The vocabulary's own scores are the first weights (merge ranks r stand for 1 / (1 + r)); ROUNDS rounds of expectation
maximisation over the training rows' words, forwards and backwards, replace them, with the first weights as a prior.

Words meet the texts again in two ways: those above a count that at most FREQUENT words reach are sent to every task,
so that no frequent word is a join key; all others meet the rows in a shuffle join. Texts themselves never move.

Results for odd input: a null text is empty, an empty text is one end token; a null id is not held out; repeated rows
get a row each; with no training rows the first weights score and every count is 0; an empty table has no rows; only
the two named columns are read.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairflow.llm import textkit, worker
from pairflow.workspace import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FOLDS, HELD_OUT = 5, 1
ROUNDS = 2
FREQUENT = 400_000  # words sent to the tasks, of at most FREQUENT_BYTES bytes each
FREQUENT_BYTES = 64
COUNTED = 200_000  # distinct words that a task counts before it passes them on
COUNTED_BYTES = 16 << 20
LATTICE_BYTES = 1 << 18
MARK = "▁".encode()
_BASE = 0x9E3779B97F4A7C15
_VALUE = np.random.default_rng(1012).integers(1, 2**63, 256, dtype=np.uint64)
_FILTER_BITS = 18


def _powers(base: int, n: int) -> np.ndarray:
    table = np.full(n, base % 2**64, np.uint64)
    table[:1] = 1
    return np.cumprod(table, dtype=np.uint64)


class Units:
    """The vocabulary: single bytes are units 0 to 255, pieces of two bytes or more follow, the end is the last."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: list[bytes] = [bytes([b]) for b in range(256)]
        rank = [float(model.get_piece_size())] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i).encode()
            # Texts are lower-cased and words hold no blank: other pieces can't occur.
            if (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
                    or any(65 <= b <= 90 for b in piece) or MARK in piece[1:]):
                continue
            if len(piece) == 1:
                rank[piece[0]] = -model.get_score(i)
            else:
                self.pieces.append(piece)
                rank.append(-model.get_score(i))
        weights = 1 / (1 + np.array([*rank, 0.0]))
        self.prior = weights / weights.sum()
        self.end = len(self.pieces)
        self.tables = {}
        sizes = np.array([len(p) for p in self.pieces])
        for k in sorted({int(x) for x in sizes if x > 1}):
            ids = np.flatnonzero(sizes == k)
            data = np.frombuffer(b"".join(self.pieces[i] for i in ids), np.uint8).reshape(-1, k)
            hashes = (_VALUE[data] * _powers(_BASE, k)).sum(axis=1, dtype=np.uint64)
            order = np.argsort(hashes)
            maybe = np.zeros(1 << _FILTER_BITS, bool)
            maybe[hashes >> np.uint64(64 - _FILTER_BITS)] = True
            self.tables[k] = (hashes[order], ids[order], maybe)

    def trained(self, expected: np.ndarray | None, ends: float) -> np.ndarray:
        """Natural logs of the units' probabilities; the prior counts as much as one occurrence of every unit."""
        counts = np.zeros(len(self.prior)) if expected is None else expected.copy()
        counts[self.end] += ends
        counts += self.prior * len(self.prior)
        return np.log(counts / counts.sum())


class Lattice:
    """All segmentations of some words, as edges between byte positions; a word's nodes lie side by side."""

    def __init__(self, units: Units, words: list[bytes]):
        buffer = np.frombuffer(b"".join(MARK + w for w in words), np.uint8)
        lengths = np.fromiter((len(w) + len(MARK) for w in words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        n = len(buffer)
        self.word = np.repeat(np.arange(len(words)), lengths)
        offset = np.arange(n) - np.repeat(starts, lengths) + 1
        node = np.arange(n) + self.word + 1
        self.first, self.last, self.nodes = starts + np.arange(len(words)), starts + np.arange(len(words)) + lengths, n + len(words)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[buffer] * _powers(_BASE, n), out=sums[1:])
        down = _powers(pow(_BASE, -1, 2**64), n + 1)
        ends, sizes, units_of = [np.arange(n)], [np.ones(n, np.int64)], [buffer.astype(np.int64)]
        open_at = np.arange(n)
        for k, (hashes, ids, maybe) in units.tables.items():
            open_at = open_at[offset[open_at] >= k]
            h = (sums[open_at + 1] - sums[open_at + 1 - k]) * down[open_at + 1 - k]
            likely = np.flatnonzero(maybe[h >> np.uint64(64 - _FILTER_BITS)])
            place = np.minimum(np.searchsorted(hashes, h[likely]), len(hashes) - 1)
            found = hashes[place] == h[likely]
            ends.append(open_at[likely[found]])
            sizes.append(np.full(int(found.sum()), k))
            units_of.append(ids[place[found]])
        end, size, unit = map(np.concatenate, (ends, sizes, units_of))
        self.unit, self.word = unit, self.word[end]
        self.to, self.offset = node[end], offset[end]
        self.start, self.start_offset = self.to - size, self.offset - size

    def _swept(self, values: np.ndarray, read: np.ndarray, write: np.ndarray, step: np.ndarray, cost: np.ndarray) -> None:
        """values[write] = log of the sum over edges of exp(values[read] + cost), one step (a position in words) at a time."""
        order = np.lexsort((write, step))
        read, write, step, cost = read[order], write[order], step[order], cost[order]
        cuts = np.flatnonzero(np.diff(step)) + 1
        new = np.ones(len(write), bool)
        new[1:] = (write[1:] != write[:-1]) | (step[1:] != step[:-1])
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(step)]):
            if b == a:
                continue
            x = values[read[a:b]] + cost[a:b]
            at = np.flatnonzero(new[a:b])
            top = np.maximum.reduceat(x, at)
            x -= np.repeat(top, np.diff([*at, b - a]))
            values[write[a:b][at]] = top + np.log(np.add.reduceat(np.exp(x), at))

    def forward(self, logs: np.ndarray) -> np.ndarray:
        values = np.full(self.nodes, -np.inf)
        values[self.first] = 0
        self._swept(values, self.start, self.to, self.offset, logs[self.unit])
        return values

    def marginals(self, logs: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability."""
        return self.forward(logs)[self.last]

    def expected(self, logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of every unit in all segmentations, words weighted by counts."""
        ahead = self.forward(logs)
        behind = np.full(self.nodes, -np.inf)
        behind[self.last] = 0
        cost = logs[self.unit]
        self._swept(behind, self.to, self.start, -self.start_offset, cost)
        posterior = np.exp(ahead[self.start] + cost + behind[self.to] - ahead[self.last][self.word])
        return np.bincount(self.unit, weights=posterior * counts[self.word], minlength=len(logs))


def _lattices(units: Units, column: pa.Array) -> Iterator[tuple[int, int, Lattice]]:
    words = textkit.text_bytes(column)
    for a, b in textkit.slices([len(w) + len(MARK) for w in words], LATTICE_BYTES):
        yield a, b, Lattice(units, words[a:b])


def word_table(docs: DataFrame) -> DataFrame:
    """word, c (in training rows), n (in all rows) of id, held_out, text rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: tuple[Counter, Counter] = (Counter(), Counter())

        def passed_on() -> pa.RecordBatch:
            words = list(both[0].keys() | both[1].keys())
            train = np.fromiter((both[0][w] for w in words), np.int64, len(words))
            other = np.fromiter((both[1][w] for w in words), np.int64, len(words))
            for c in both:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(train), pa.array(train + other)],
                                              names=["word", "c", "n"])

        held_bytes = 0
        for batch in batches:
            texts, held = textkit.text_bytes(batch.column(1)), batch.column(0).to_pylist()
            for text, out in zip(texts, held):
                both[out].update(text.lower().split())
                held_bytes += len(text)
                if held_bytes > COUNTED_BYTES or len(both[0]) + len(both[1]) > COUNTED:
                    yield passed_on()
                    held_bytes = 0
        if both[0] or both[1]:
            yield passed_on()

    parts = docs.select("held_out", "text").mapInArrow(run, "word string, c long, n long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def train(words: DataFrame, units: Units, ends: float, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the units after some rounds over a table of word, c."""
    logs = units.trained(None, ends)
    for _ in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], logs: np.ndarray = logs) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(logs))
            for batch in batches:
                counts = textkit.numbers(batch.column(1)).astype(np.float64)
                for a, b, lattice in _lattices(units, batch.column(0)):
                    total += lattice.expected(logs, counts[a:b])
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["unit", "uses"])

        uses = (words.filter("c > 0").select("word", "c").mapInArrow(run, "unit int, uses double")
                .groupBy("unit").agg(F.sum("uses").alias("uses")).toArrow())
        expected = np.zeros(len(logs))
        expected[textkit.numbers(uses.column("unit")).astype(np.int64)] = textkit.numbers(uses.column("uses"))
        logs = units.trained(expected, ends)
    return logs


def weighed(words: DataFrame, units: Units, logs: np.ndarray) -> DataFrame:
    """word, n, c, log10 of the word's marginal probability."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, lattice in _lattices(units, batch.column(0)):
                out[a:b] = lattice.marginals(logs) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=["word", "n", "c", "log_p"])

    return words.select("word", "n", "c").mapInArrow(run, "word string, n long, c long, log_p double")


def _frequent(weights: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """At most `most` words above a count, and all others: no other word occurs more often than a share of 1 / most,
    but for those too long to send."""
    short = F.octet_length("word") <= FREQUENT_BYTES
    level = F.floor(F.log2("n") * 8)  # at most some 500 values
    sizes = weights.filter(short).groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    total, least = 0, math.inf
    for row in sizes:
        if total + row["count"] > most:
            break
        total, least = total + row["count"], row["level"]
    often = short & (level >= F.lit(float(least)))
    return weights.filter(often), weights.filter(~often)


def score(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities) of every row."""
    with worker.batches_of(docs.sparkSession):  # what runs later needs no Python
        return _scored(docs, path, id_col, text_col)


def _scored(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    ident = docs[id_col].cast("long")
    remainder = F.crc32(ident.cast("string").cast("binary")) % FOLDS
    rows = docs.select(ident.alias("doc_id"), F.coalesce(remainder == HELD_OUT, F.lit(False)).alias("held_out"),
                       docs[text_col].cast("string").alias("text"))
    units = Units(path)
    words = materialize(word_table(rows), "words")
    trained_on = rows.filter("NOT held_out").count()
    tokens, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.expr("nullif(c, 0)"))).first()
    tokens, distinct = tokens + trained_on, distinct + (trained_on > 0)
    logs = train(words, units, trained_on)
    weights = materialize(weighed(words, units, logs), "weights")
    often, rare = _frequent(weights, FREQUENT)
    sent = spark.sparkContext.broadcast(often.toArrow())
    name = uuid.uuid4().hex
    smallest = math.log10(tokens + 0.5 * (distinct + 1))
    end = (math.log10(trained_on + 0.5) - smallest, float(logs[units.end] / math.log(10)), int(trained_on > 0))

    def table() -> tuple:
        held = sent.value
        c = textkit.numbers(held.column("c"))
        places = dict(zip(held.column("word").cast(pa.binary()).to_pylist(), range(held.num_rows)))
        # A last row for words that are not sent: they add nothing here.
        return places, *(np.append(x, 0.0) for x in (np.log10(c + 0.5) - smallest, textkit.numbers(held.column("log_p")), c > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, base, log_p, known = worker.latest("lattice_lm", name, table)
        other = len(places)
        rare_type = pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64())]))
        for batch in batches:
            texts = textkit.text_bytes(batch.column(3))
            for a, b in textkit.slices([len(t) for t in texts]):
                counts, found, left = [], [], []
                for text in texts[a:b]:
                    said = text.lower().split()
                    at = [places.get(w, other) for w in said]
                    counts.append(len(said))
                    found.append(np.array(at, np.int64))
                    left.append([{"word": w, "k": k} for w, k in Counter(
                        w.decode() for w, i in zip(said, at) if i == other).items()])
                row, at = np.repeat(np.arange(b - a), counts), np.concatenate(found)
                add = lambda v, e: np.bincount(row, weights=v[at], minlength=b - a) + e  # noqa: E731, B023
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(np.array(counts) + 1), pa.array(add(known, end[2]).astype(np.int64)),
                     pa.array(add(base, end[0])), pa.array(add(log_p, end[1])), pa.array(left, rare_type)],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

    part = materialize(
        rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInArrow(
            run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, "
                 "score double, rare array<struct<word: string, k: long>>"), "scores")
    sent.destroy()  # the scores are written
    met = part.select("row", F.inline("rare")).join(rare, "word")
    none = lambda kind: F.lit(None).cast(kind)
    more = met.select(
        "row", none("long").alias("doc_id"), none("boolean").alias("held_out"), none("long").alias("n_tokens"),
        F.when(F.col("c") > 0, F.col("k")).otherwise(0).alias("n_known"),
        (F.col("k") * (F.log10(F.col("c") + 0.5) - smallest)).alias("base_score"), (F.col("k") * F.col("log_p")).alias("score"))
    whole = part.drop("rare").unionByName(more).groupBy("row").agg(
        *[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")],
        *[F.sum(c).alias(c) for c in ("n_known", "base_score", "score")])
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
                        "base_score", "score")
