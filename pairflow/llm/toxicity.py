"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary texts, are counted over all labelled rows. Each class has its own
counts at both orders and backs off, at both orders, to counts that the classes share:

    shared(w)    = (N(w) + K) / (N + K V)                              N: distinct words before w, at least 1
    q_c(w)       = max(N_c(w) - D, 0) / W_c + B shared(w)
    b_c(w | h)   = (max(c(h w) - D, 0) + B(h) q_c(w)) / (c(h) + T)      c: texts with the bigram, of both classes
    p_c(w | h)   = (max(c_c(h w) - D, 0) + B_c(h) b_c(w | h)) / (c_c(h) + T_c)

The B are what makes each sum to 1; W_c is such that B is the same for both classes, so that unknown words speak for
neither; T_c is in proportion to the class; the discount D grows with the count, for counts
1, 2, 3 and more, and takes the whole of a count of 1. A passage that many texts
repeat has few distinct words before each of its words and is covered by the shared bigrams, and an expression of one
text has shared mass alone, so neither speaks for a class.

A word's evidence is log p_toxic - log p_ordinary. It is a sum of what its own counts, the word before it and the
bigram say, and each of these is the same constant wherever no class counts two texts, so the model is a table of key
and value that holds every entry with something to say, whatever its size. The entries that the most texts hold, at
most SENT of them, are sent to the tasks; the others, the rare ones, are sent as Bloom filters. Positions that may hold
one ask for its value in a join. Of a text that asks, only what the answers can change is kept meanwhile: the sum of its
evidence, its largest window without an open position, and the sums of those windows with one that can still be the
largest, given what rare entries add at most and at least. Neither texts nor evidence by position are stored. Texts ask
in waves, and a wave's shuffle files go with it.

Length-normalised comparisons describe a text: the mean evidence over all its words, and the mean over the WINDOWS
consecutive words where it is largest, as a long text can be toxic in one place. A logistic function of them, fitted
on labelled rows that were not counted, gives the score.

Ids decide the folds by crc32(id as text) mod 5: 0 is held out, 1 to 3 are counted, 4 fits the logistic function, on at
most CALIBRATION_ROWS rows. Labels are sent to the tasks if there are at most BROADCAST_LABELS, else texts meet them in a
shuffle join. Words are compared by hashes of 32 bits.

Results for odd input: null and empty texts have no evidence and get the score of a text whose two means are 0;
a null id counts as held out; repeated rows get a row each; an id with several labels counts as toxic if one
is; null labels are ignored; without labels of both classes every score is 0.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairflow.llm import bloom, keys as key_joins, textkit, worker
from pairflow.workspace import discard, materialize, scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DISCOUNTS = (1.0, 1.75, 2.0)  # of counts 1, 2, 3 and more
SHARED_FLOOR = 10.0
CLASS_MASS = 0.1
CONTEXT_MASS = 5.0
WINDOWS = (1, 4)
SENT = 6_000_000  # entries of 12 bytes
CUTS = (-0.7, 0.0, 1.0, 2.5)  # values that part the filters of rare entries, of 32 MB each at most
WAVE_ASKS = 4_000_000  # texts ask in waves of about so many questions, in WAVES at most, as each reads all rare entries
WAVES = 8
CALIBRATION_ROWS = 50_000
BROADCAST_LABELS = 2_000_000
SLICE = 1 << 20
LOW = 0xFFFFFFFF


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5


@dataclass
class Model:
    """Evidence is `base` plus the values of a position's three keys; `rare` holds the entries that are not sent."""
    keys: np.ndarray       # sorted
    values: np.ndarray
    base: float
    weights: np.ndarray    # bias, mean, windows
    rare: DataFrame | None = None
    filters: list | None = None  # of the rare keys: bits, and the least and the most that one adds, by kind of key

    def sent(self) -> tuple:
        """What is sent to the tasks: plain arrays, which need no import there."""
        return self.keys, self.values, self.base, self.filters


def words32(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes cut to 32 bits, never 0, and word counts; words are cleared of the punctuation that ends them."""
    hashes, counts = textkit.word_hashes([t.translate(_PLAIN) for t in texts])
    return np.maximum(hashes >> np.uint64(32), np.uint64(1)), counts


# ASCII marks become blanks, so that "word," and "word" are one word.
_PLAIN = bytes(32 if chr(i) in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))


def _lefts(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The word before each word; 0 at the start of a text."""
    left = np.zeros_like(tokens)
    left[1:] = tokens[:-1]
    left[(np.cumsum(counts) - counts)[counts > 0]] = 0
    return left


def position_keys(tokens: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Of every position: the keys of its word, of the word before it and of the bigram; 0 where there is none."""
    before = _lefts(tokens, counts) << np.uint64(32)
    return [tokens, before, np.where(before > 0, before | tokens, np.uint64(0))]


def evidence(sent: tuple, keys: list[np.ndarray]) -> np.ndarray:
    """log p_toxic - log p_ordinary of every position, without what rare entries add."""
    return _looked_up(sent, keys)[0]


def _looked_up(sent: tuple, keys: list[np.ndarray]) -> tuple[np.ndarray, list[tuple]]:
    """Evidence without what rare entries add, and for each of the keys the positions where it may be a rare entry's,
    with the least and the most that this adds."""
    known, values, base, filters = sent
    out, asking, none = np.full(len(keys[0]), base), [], np.zeros(0, dtype=np.int64)
    for kind, k in enumerate(keys):
        missing = k > 0
        if len(known):
            at = np.minimum(np.searchsorted(known, k), len(known) - 1)
            found = known[at] == k
            hit = np.flatnonzero(found)
            out[hit] += values[at[hit]]
            missing &= ~found
        places = np.flatnonzero(missing) if filters else none
        asks, low, high = may_be_rare(filters or [], k[places], kind)
        asking.append((places[asks], low[asks], high[asks]))
    return out, asking


def _hashes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of a key for its filter. A bigram's halves are words, so that as it stands it would find its bits set
    wherever both words are in some rare bigram."""
    return textkit.mix(keys), textkit.mix(keys ^ np.uint64(0x5851F42D4C957F2D))


def may_be_rare(filters: list[tuple], keys: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mask of the keys that the filters may hold, and the least and the most value of such a key; 0 is always one."""
    first, second = _hashes(keys)
    out, low, high = np.zeros(len(keys), dtype=bool), np.zeros(len(keys)), np.zeros(len(keys))
    for bits, least, most in filters:
        own = np.flatnonzero(bloom.contains(bits, first))
        own = own[bloom.contains(bits, second[own])]
        out[own] = True
        low[own], high[own] = np.minimum(low[own], least[kind]), np.maximum(high[own], most[kind])
    return out, low, high


def _filters(rare: DataFrame) -> list[tuple]:
    """A filter for the keys of (key, value) of each part of the values, with the least and the most value of its word,
    context and bigram entries."""
    word, context = F.shiftrightunsigned("key", 32) == 0, F.col("key").bitwiseAND(F.lit(LOW)) == 0
    kind = F.when(word, 0).when(context, 1).otherwise(2)
    part = sum((F.col("value") > c).cast("int") for c in CUTS)
    found = rare.groupBy(part.alias("part"), kind.alias("kind")).agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n")).collect()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = _hashes(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(both).view(np.int64))], names=["hash"])

    out = []
    for p in sorted({r["part"] for r in found}):
        kinds = {r["kind"]: r for r in found if r["part"] == p}
        least, most = ([float(kinds[k][name]) if k in kinds else 0.0 for k in range(3)] for name in ("low", "high"))
        hashed = rare.filter(part == p).select("key").mapInArrow(run, "hash long")
        out.append((bloom.build(hashed, "hash", bloom.bits_for(sum(r["n"] for r in kinds.values()))), least, most))
    return out


def described(values: np.ndarray) -> list[float]:
    """A text's mean evidence, and for each window width the largest mean evidence of a window."""
    n = len(values)
    if not n:
        return [0.0] * (1 + len(WINDOWS))
    sums = np.concatenate(([0.0], np.cumsum(values)))
    widths = [(w, min(w, n)) for w in WINDOWS]
    return [float(sums[-1] / n), *(float((sums[w:] - sums[:-w]).max() / full) for full, w in widths)]


def _bigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False) == 1
        texts = textkit.text_bytes(batch.column(0))
        for a, b in textkit.slices([len(t) for t in texts]):
            tokens, counts = words32(texts[a:b])
            texts_of = np.repeat(np.arange(b - a), counts)
            bigrams = _lefts(tokens, counts) << np.uint64(32) | tokens
            order = np.lexsort((bigrams, texts_of))
            bigrams, texts_of = bigrams[order], texts_of[order]
            once = np.ones(len(order), dtype=bool)  # a bigram counts once per text
            once[1:] = (bigrams[1:] != bigrams[:-1]) | (texts_of[1:] != texts_of[:-1])
            labels = toxic[a:b][texts_of[once]]
            keys, place = np.unique(bigrams[once], return_inverse=True)
            t = np.bincount(place[labels], minlength=len(keys))
            o = np.bincount(place[~labels], minlength=len(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(t.astype(np.int64)), pa.array(o.astype(np.int64))],
                names=["bigram", "t", "o"])
    worker.trim()


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(_id, text, toxic) of the rows of docs with a label, held-out rows left out."""
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("toxic")).filter(
        F.col("toxic").isNotNull() & F.col("_id").isNotNull() & (fold(F.col("_id")) != 0)).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    known = materialize(known, "labels")
    side = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    return rows.filter(fold(F.col("_id")) != 0).join(side, "_id")


def _above(c: str | Column) -> Column:
    """A count less its discount."""
    c = F.col(c) if isinstance(c, str) else c
    once, twice, more = DISCOUNTS
    return F.when(c >= 3, c - more).when(c == 2, c - twice).when(c == 1, c - once).otherwise(F.lit(0.0))


def _entries(counted: DataFrame) -> tuple[DataFrame, float] | None:
    """All entries (key, value, n: texts or contexts that hold it) and the evidence of an unknown word, from bigram
    counts; None if a class has no text."""
    left, right = F.shiftrightunsigned("bigram", 32), F.col("bigram").bitwiseAND(F.lit(LOW))
    words = counted.groupBy(right.alias("word")).agg(
        F.count_if(F.col("t") > 0).alias("nt"), F.count_if(F.col("o") > 0).alias("no"), F.count(F.lit(1)).alias("n"))
    words = materialize(words, "words")
    total = words.agg(F.sum("nt"), F.sum("no"), F.sum("n"), F.count(F.lit(1)), F.sum(_above("nt")), F.sum(_above("no"))).first()
    if not total[0] or not total[1]:
        return None
    n_class, n_all, n_types = (float(total[0]), float(total[1])), float(total[2]), float(total[3])
    # The same share of free mass in both classes, so that unknown words speak for neither.
    known = [spent / n for n, spent in zip(n_class, total[4:6])]
    whole_of = [n * (1.0 + CLASS_MASS) * (k / max(known) if k else 1.0) for n, k in zip(n_class, known)]
    free = [1.0 - k * n / w for k, n, w in zip(known, n_class, whole_of)]
    # A larger class needs more mass for what it lacks, else that would be evidence for the smaller one.
    mass = [CONTEXT_MASS * n / min(n_class) for n in n_class]

    def q(own: Column, k: int) -> Column:
        shared = (F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)) + SHARED_FLOOR) / (n_all + SHARED_FLOOR * n_types)
        return _above(F.coalesce(own, F.lit(0))) / whole_of[k] + free[k] * shared

    base = math.log(free[0]) - math.log(free[1])  # 0, but where a class has no word above its discount
    of_word = F.log(q(F.col("nt"), 0)) - F.log(q(F.col("no"), 1))
    for_words = words.filter(F.greatest("nt", "no") > 1).select(
        F.col("word").alias("key"), (of_word - base).alias("value"), "n")
    both = F.col("t") + F.col("o")
    contexts = counted.filter(left != 0).groupBy(left.alias("word")).agg(
        F.sum("t").alias("ct"), F.sum("o").alias("co"), F.sum(_above("t")).alias("st"), F.sum(_above("o")).alias("so"),
        F.sum(_above(both)).alias("sc")).filter("sc > 0")
    contexts = materialize(contexts, "contexts")

    def back(c: Column, spent: Column, m: float) -> Column:
        return (c + m - spent) / (c + m)

    back_t, back_o = (back(F.col(f"c{c}"), F.col(f"s{c}"), m) for c, m in zip("to", mass))
    of_context = F.log(back_t) - F.log(back_o)
    for_contexts = contexts.select(F.shiftleft("word", 32).alias("key"), of_context.alias("value"), (F.col("ct") + F.col("co")).alias("n"))
    # A bigram of two texts or more has a context with spent mass; its word may have nothing to say by itself.
    seen = counted.filter((both > 1) & (left != 0)).select("bigram", "t", "o", left.alias("h"), right.alias("w"))
    seen = seen.join(contexts.withColumnRenamed("word", "h"), "h").join(words.withColumnRenamed("word", "w"), "w")
    every = F.col("ct") + F.col("co")

    def p(c: str, k: int, back_c: Column) -> Column:
        b = (_above(both) + (every + CONTEXT_MASS - F.col("sc")) * q(F.col(f"n{c}"), k)) / (every + CONTEXT_MASS)
        return _above(c) / (F.col(f"c{c}") + mass[k]) + back_c * b

    whole = F.log(p("t", 0, back_t)) - F.log(p("o", 1, back_o))
    for_bigrams = seen.select(F.col("bigram").alias("key"), (whole - of_context - of_word).alias("value"), both.alias("n"))
    entries = for_words.unionByName(for_contexts).unionByName(for_bigrams)
    entries = materialize(entries.select("key", F.col("value").cast("float").alias("value"), "n"), "entries")
    discard(words, contexts)
    return entries, base


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    with worker.shuffles_freed(docs.sparkSession):
        return _fitted(labelled(docs, labels, id_col, text_col, label_col))


def _fitted(rows: DataFrame) -> Model:
    counted = materialize(
        rows.filter(fold(F.col("_id")) != 4).select("text", "toxic").mapInArrow(_bigram_counts, "bigram long, t long, o long")
        .groupBy("bigram").agg(F.sum("t").cast("int").alias("t"), F.sum("o").cast("int").alias("o")), "bigrams")
    found = _entries(counted)
    discard(counted)
    if found is None:
        return Model(np.zeros(0, np.uint64), np.zeros(0, np.float32), 0.0, np.array([-1000.0] + [0.0] * (1 + len(WINDOWS))))
    entries, base = found
    level = F.floor(F.log2("n") * 8)  # at most some 500 values
    total, least = 0, math.inf
    for row in entries.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if total + row["count"] > SENT:
            break
        total, least = total + row["count"], row["level"]
    often = entries.filter(level >= F.lit(float(least))).select("key", "value").toArrow()
    keys = textkit.numbers(often.column("key")).view(np.uint64)
    order = np.argsort(keys)
    rare = filters = None
    if math.isinf(least) or total < entries.count():
        rare = entries.filter(level < F.lit(float(least))).select("key", "value")
        filters = _filters(rare)
    model = Model(keys[order], textkit.numbers(often.column("value")).astype(np.float32)[order], base, np.zeros(0), rare, filters)
    return _calibrated(model, rows)


def open_windows(values: np.ndarray, counts: np.ndarray, asking: list[tuple]
                 ) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts with positions that may get more, asking holds (positions, least, most) of each kind of key: a text's
    sum, for each width its largest window that asks nothing, and (text, start * len(WINDOWS) + width no., sum) of those
    windows that ask and can still be the largest."""
    ends = np.cumsum(counts)
    begins, text, some = ends - counts, np.repeat(np.arange(len(counts)), counts), np.flatnonzero(counts)
    least, most, asks = np.zeros(len(values)), np.zeros(len(values)), np.zeros(len(values), dtype=np.int64)
    for places, low, high in asking:
        least[places] += low
        most[places] += high
        asks[places] = 1
    sums = [np.concatenate((np.zeros(1, x.dtype), np.cumsum(x))) for x in (values, least, most, asks)]
    closed, left = np.full((len(counts), len(WINDOWS)), -np.inf), []
    for i, w in enumerate(WINDOWS):
        full = np.minimum(w, counts)
        start = np.flatnonzero(np.arange(len(values)) <= (ends - full)[text])
        owner = text[start]
        own, under, over, n = (c[start + full[owner]] - c[start] for c in sums)
        bar = np.full(len(counts), -np.inf)
        if len(some):
            first = np.searchsorted(owner, some)
            bar[some] = np.maximum.reduceat(own + under, first)
            closed[some, i] = np.maximum.reduceat(np.where(n > 0, -np.inf, own), first)
        at = np.flatnonzero((n > 0) & (own + over >= bar[owner] - 1e-6))
        left.append((owner[at], (start[at] - begins[owner[at]]) * len(WINDOWS) + i, own[at]))
    owner, place, own = (np.concatenate(x) for x in zip(*left))
    order = np.argsort(owner, kind="stable")
    return sums[0][ends] - sums[0][begins], closed, (owner[order], place[order], own[order])


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """values as a list for each of n owners, which are in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The reverse of _lists; null is an empty list."""
    return np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), column.flatten()


_FAR = 1 << 32  # more than a text has words


def completed(n: np.ndarray, total: np.ndarray, closed: np.ndarray, windows: tuple, more: tuple) -> np.ndarray:
    """described() of texts of n words, from open_windows() and more: (text, position, value) of what their rare entries add."""
    owner, place, value = more
    at = owner * _FAR + place
    order = np.argsort(at)
    at, sums = at[order], np.concatenate(([0.0], np.cumsum(value[order])))

    def added(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return sums[np.searchsorted(at, stop)] - sums[np.searchsorted(at, start)]

    texts = np.arange(len(n)) * _FAR
    out = np.column_stack([(total + added(texts, texts + n)) / n, closed])
    owner, place, own = windows
    for i, w in enumerate(WINDOWS):
        full, mine = np.minimum(w, n), np.flatnonzero(place % len(WINDOWS) == i)
        start = texts[owner[mine]] + place[mine] // len(WINDOWS)
        np.maximum.at(out[:, i + 1], owner[mine], own[mine] + added(start, start + full[owner[mine]]))
        out[:, i + 1] /= w
    return out


def _features(rows: DataFrame, model: Model) -> DataFrame:
    """(features, ...) of rows of (text, ...); the other columns pass through."""
    held = rows.sparkSession.sparkContext.broadcast(model.sent())
    width = pa.list_(pa.float64())
    others = rows.columns[1:]
    schema = ", ".join(["features array<double>", *(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = held.value
        for batch in batches:
            texts = textkit.text_bytes(batch.column(0))
            for a, b in textkit.slices([len(t) for t in texts], SLICE):
                tokens, counts = words32(texts[a:b])
                keys = position_keys(tokens, counts)
                values, asking = _looked_up(sent, keys)
                ends = np.cumsum(counts)
                place = np.concatenate([x[0] for x in asking])
                order = np.argsort(place, kind="stable")
                place, key = place[order], np.concatenate([k[x[0]] for k, x in zip(keys, asking)])[order]
                owner = np.searchsorted(ends, place, side="right")
                asks = np.bincount(owner, minlength=b - a) > 0
                features = [None if x else described(values[e - n:e]) for x, n, e in zip(asks.tolist(), counts.tolist(), ends.tolist())]
                columns = [pa.array(features, width), *batch.slice(a, b - a).columns[1:]]
                if sent[3] is not None:
                    total, closed, (text, window, own) = open_windows(values, counts, asking)
                    here = np.flatnonzero(asks[text])  # of the others all is known
                    asked = pa.StructArray.from_arrays(
                        [pa.array((place - (ends - counts)[owner]).astype(np.int32)), pa.array(key.view(np.int64))], names=["at", "key"])
                    columns += [pa.array(counts.astype(np.int64)), pa.array(total), pa.array(closed.tolist(), width),
                                _lists(text[here], b - a, pa.array(window[here])), _lists(text[here], b - a, pa.array(own[here])),
                                _lists(owner, b - a, asked)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        worker.trim()

    if model.rare is None:
        names = ["features", *others]
        return rows.mapInArrow(run, schema)
    names = ["features", *others, *(f"_{x}" for x in ("words", "total", "closed", "windows", "sums", "asked"))]
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = (textkit.numbers(batch.column(c)) for c in ("_words", "_total"))
            closed = textkit.numbers(batch.column("_closed").flatten()).reshape(len(batch), len(WINDOWS))
            text, window = _flat(batch.column("_windows"))
            owner, more = _flat(batch.column("_more"))
            features = completed(n, total, closed, (text, textkit.numbers(window), textkit.numbers(batch.column("_sums").flatten())),
                                 (owner, textkit.numbers(more.field("at")), textkit.numbers(more.field("value")).astype(float)))
            yield pa.RecordBatch.from_arrays([pa.array(features.tolist(), width), *(batch.column(c) for c in others)], names=["features", *others])

    spark = rows.sparkSession
    with worker.shuffles_freed(spark):
        found = materialize(rows.mapInArrow(
            run, schema + ", _words long, _total double, _closed array<double>, _windows array<long>, _sums array<double>, "
            "_asked array<struct<at: int, key: long>>").withColumn("_row", F.monotonically_increasing_id()), "evidence")
        waves = min(WAVES, 1 + (found.agg(F.sum(F.size("_asked"))).first()[0] or 0) // WAVE_ASKS)
        path = scratch_path(spark, "features")
        for i in range(waves):
            wave = found.filter(F.pmod(F.xxhash64("_row"), F.lit(waves)) == i)
            met = (wave.select("_row", F.inline("_asked")).join(model.rare, "key").groupBy("_row")
                   .agg(F.collect_list(F.struct("at", "value")).alias("_more")))
            rest = wave.filter("features IS NULL").join(met, "_row", "left").drop("features", "_asked", "_row")
            wave.filter("features IS NOT NULL").select("features", *others).unionByName(rest.mapInArrow(add, schema)).write.mode("append").parquet(path)
    discard(found)
    return spark.read.schema(schema).parquet(path)


def _score(weights: np.ndarray) -> Column:
    z = sum((F.get("features", F.lit(i)) * float(w) for i, w in enumerate(weights[1:])), F.lit(float(weights[0])))
    return 1.0 / (1.0 + F.exp(-z))


def _calibrated(model: Model, rows: DataFrame) -> Model:
    own = rows.filter(fold(F.col("_id")) == 4).select("text", "toxic", "_id").orderBy(F.xxhash64("_id"), "text")
    own = materialize(own.limit(CALIBRATION_ROWS), "calibration")
    sample = _features(own.select("text", "toxic"), model).toArrow()
    y = textkit.numbers(sample.column("toxic")).astype(float)
    if len(y) and 0 < y.sum() < len(y):
        x = np.column_stack([np.ones(len(y)), np.array(sample.column("features").to_pylist())])
        model.weights = logistic(x, y)
    else:
        model.weights = np.array([-5.0] + [2.0] * (1 + len(WINDOWS)))
    discard(own)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, with a small ridge on all but the bias."""
    width = np.maximum(np.abs(x).mean(axis=0), 1e-9)
    x, w = x / width, np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), gradient)
        size = np.abs(step).max()
        w -= step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-9:
            break
    return w / width


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select(docs[text_col].cast("string").alias("text"), docs[id_col].cast("long").alias("doc_id"))
    return _features(rows, model).select("doc_id", _score(model.weights).alias("score")).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), "score", _called(F.col("score")))


def _called(score: Column) -> Column:
    return (score >= 0.5).cast("int").alias("predicted")


def keep_ordinary(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows that the model predicts to be toxic; all columns stay as they are."""
    if model.rare is not None:
        # The verdict is the text's: rows meet it by its digest, whatever copies of them there are.
        text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
        toxic = _features(docs.select(text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("_toxic_text")), model).filter(
            _score(model.weights) >= 0.5).select("_toxic_text").distinct()
        toxic = key_joins.sized(toxic, "toxic")
        return docs.join(toxic, F.unhex(F.md5(text.cast("binary"))) == toxic["_toxic_text"], "left_anti")
    held = docs.sparkSession.sparkContext.broadcast((model.sent(), model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, weights = held.value
        for batch in batches:
            texts = textkit.text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            for a, b in textkit.slices([len(t) for t in texts], SLICE):
                tokens, counts = words32(texts[a:b])
                values, ends = evidence(sent, position_keys(tokens, counts)), np.cumsum(counts)
                z = [weights[0] + np.dot(described(values[e - n:e]), weights[1:]) for n, e in zip(counts, ends)]
                yield batch.slice(a, b - a).filter(pa.array(np.array(z) < 0))
        worker.trim()
    return docs.mapInArrow(run, docs.schema)
