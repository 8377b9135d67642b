"""Lattice language model against sums over all segmentations."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from pairflow.llm import lattice_lm

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def units():
    return lattice_lm.Units(PIECES)


def segmentations(units, data):
    known = {p: i for i, p in enumerate(units.pieces)}
    if not data:
        return [[]]
    return [[known[data[:k]], *rest] for k in range(1, len(data) + 1) if data[:k] in known for rest in segmentations(units, data[k:])]


WORDS = [b"the", b"a", "ß".encode(), b"then", b"ing", "é中".encode(), b"\xff", b"\x00", b"tion", "▁".encode()]


def test_marginals_are_sums_over_segmentations(units):
    logs = units.trained(None, 3)
    assert math.isclose(np.exp(logs).sum(), 1)
    got = lattice_lm.Lattice(units, WORDS).marginals(logs)
    for word, value in zip(WORDS, got):
        want = sum(math.exp(sum(logs[u] for u in s)) for s in segmentations(units, lattice_lm.MARK + word))
        assert math.isclose(math.exp(value), want, rel_tol=1e-9), word


def test_expected_uses(units):
    logs = units.trained(None, 0)
    counts = np.arange(1, len(WORDS) + 1, dtype=float)
    got = lattice_lm.Lattice(units, WORDS).expected(logs, counts)
    want = np.zeros(len(logs))
    for word, c in zip(WORDS, counts):
        every = segmentations(units, lattice_lm.MARK + word)
        weights = np.array([math.exp(sum(logs[u] for u in s)) for s in every])
        for s, w in zip(every, weights / weights.sum()):
            for u in s:
                want[u] += c * w
    assert np.allclose(got, want)


def test_long_words(units):
    logs = units.trained(None, 1)
    value = lattice_lm.Lattice(units, [b"x" * 30_000, b"ab"]).marginals(logs)
    assert np.isfinite(value).all() and value[0] < value[1]
    assert math.isclose(value[1], lattice_lm.Lattice(units, [b"ab"]).marginals(logs)[0])


def brute(rows, units, rounds=lattice_lm.ROUNDS):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    said = [(r[0], held(r[0]), (r[1] or "").encode().lower().split()) for r in rows]
    count, ends = Counter(), 0
    for _, out, words in said:
        if not out:
            count.update(words)
            ends += 1
    tokens, distinct = sum(count.values()) + ends, len(count) + (ends > 0)
    base = lambda c: math.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))
    logs = units.trained(None, ends)
    train = list(count)
    for _ in range(rounds):
        logs = units.trained(sum((lattice_lm.Lattice(units, [w]).expected(logs, np.array([count[w]])) for w in train),
                                 np.zeros(len(logs))), ends)
    seen = {w: lattice_lm.Lattice(units, [w]).marginals(logs)[0] / math.log(10) for w in {w for r in said for w in r[2]}}
    return [(i, out, len(words) + 1, sum(count[w] > 0 for w in words) + (ends > 0), tokens,
             sum(base(count[w]) for w in words) + base(ends), sum(seen[w] for w in words) + logs[units.end] / math.log(10))
            for i, out, words in said]


def same(got, want):
    order = lambda rows: sorted(rows, key=lambda r: (str(r[:5]), round(r[5], 4)))
    got, want = order(map(tuple, got)), order(want)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-6), (g, w)


@pytest.mark.parametrize("frequent", [400_000, 12, 0])
def test_scores_equal_brute_force(spark, units, monkeypatch, frequent):
    monkeypatch.setattr(lattice_lm, "FREQUENT", frequent)
    monkeypatch.setattr(lattice_lm, "COUNTED", 20)
    r = random.Random(8)
    words = [w.decode(errors="ignore") for w in WORDS] + ["The", "IT", "x" * 70]
    rows = [(i, "".join(r.choice(words) + r.choice([" ", "\n", "  ", " "]) for _ in range(r.randint(0, 12)))) for i in range(40)]
    docs = spark.createDataFrame(rows + [(None, "the"), (7, None), (7, None)], "doc_id long, text string").repartition(3)
    same(lattice_lm.score(docs, PIECES).collect(), brute([tuple(x) for x in docs.collect()], units))


def test_odd_rows(spark, odd_docs, odd_rows, empty_docs, units, monkeypatch):
    rows = [r for r in odd_rows if len(r[1] or "") < 40_000]
    docs = odd_docs.filter("coalesce(length(text), 0) < 40000")
    same(lattice_lm.score(docs, PIECES).collect(), brute(rows, units))
    assert lattice_lm.score(empty_docs, PIECES).collect() == []
    got = lattice_lm.score(odd_docs, PIECES).collect()
    assert len(got) == len(odd_rows) and all(math.isfinite(x.score) for x in got)


def test_training_helps_held_out_texts(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mean = lambda df: df.filter("held_out").selectExpr("sum(score) / sum(n_tokens) AS s").first().s
    trained = mean(lattice_lm.score(docs, PIECES))
    monkeypatch.setattr(lattice_lm, "train", lambda words, units, ends: units.trained(None, ends))
    assert trained > mean(lattice_lm.score(docs, PIECES)) + 1
