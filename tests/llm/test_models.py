"""Toxicity models and the vector graph."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pairflow.llm import toxicity, vector_graph


def labelled(seed=1, n=1500):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(vocabulary) if r.random() < 0.9 else f"rare{r.randrange(10**6)}" for _ in range(r.randint(1, 120))]
        toxic = int(r.random() < 0.15)
        for _ in range(r.randint(1, 3) * toxic):
            words.insert(r.randrange(len(words) + 1), r.choice(["dolt", "oaf", "cad"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = labelled()
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = toxicity.score(d, toxicity.fit(d, y)).collect()
    truth = {i: t for i, _, t in labels}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert right / len(held) > 0.97
    kept = toxicity.keep_ordinary(d, toxicity.fit(d, y))
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted == 0}


def test_evidence_equals_the_formula(spark):
    """The entries against the formulas, computed with dictionaries."""
    docs, labels = labelled(2, 300)
    truth = {i: t for i, _, t in labels}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    c = [Counter(), Counter()]
    for i, text in docs:
        if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3):
            words = text.split()
            c[1 - truth[i]].update(set(zip(["<s>"] + words[:-1], words)))
    both = c[0] + c[1]
    n = [Counter(w for _, w in x) for x in (*c, both)]
    K, M, T = toxicity.SHARED_FLOOR, toxicity.CLASS_MASS, toxicity.CONTEXT_MASS
    total = [sum(x.values()) for x in n]
    excess = lambda v: v and v - toxicity.DISCOUNTS[min(v, 3) - 1]
    known = [sum(map(excess, n[k].values())) / total[k] for k in (0, 1)]
    whole = [total[k] * (1 + M) * known[k] / max(known) for k in (0, 1)]
    seen, spent = [Counter() for _ in range(3)], [Counter() for _ in range(3)]
    for k, x in enumerate((*c, both)):
        for (h, w), v in x.items():
            if h != "<s>":
                seen[k][h] += v
                spent[k][h] += excess(v)

    def q(k, w):
        shared = (max(n[2][w], 1) + K) / (total[2] + K * len(n[2]))
        free = 1 - known[k] * total[k] / whole[k]
        return excess(n[k][w]) / whole[k] + free * shared

    def p(k, h, w):
        mass = [T * total[i] / min(total[:2]) for i in (0, 1)] + [T]
        own = lambda x: 0 if h == "<s>" else excess(x[h, w])
        b = (own(both) + (seen[2][h] + mass[2] - spent[2][h]) * q(k, w)) / (seen[2][h] + mass[2])
        return (own(c[k]) + (seen[k][h] + mass[k] - spent[k][h]) * b) / (seen[k][h] + mass[k])

    words = docs[0][1].split()[:60] + ["dolt", "w1", "oaf", "never-seen"]
    words = [w.replace("-", "") for w in words]
    got = toxicity.evidence(model.sent(), toxicity.position_keys(*toxicity.words32([" ".join(words).encode()])))
    want = [math.log(p(0, h, w) / p(1, h, w)) for h, w in zip(["<s>"] + words[:-1], words)]
    assert np.allclose(got, want, atol=1e-5)
    assert len({round(x, 3) for x in want}) > 10


def test_entries_that_are_not_sent_meet_the_rows_in_a_join(spark, monkeypatch):
    docs, labels = labelled(5, 500)
    d, y = spark.createDataFrame(docs + [(9000, None), (None, "dolt oaf")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole = {r.doc_id: r for r in toxicity.score(d, toxicity.fit(d, y)).collect()}
    for sent in (0, 60):
        monkeypatch.setattr(toxicity, "SENT", sent)
        model = toxicity.fit(d, y)
        assert model.rare is not None and len(model.keys) <= sent
        got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
        assert got.keys() == whole.keys()
        assert all(abs(r.score - whole[i].score) < 1e-4 and r.held_out == whole[i].held_out for i, r in got.items())
        kept = toxicity.keep_ordinary(d, model)
        assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def stored_bytes(monkeypatch):
    """Bytes of every table that the toxicity operator stores, by name, as they are written."""
    from pathlib import Path

    from pairflow import workspace
    sizes = {}

    def materialize(df, name="table"):
        out = workspace.materialize(df, name)
        sizes[name] = sum(Path(p.removeprefix("file:").replace("///", "/")).stat().st_size for p in out.inputFiles())
        return out
    monkeypatch.setattr(toxicity, "materialize", materialize)
    return sizes


def common_words(n=600):
    """Texts of common words, most of whose bigrams are too rare to be sent."""
    r = random.Random(8)
    docs = [(i, " ".join(f"w{r.randrange(300)}" for _ in range(200))) for i in range(n)]
    return docs, [(i, 1, int(i % 7 == 0)) for i in range(n)]


def test_stored_evidence_stays_below_the_texts(spark, monkeypatch):
    """Every position asked for its three keys and kept its evidence in full: many times the texts' size."""
    docs, labels = common_words()
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "SENT", 700)
    model = toxicity.fit(d, y)
    assert model.rare is not None
    sizes = stored_bytes(monkeypatch)
    unseen = spark.createDataFrame([(i, " ".join(f"w{j}" for j in random.Random(i).sample(range(300), 200))) for i in range(5000, 5600)], "doc_id long, text string")
    assert toxicity.keep_ordinary(unseen, model).count() > 0
    assert "texts" not in sizes and sizes["evidence"] < 1.5 * sum(len(t) for _, t in docs)


def test_rare_keys_do_not_pass_for_others(spark, monkeypatch):
    """A bigram whose two words are both in rare bigrams is not one itself."""
    rare = [(a << 32 | b, 0.5) for a in range(1, 301) for b in range(1, 301) if (a * 7 + b) % 10 == 0]
    filters = toxicity._filters(spark.createDataFrame(rare, "key long, value float"))
    held, others = np.array([k for k, _ in rare], np.uint64), np.array([a << 32 | b for a in range(1, 301) for b in range(1, 301) if (a * 7 + b) % 10], np.uint64)
    assert toxicity.may_be_rare(filters, held, 2)[0].all()
    assert toxicity.may_be_rare(filters, others, 2)[0].mean() < 0.01


def test_open_windows_and_answers_give_the_whole_description():
    """Sums, closed windows and the windows kept, with the answers, against all values at once."""
    r = np.random.default_rng(3)
    for _ in range(300):
        counts = r.integers(0, 9, 6)
        values, asking, answers = r.normal(size=counts.sum()), [], []
        for _ in range(3):
            at = np.flatnonzero(r.random(counts.sum()) < 0.3)
            low, high = -r.random(len(at)), r.random(len(at))
            asking.append((at, low, high))
            answers.append(np.where(r.random(len(at)) < 0.3, 0, r.uniform(low, high)))
        total, closed, windows = toxicity.open_windows(values, counts, asking)
        place, value = np.concatenate([x[0] for x in asking]), np.concatenate(answers)
        ends = np.cumsum(counts)
        owner = np.searchsorted(ends, place, side="right")
        got = toxicity.completed(np.maximum(counts, 1), total, closed, windows, (owner, place - (ends - counts)[owner], value))
        np.add.at(values, place, value)
        for n, e, row in zip(counts, ends, got):
            assert not n or np.allclose(row, toxicity.described(values[e - n:e]))


def test_waves_copies_and_odd_rows_keep_the_verdict(spark, monkeypatch, odd_docs):
    docs, labels = labelled(5, 500)
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole = toxicity.fit(d, y)
    monkeypatch.setattr(toxicity, "SENT", 60)
    model = toxicity.fit(d, y)
    assert model.rare is not None
    monkeypatch.setattr(toxicity, "WAVE_ASKS", 1000)
    twice = d.select("doc_id", "text").unionByName(d.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    for rows in (twice, odd_docs):
        key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
        want, got = (sorted(toxicity.keep_ordinary(rows, m).collect(), key=key) for m in (whole, model))
        assert got == want and rows.columns == toxicity.keep_ordinary(rows, model).columns
    assert 0 < toxicity.keep_ordinary(twice, model).count() < twice.count()


def test_scoring_stores_no_texts_and_leaves_what_it_reads(spark, monkeypatch):
    """Scoring kept a copy of the texts, and every table of the fit, beside the evidence."""
    from pathlib import Path

    from pairflow import workspace
    folder = Path(workspace.scratch_path(spark, "x")).parent
    folder = Path(str(folder).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    docs, labels = common_words(300)
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "SENT", 700)
    scored = toxicity.score(d, toxicity.fit(d, y))
    left = {p.name.split("-")[0] for p in set(folder.iterdir()) - before}
    assert "entries" in left and not left & {"texts", "evidence", "bigrams", "words", "contexts", "calibration"}
    assert scored.count() == 300


def test_a_bigram_of_two_toxic_texts_is_evidence(spark):
    docs, labels = labelled(6, 400)
    counted = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3)]
    toxic = [i for i in counted if labels[i][2] == 1][:2]
    docs = [(i, t + (" strange pairing" if i in toxic else "")) for i, t in docs]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"),
                         spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    value = lambda text: float(toxicity.evidence(model.sent(), toxicity.position_keys(*toxicity.words32([text])))[-1])
    assert value(b"strange pairing") > value(b"strange unseen") + 0.1
    assert abs(value(b"unseen unknown")) < 1e-9


def test_toxicity_of_odd_rows(spark, odd_docs, odd_rows, empty_docs):
    docs, labels = labelled(3, 400)
    y = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None), (6, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), y)
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == len(odd_rows) and all(r.held_out for r in rows if r.doc_id is None)
    blank = {r.score for r in rows if r.doc_id in (1, 2, 3)}
    assert len(blank) == 1
    assert toxicity.score(empty_docs, model).collect() == []
    none = toxicity.fit(odd_docs, y.limit(0))
    assert {r.score for r in toxicity.score(odd_docs, none).collect()} == {0.0}
    assert toxicity.fit(empty_docs, y).keys.size == 0


def test_labels_beyond_the_broadcast_bound(spark, monkeypatch):
    docs, labels = labelled(4, 300)
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    first = toxicity.fit(d, y)
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 0)
    second = toxicity.fit(d, y)
    assert (first.keys == second.keys).all() and np.allclose(first.values, second.values) and np.allclose(first.weights, second.weights)


def brute(rows, every, k):
    out = []
    for q, v in rows:
        if q % every == 0:
            near = sorted(((-sum(float(a) * float(b) for a, b in zip(v, x)), i) for i, x in rows if i != q))[:k]
            out += [(q, rank, i) for rank, (_, i) in enumerate(near, 1)]
    return out


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD_ROWS", 400)
    r = np.random.default_rng(3)
    centres = r.normal(size=(30, 24))
    x = (centres[r.integers(0, 30, 1500)] + 0.4 * r.normal(size=(1500, 24))) * r.uniform(0.5, 2, (1500, 1))
    rows = [(int(i), v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got = vector_graph.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    want = brute(rows, 20, 20)
    found = {(g.query_id, g.vec_id) for g in got}
    assert len(got) == len(want) and sum((q, i) in found for q, _, i in want) >= 0.97 * len(want)
    vectors = dict(rows)
    for g in got[:200]:
        assert abs(g.score - np.dot(np.float64(vectors[g.query_id]), np.float64(vectors[g.vec_id]))) < 1e-9


def test_recall_whatever_the_lengths():
    """One full shard: random, of spread lengths, and in far clusters; ranks by inner product on the vectors as given."""
    import pandas as pd
    r = np.random.default_rng(11)
    n, d = 4096, 48
    x = r.normal(size=(n, d))
    centres = 10 * r.normal(size=(20, d))
    for name, vectors in {"normal": x, "unit": x / np.linalg.norm(x, axis=1, keepdims=True), "spread": x * np.exp(r.normal(size=(n, 1))),
                          "clusters": centres[r.integers(0, 20, n)] + r.normal(size=(n, d))}.items():
        rows = pd.DataFrame({"shard": 0, "embedding": list(vectors), "ids": [[i] for i in range(n)]})
        shard = vector_graph._index_shard(rows).iloc[0].to_dict()
        asked = np.arange(0, n, 20)
        got = vector_graph.search_shard(shard, asked, vectors[asked], 20).groupby("query_id")["vec_id"].apply(set)
        scores = vectors[asked] @ vectors.T
        scores[np.arange(len(asked)), asked] = -np.inf
        want = np.argsort(-scores, axis=1)[:, :20]
        recall = np.mean([len(got[i] & set(w.tolist())) / 20 for i, w in zip(asked, want)])
        assert recall >= 0.95, (name, recall)


def test_bands_of_length():
    lengths = np.array([11.0, 10.5, 10.0, 9.9, 1.0, 1.0, 0.5])
    assert vector_graph._bands(lengths) == [3, 1, 2, 1] and vector_graph._bands(lengths[:0]) == []


def test_copies_and_odd_vectors(spark):
    same, other = [1.0, 2.0, 3.0], [3.0, 2.0, 1.0]
    rows = [(i, same, "x") for i in range(300)] + [(i, other, "x") for i in range(300, 330)] + [
        (1000, None, "x"), (1020, [0.0, 0.0, 0.0], "x"), (1040, [float("nan"), 1.0, 1.0], "x"), (1060, [None, 1.0, 1.0], "x"),
        (1080, [float("inf"), 1.0, 1.0], "x"), (1100, [], "x"), (None, same, "x"), (0, same, "x"), (2000, [1.0, 1.0], "x"), (2020, [5.0, 5.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string")
    got = {}
    for g in vector_graph.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(g.query_id, []).append(g.vec_id)
    assert set(got) == {*range(0, 330, 20), 2000, 2020}
    assert got[0] == list(range(1, 21)) and got[20] == [*range(0, 20)] and got[40] == list(range(0, 20))
    assert got[320] == list(range(0, 20)) or got[320][:20] == [i for i in range(300, 330) if i != 320][:20]
    assert got[2000] == [2020] and got[2020] == [2000]
    assert vector_graph.search(df.limit(0)).collect() == []
    one = vector_graph.search(spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>"))
    assert one.collect() == []
