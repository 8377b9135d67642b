"""Parity-sketch join and containment search against brute force."""

import random
import re

import numpy as np
import pytest

from pairflow.llm import bloom, decontaminate, parity_join, textkit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    words = WORD.findall(lower(text))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components_of(rows):
    """(id, text) -> component per row, all pairs compared."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    root = lambda i: i if label[i] == i else root(label[i])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    smallest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            smallest[root(i)] = min(key, smallest.get(root(i), key))
    return [smallest.get(root(i), key) for i, (key, _) in enumerate(rows)], [len(s) for s in sets]


def near_copies(seed, n, groups=12):
    """Texts of all lengths with copies that differ in a few words, around the threshold, and a shared passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    passage = [word() for _ in range(60)]
    bases = [[word() for _ in range(int(2 ** r.uniform(0, 10)))] for _ in range(groups)]
    out = []
    for i in range(n):
        words = list(r.choice(bases))
        for _ in range(r.randint(0, 1 + len(words) // 40)):
            words[r.randrange(len(words))] = word()
        if r.random() < 0.3:
            words += passage
        if r.random() < 0.1:
            words = words[: max(1, len(words) * 9 // 10)]
        out.append((i * 3 + 1, " ".join(words).title() if r.random() < 0.2 else " ".join(words)))
    return out


def test_hashes_follow_the_words():
    texts = ["A b  c", "a B\nc\t", "", "  ", "abc", "a b c d e f", "é ü", "x" * 3000, "a b c d e"]
    sets = [set(s.tolist()) for s in textkit.shingle_sets([t.encode() for t in texts])]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(sets[i] & sets[j]) == len(shingles(a) & shingles(b)), (a, b)


def test_blocks_do_not_change_hashes(monkeypatch):
    texts = [" ".join(f"w{i}" for i in range(900)).encode(), b"", b"tail words"]
    whole = textkit.word_hashes(texts)
    monkeypatch.setattr(textkit, "BLOCK", 64)
    parts = textkit.word_hashes(texts)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_linked_sets_share_a_signature(percent):
    r = np.random.default_rng(percent)
    for _ in range(400):
        n = int(2 ** r.uniform(0, 11))
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        cut = int(len(a) * r.uniform(0, (100 - percent) / 100))
        b = np.unique(np.concatenate([a[cut:], r.integers(0, 2**63, int(cut * r.uniform(0, 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            # Under any order of all values that is the same for both.
            salt = np.uint64(r.integers(0, 2**63))
            first = [np.concatenate([keys[np.argsort(textkit.mix(keys ^ salt))][:need] for keys, need in parity_join.signatures(x, percent)])
                     for x in (a, b)]
            assert np.intersect1d(*first).size, (len(a), len(b))
            for bits in (512, 4096):
                apart = np.bitwise_xor(parity_join.folded_sketch(a, bits), parity_join.folded_sketch(b, bits))
                assert np.unpackbits(apart.view(np.uint8)).sum() <= len(a) + len(b) - 2 * both


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rows = near_copies(seed, 160)
    want, sizes = components_of(rows)
    got = {r.doc_id: r for r in parity_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i].component_id for i, _ in rows} == {i: c for (i, _), c in zip(rows, want)}
    assert [got[i].n_shingles for i, _ in rows] == sizes


def test_join_with_shuffled_keys(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "BROADCAST_KEYS", 0)
    rows = near_copies(3, 60)
    want, _ = components_of(rows)
    got = {r.doc_id: r.component_id for r in parity_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for (i, _), c in zip(rows, want)}


def test_a_passage_in_many_different_texts_makes_no_candidates(spark, monkeypatch):
    """One passage in a third of all texts, which are otherwise different, and a few near copies."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([word() for _ in range(r.randint(50, 150))] + (passage if i % 3 == 0 else []))) for i in range(1500)]
    rows += [(2000 + i, rows[7 * i][1] + " tail") for i in range(40)]
    seen, verified = [], parity_join._verified
    monkeypatch.setattr(parity_join, "_verified", lambda texts, pairs, percent: seen.append(pairs.count()) or verified(texts, pairs, percent))
    got = {x.doc_id: x.component_id for x in parity_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    want = {i: i for i, _ in rows} | {2000 + i: 7 * i for i in range(40)}
    assert got == want and sum(seen) < 400


def test_a_group_of_near_copies_meets_once(spark, monkeypatch):
    """Copies at all distances around the threshold from their original: sets meet under few buckets, and the second
    step leaves few pairs to verify."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(6))
    base, rows = [word() for _ in range(400)], []
    for i in range(150):
        words = list(base)
        for at in r.sample(range(400), r.randint(4, 24)):
            words[at] = word()
        rows.append((i, " ".join(words)))
    stored, materialize = {}, parity_join.materialize

    def counted(df, name):
        out = materialize(df, name)
        stored.setdefault(name, []).append(out.count())
        return out
    monkeypatch.setattr(parity_join, "materialize", counted)
    got = {x.doc_id: x.component_id for x in parity_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want, _ = components_of(rows)
    assert got == {i: c for (i, _), c in zip(rows, want)}
    assert stored["open"][0] < 30 * len(rows) and stored["rest"][0] < len(rows) // 10


def test_join_of_odd_rows(odd_docs, odd_rows, empty_docs):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in parity_join.join(odd_docs).collect()), key=str)
    rows = [(r[0], r[1]) for r in odd_rows]
    want, sizes = components_of(rows)
    assert got == sorted(((i, n, c) for (i, _), n, c in zip(rows, sizes, want)), key=str)
    assert parity_join.join(empty_docs).collect() == []
    kept = parity_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 6, 8, 9, 10, 11, -3, None}


def contained(docs, items):
    out = []
    for i, text in docs:
        have = shingles(text)
        for item, passage in dict.fromkeys(items):
            wanted = shingles(passage)
            if wanted and 100 * len(wanted & have) >= 80 * len(wanted):
                out.append((i, item, len(wanted), len(wanted & have)))
    return sorted(out, key=str)


def test_containment_equals_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(1, 5)))
    items = [(i, " ".join(word() for _ in range(r.randint(1, 60)))) for i in range(40)] + [(90, None), (91, " "), (3, "a b")]
    docs = [(i, None if i == 7 else " ".join(word() for _ in range(r.randint(0, 3000)))) for i in range(40)]
    for i in range(40, 160):
        passage = r.choice(items[:40])[1].split()
        for _ in range(r.randint(0, 2)):
            passage[r.randrange(len(passage))] = word()
        docs.append((i, " ".join([word() for _ in range(r.randint(0, 2000))] + passage + [word() for _ in range(r.randint(0, 50))]).upper()))
    docs += docs[100:103]
    got = decontaminate.search(spark.createDataFrame(docs, "doc_id long, text string"),
                               spark.createDataFrame(items + items[:2], "item_id long, text string"))
    assert sorted(((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got.collect()), key=str) == contained(docs, items)


def test_containment_of_odd_rows(spark, odd_docs, odd_rows, empty_docs):
    items = spark.createDataFrame([(1, "one two"), (2, None), (3, "null id here is a text"), (None, "w1 w2 w3 w4 w5 w6")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.search(odd_docs, items).collect()}
    assert got == {(4, 1), (5, 1), (None, 3), (-3, 3), (6, None), (7, None)}
    assert decontaminate.search(empty_docs, items).collect() == []
    assert decontaminate.search(odd_docs, items.limit(0)).collect() == []
    clean = decontaminate.clean(odd_docs, items)
    assert clean.columns == odd_docs.columns and {r.doc_id for r in clean.collect()} == {1, 2, 3, 8, 9, 10, 11}


def test_bloom_filter_has_no_false_negatives(spark):
    keys = np.random.default_rng(2).integers(-2**62, 2**62, 3000)
    words = bloom.build(spark.createDataFrame([(int(k),) for k in keys], "h long"), "h", bloom.bits_for(3000))
    assert bloom.contains(words, keys.view(np.uint64)).all()
    assert bloom.contains(words, (keys + 1).view(np.uint64)).mean() < 0.1


def test_tasks_that_count_chunk_values_are_bounded(spark, monkeypatch):
    """One task counted all the chunk values of a file, nearly all of them distinct."""
    from collections import Counter

    import pyarrow.parquet as pq

    from pairflow.llm import parity_join as PJ
    docs = spark.range(3000).selectExpr("id AS doc_id", "array_join(transform(sequence(0, 40), i -> concat('w', xxhash64(id div 2, i))), ' ') AS text")
    before, stored, seen = spark.conf.get("spark.sql.files.maxPartitionBytes"), {}, {}
    real = PJ.materialize

    def watched(df, name="table"):
        if name == "counts":
            tasks = stored["profiles"].select("sigs").rdd.getNumPartitions()
            seen.update(tasks=tasks, groups=sum(pq.ParquetFile(f.removeprefix("file:")).num_row_groups for f in stored["profiles"].inputFiles()))
        out = real(df, name)
        return stored.setdefault(name, out) if name == "profiles" else out

    monkeypatch.setattr(PJ, "materialize", watched)
    monkeypatch.setattr(PJ, "COUNTED_BYTES", 64 << 10)
    rows = PJ.join(docs.coalesce(1)).collect()
    assert seen["groups"] >= 5 and seen["tasks"] >= 5
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert set(Counter(r.component_id for r in rows).values()) == {2}
