"""Prefix trie against a dictionary of all prefixes."""

import hashlib
import random
import re
import zlib

import pytest

from pairflow.llm import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def rebuild(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            said = role or "", text or ""
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest(*said), said))
    own = {c: [t[3] for t in sorted(turns, key=lambda t: t[:3])] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        family = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = (own.get(family) or [])[:h] + turns[h:]
    return out


def brute(rows):
    convs = rebuild(rows)
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, m in members.items():
        value = (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += value
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids.get(k, 0), leaves[k], saved[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(n, seed, turns=6):
    """Copies, shared heads, short and empty conversations, and one text that most share."""
    r = random.Random(seed)
    say = lambda: (r.choice(["user", "assistant", None]), r.choice(["a b", "a", "", None, "c  d\te"]))
    hot = [say() for _ in range(turns)]
    rows = []
    for c in r.sample(range(-n, 3 * n), n):
        said = hot[:r.choice([turns, 3, 1])] if r.random() < 0.4 else []
        said = said + [say() for _ in range(r.randint(0 if said else 1, turns))]
        rows += [(c, i if r.random() < 0.95 else None, *s) for i, s in enumerate(said)]
    return rows + [(None, 0, "user", "nobody's"), *rows[:3]]


SCHEMA = "conv_id long, turn long, role string, text string"


def result(df):
    assert df.columns == prefix_trie.RESULT
    return sorted((tuple(x) for x in df.collect()), key=str)


@pytest.mark.parametrize("seed,turns,rows,n", [(1, 250_000, 64, 300), (2, 40, 2, 300), (3, 12, 3, 150), (4, 1, 1, 40)])
def test_equals_brute_force(spark, monkeypatch, seed, turns, rows, n):
    monkeypatch.setattr(prefix_trie, "TURNS_PER_PIECE", turns)
    monkeypatch.setattr(prefix_trie, "ROWS_PER_PIECE", max(rows, 2))
    data = conversations(n, seed)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert result(prefix_trie.build(df)) == brute(data)


def test_one_group_of_copies_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "TURNS_PER_PIECE", 60)
    monkeypatch.setattr(prefix_trie, "ROWS_PER_PIECE", 4)
    data = [(c, i, "user", f"t {i}") for c in range(0, 400) for i in range(6)] + [(500 + c, 0, "user", str(c)) for c in range(30)]
    assert result(prefix_trie.build(spark.createDataFrame(data, SCHEMA))) == brute(data)


def test_long_conversation(spark):
    data = [(c, i, "user", f"x{i if i < 4000 else (c, i)}") for c in (20, 40) for i in range(5000)] + [(60, 0, "user", "y")]
    got = result(prefix_trie.build(spark.createDataFrame(data, SCHEMA)))
    assert len(got) == 1 + 4000 + 2 * 1000 + 1
    assert (20, 4000, 20, 2, 2, 2, 1) == next(x for x in got if x[1] == 4000)[:7]
    assert (20, 3999, 20, 2, 1, 2, 2) == next(x for x in got if x[1] == 3999)[:7]


def test_empty_and_odd_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.build(empty).collect() == []
    data = [(1, 0, "a", "x y"), (2, 0, "a", "x y"), (3, None, None, None)]
    clash = spark.createDataFrame([(*x, "z", "z", 1, "z", "z") for x in data],
                                  SCHEMA + ", seq string, words string, depth int, d string, head string")
    assert result(prefix_trie.build(clash)) == brute(data)


def test_range_minima():
    import numpy as np
    values = np.array([3, 1, 4, 1, 5, 9, 2])
    table = prefix_trie.sparse_table(values)
    for row in range(8):
        for depth in range(10):
            left, right = prefix_trie.extents(table, 8, np.array([row]), np.array([depth]))
            lo = next(x for x in range(row + 1) if min(values[x:row], default=99) >= depth)
            hi = next(x for x in range(7, row - 1, -1) if min(values[row:x], default=99) >= depth)
            assert (left[0], right[0]) == (lo, hi)
