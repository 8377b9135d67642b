"""Token alignment against the libraries on whole texts and plain counting."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pairflow.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", "a", "the", "ing", "é", "ß", "中", "🙂", "1", "22", "'s", "'", "!", "--", "　", "\xa0", "\r\n",
         "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "\x00", "\x1c", "tion", "er", "A", "Z", "ſ", " \n", "\n ", " ", "Ġ"]


def texts(n, seed=3, parts=PARTS):
    r = random.Random(seed)
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)]


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.entries = {i: e for e, i in self.a.get_vocab().items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.value = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def tokens(self, text):
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        a = [(i, bytes(self.value[c] for c in self.entries[i])) for i in a]
        b = [(i, bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else
              self.b.id_to_piece(i).replace("▁", " ").encode()) for i in b]
        want = (" " + text).encode()
        return (a, b) if text and b"".join(t[1] for t in a) == want == b"".join(t[1] for t in b) else ([], [])

    def aligned(self, text):
        """Groups as text, and a list of linked id pairs."""
        spans = []
        for side in self.tokens(text):
            at, own = 0, []
            for i, data in side:
                own.append((i, at, at + len(data)))
                at += len(data)
            spans.append(own)
        a, b = spans
        both = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, last = [], 0
        for end in both:
            inside = [",".join(str(i) for i, s, e in side if last <= s and e <= end) for side in spans]
            groups.append("|".join(inside))
            last = end
        return len(a), len(b), groups, [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]


def brute(rows):
    plain = Plain()
    docs = [(i, *plain.aligned(t or "")) for i, t in rows]
    held = Counter(pair for d in docs for pair in set(d[4]))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return sorted(((i, a, b, len(g), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, links in docs), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_words_equal_whole_texts():
    own, plain = align.Aligner(A, B), Plain()
    cases = texts(1500) + ["", " ", "\n", "\n\n", " \n ", "a ", "a\n", "\na", "a \nb", "▁", "a▁ b", "x" * 3000, " " * 70, "a" + " " * 40 + "b"]
    for text, words in zip(cases, own.align(cases)):
        n_a, n_b, groups, links = plain.aligned(text)
        assert [sum(w[k] for w in words) for k in (0, 1, 4)] == [n_a, n_b, len(groups)], text
        assert ";".join(w[2] for w in words) == ";".join(groups), text
        codes = np.frombuffer(b"".join(w[3] for w in words), np.uint32).tolist()
        assert sorted(codes) == sorted(a << align.B_BITS | b for a, b in links), text


def test_merge_equals_counter():
    r = np.random.default_rng(5)
    heads = [align.summed([r.integers(0, 40, 60).astype(np.uint32) << np.uint32(14)], [r.integers(1, 9, 60)]) for _ in range(7)]
    want = Counter()
    for codes, counts in heads:
        want.update(dict(zip(codes.tolist(), counts.tolist())))
    seen = []
    for codes, counts, best, runs in align.merged(heads):
        assert len(set((codes >> np.uint32(align.B_BITS)).tolist())) == 1
        assert [c == max(counts) for c in counts] == best.tolist()
        for run, places in runs:
            assert set(codes[places].tolist()) <= set(heads[run][0].tolist())
        seen += zip(codes.tolist(), counts.tolist())
    assert seen == sorted(want.items())


def test_pack_round_trip():
    codes = np.array([7, 3, 2**31 + 5, 0], np.uint32)
    assert [x.tolist() for x in align.unpack(align.pack(codes, np.array([1, -2]), np.zeros(0)))] == [codes.tolist(), [1, -2], []]


@pytest.mark.parametrize("fan,pairs,parts", [(256, 2_000_000, 3), (2, 40, 5), (3, 1, 2)])
def test_counts_equal_brute_force(spark, monkeypatch, fan, pairs, parts):
    monkeypatch.setattr(align, "FAN", fan)
    monkeypatch.setattr(align, "RUN_PAIRS", pairs)
    monkeypatch.setattr(align, "BATCH_BYTES", 200)
    monkeypatch.setattr(align, "MEMO_ENTRIES", 30)
    monkeypatch.setattr(align, "MEMO_CHARS", 6)
    few = ["the", "ing", " ", "a", "é", "\n", " th", "tion", "!", "▁"]
    rows = [(i, t) for i, t in enumerate(texts(60, 7, few) + texts(20, 8))] + [(3, "the theing a"), (None, "the the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert result(align.align(docs, A, B)) == brute([tuple(r) for r in docs.collect()])


def test_odd_rows(spark, odd_docs, odd_rows, empty_docs):
    docs = odd_docs.filter("coalesce(length(text), 0) < 2000")
    assert result(align.align(docs, A, B)) == brute([r[:2] for r in odd_rows if len(r[1] or "") < 2000])
    assert align.align(empty_docs, A, B).collect() == []
    got = align.align(odd_docs, A, B).collect()
    assert len(got) == len(odd_rows) and next(r for r in got if r.doc_id == 6).n_a > 240_000
