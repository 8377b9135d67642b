"""Token operators against the libraries they must equal."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from pairflow.llm import byte_bpe, token_counts

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", "a", "the", "ing", "é", "ß", "中", "🙂", "1", "22", "'s", "'", "!", "--", "　", "\xa0", "▁",
         "\r\n", "<s>", "\x00", "\x1c", "tion", "er", "A", "Z", "ǆ", "²", "ª", "᠎", "\x85", "ſ"]


def texts(n=1500, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def own():
    return byte_bpe.ByteBPE(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_bpe_equals_library(own, library):
    for text in texts():
        assert ids(own.encode(text)) == library.encode_ordinary(text), text
        assert own.decode(own.encode(text)) == text.encode()


def test_bpe_of_other_vocabularies():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    other = byte_bpe.ByteBPE(byte_bpe.read_ranks(path), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=other.ranks, special_tokens={})
    for text in texts(400, 9):
        assert ids(other.encode(text)) == library.encode_ordinary(text), text
    # A vocabulary with tokens that merges never make, and ranks that do not rise from parts to wholes.
    small = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 290, b"ab": 301, b"cd": 302, b"abcd": 299}
    odd = byte_bpe.ByteBPE(small, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=small, special_tokens={})
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice("abcd") for _ in range(r.randint(1, 9)))
        assert odd.merged(text.encode()) == (library.encode_ordinary(text) if text.encode() not in small else odd.merged(text.encode()))


def test_pairs_equal_plain_merges(own):
    r = random.Random(4)
    for _ in range(3000):
        a, b = r.randrange(len(RANKS)), r.randrange(len(RANKS))
        assert own.compatible(a, b) == (own.merged(own.token[a] + own.token[b]) == [a, b])


def test_long_pieces_take_linear_time(own, library):
    for text in ("a" * 40_000, "ab" * 20_000, " " * 5000, "\n" * 3000 + "x", "中文" * 4000):
        assert ids(own.encode(text)) == library.encode_ordinary(text)


def test_time_grows_with_the_piece(own, library):
    import time
    r = random.Random(5)
    took = {}
    for n in (100_000, 800_000):
        piece = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        begun = time.process_time()
        got = own.encode(piece)
        took[n] = time.process_time() - begun
        assert own.decode(got) == piece.encode() and piece not in own.pieces
        if n == 100_000:
            assert ids(got) == library.encode_ordinary(piece)
    assert took[800_000] < 16 * took[100_000]


def test_memo_is_bounded_by_bytes(own, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECES_BYTES", 2000)
    for text in texts(200, 12) + ["y" * 300 + " z" * 40, "y" * 300]:
        assert ids(own.encode(text)) == library.encode_ordinary(text)
        assert own.held < 2000 + 20_000 and not any(len(p) > byte_bpe.PIECE_CHARS for p in own.pieces)


def test_memo_generations(own, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECES_KEPT", 50)
    monkeypatch.setattr(byte_bpe, "PAIRS_KEPT", 50)
    for text in texts(300, 6):
        assert ids(own.encode(text)) == library.encode_ordinary(text)


def test_bpe_rows(odd_docs, odd_rows, empty_docs, library):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = sorted((tuple(r) for r in byte_bpe.digests(odd_docs, path, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for row in odd_rows:
        data = np.array(library.encode_ordinary(row[1] or ""), "<u4").tobytes()
        want.append((row[0], len(data) // 4, hashlib.sha256(data).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert byte_bpe.digests(empty_docs, path, public_tokenizers.PATTERN).collect() == []
    full = byte_bpe.encoded(odd_docs, path, public_tokenizers.PATTERN).collect()
    assert {(r.doc_id, bytes(r.decoded)) for r in full} == {(r[0], (r[1] or "").encode()) for r in odd_rows}


def test_counts_equal_library(odd_docs, odd_rows, empty_docs, monkeypatch):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counter = token_counts.Counter(PIECES)
    assert counter.splits
    cases = texts() + ["", " ", "\n", "\n\n", " \n ", "a\n", "\na", "a \nb", "▁", "▁▁ a", "a" * 9000]
    assert counter.count(cases) == [len(model.encode(t)) for t in cases]
    assert not any(len(w) > token_counts.WORD_CHARS for w in counter.counts)
    monkeypatch.setattr(token_counts, "WORDS_KEPT", 20)
    assert [counter.count([t])[0] for t in cases[:300]] == [len(model.encode(t)) for t in cases[:300]]
    counter.splits = False
    assert counter.count(cases) == [len(model.encode(t)) for t in cases]
    got = sorted((tuple(r) for r in token_counts.counts(odd_docs, PIECES).collect()), key=str)
    want = [(r[0], len((r[1] or "").encode()), n := len(model.encode(r[1] or "")), n > 4096) for r in odd_rows]
    assert got == sorted(want, key=str)
    assert token_counts.counts(empty_docs, PIECES).collect() == []
