"""Byte-level BPE encoding and decoding.

A byte is one Latin-1 character of an Aho-Corasick automaton over the vocabulary. From the left, the longest
token that matches is taken if it is compatible with the token before it, else the next shorter one; where
none is left, the position is closed and the last token is given up. Two tokens are compatible if the merges of
their joint bytes give just these two, which is worked out once per pair and remembered. A sequence whose
neighbours are all compatible is the one that the merges make, so the result is exact, in time that is linear
in the text: no merge queue, and no search over a long piece.

Texts are cut into pieces by the tokenizer's pattern, and each piece is encoded by itself. Pieces recur, so
their ids are kept in a memo of two bounded generations.

Results for odd input: a null text counts as empty; the empty text has 0 tokens and the digests of no bytes;
repeated rows get a row each; a null id stays null; only the two named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from pairflow.llm import worker

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A worker's memos: two generations of pieces, by number and by bytes of pieces and ids (about 200 MB in all; longer
# pieces are never kept), and one of pairs (about 80 MB).
PIECES_KEPT, PIECES_BYTES, PIECE_CHARS = 500_000, 16 << 20, 256
PAIRS_KEPT = 1_000_000
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

# Members of the pattern's classes up to U+017F.
_LATIN = {"L": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "N": "0-9\xb2\xb3\xb9\xbc-\xbe",
          "s": "\t-\r \x85\xa0"}
_BEYOND_LATIN = re.compile("[^\x00-\u017f]")


def latin_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts up to U+017F with its classes written out, which the faster engine takes; None if
    it has classes besides \\p{L}, \\p{N}, \\s and \\S."""
    out, at, inside = "", 0, False
    while at < len(pattern):
        name = re.compile(r"\\p\{([LN])\}|\\([sS])").match(pattern, at)
        if name:
            members = _LATIN[name[1] or "s"]
            if name[2] == "S" and inside:
                return None
            out += members if inside else f"[{'^' if name[2] == 'S' else ''}{members}]"
            at = name.end()
            continue
        if pattern[at] == "\\" and pattern[at + 1:at + 2].isalpha():
            return None
        inside = pattern[at] == "[" or inside and pattern[at] != "]"
        step = 2 if pattern[at] == "\\" else 1
        out += pattern[at:at + step]
        at += step
    try:
        return re.compile(out)
    except re.error:
        return None


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class ByteBPE:
    """Exact byte-pair encoding by a vocabulary of ranks (token bytes -> id; every single byte is a token)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.latin = latin_pattern(pattern)
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0  # bytes of the pieces kept, and of their ids
        self.halves_of: dict[int, tuple[int, int] | None] = {}
        self.edge_of: dict[int, list[tuple[bytes, int]] | None] = {}
        self.shorter_of: dict[int, int | None] = {}
        size = max(self.token) + 1
        self.length = [len(self.token.get(i, b"")) for i in range(size)]
        self.lengths = np.array(self.length, dtype=np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(size)), dtype=np.uint8)

    def merged(self, data: bytes, stop: int = 1) -> list[int]:
        """The merges carried out one by one until `stop` tokens are left, for short byte strings."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > stop:
            best = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens of a token's last merge; None for a single byte and for what merges never make."""
        if token not in self.halves_of:
            parts = self.merged(self.token[token], stop=2)
            made = len(parts) == 2 and self.ranks.get(self.token[parts[0]] + self.token[parts[1]]) == token
            self.halves_of[token] = (parts[0], parts[1]) if made else None
        return self.halves_of[token]

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]] | None:
        """A token's part at its end (side 1) or start (side 0) over time, and the rank at which that part is
        merged on; None if ranks do not rise from parts to wholes."""
        key = token << 1 | side
        if key not in self.edge_of:
            out, until = [(self.token[token], 1 << 60)], token
            while (parts := self.halves(until)) is not None:
                if max(parts) > until:
                    out = None
                    break
                out.append((self.token[parts[side]], until))
                until = parts[side]
            self.edge_of[key] = None if out is None or len(self.token[until]) > 1 else out
        return self.edge_of[key]

    def compatible(self, left: int | None, right: int) -> bool:
        """The merges of both tokens' bytes give these two tokens (of the right one's, if there is no left)."""
        key = right if left is None else (left + 1) << 32 | right
        known = self.pairs.get(key)
        if known is None:
            ends, starts = None if left is None else self.edge(left, 1), self.edge(right, 0)
            if ends is None or starts is None:
                data = b"" if left is None else self.token[left]
                known = self.merged(data + self.token[right]) == ([] if left is None else [left]) + [right]
            else:
                # Merges run in rising rank, so a pair across the border merges if both its parts still stand
                # at its rank; of equal ranks the leftmost goes first.
                known = not any(
                    (rank := self.ranks.get(x + y)) is not None and rank < until_x and rank <= until_y
                    for x, until_x in ends for y, until_y in starts)
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.shorter_of:
            data = self.token[token]
            self.shorter_of[token] = next(
                (self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), None)
        return self.shorter_of[token]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, n = piece.decode("latin-1"), len(piece)
        length, pairs, matches, longest = self.length, self.pairs, self.automaton.iter_long, self.longest
        out: list[int] = []
        closed: set[int] = set()
        # Each search sees no more of the piece than a token can hold, as a call takes time for all that it is given.
        at, last, token = 0, None, next(matches(text[:longest]))[1]
        while True:
            while token is not None:
                end = at + length[token]
                if end not in closed:
                    fits = pairs.get(token if last is None else (last + 1) << 32 | token)
                    if fits or fits is None and self.compatible(last, token):
                        break
                token = self.shorter(token)
            if token is None:
                closed.add(at)
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else None
                continue
            out.append(token)
            if end == n:
                return out
            at, last, token = end, token, next(matches(text[end:end + longest]))[1]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        pattern = self.latin if self.latin and not _BEYOND_LATIN.search(text) else self.pattern
        pieces, memo = pattern.findall(text), self.pieces
        new = [p for p in set(pieces) if p not in memo]
        if not new:
            return b"".join(map(memo.__getitem__, pieces))
        if len(memo) + len(new) > PIECES_KEPT or self.held > PIECES_BYTES:
            self.older, self.pieces, self.held = memo, {}, 0
            memo, new = self.pieces, set(pieces)
        older, long = self.older, {}
        for p in new:
            ids = older.get(p) or array("I", self.encode_piece(p.encode())).tobytes()
            if len(p) > PIECE_CHARS:
                long[p] = ids
            else:
                memo[p] = ids
                self.held += len(p) + len(ids)
        return b"".join([long[p] if p in long else memo[p] for p in pieces] if long else map(memo.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        tokens = np.frombuffer(ids, dtype="<u4")
        lengths = self.lengths[tokens]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        shift = self.offsets[tokens] - (ends - lengths)
        return self.bytes[np.arange(ends[-1]) + np.repeat(shift, lengths)].tobytes()


def tokenizer(path: str, pattern: str) -> ByteBPE:
    """The worker's tokenizer of that vocabulary file."""
    return worker.kept(("byte_bpe", path, pattern), lambda: ByteBPE(read_ranks(path), pattern))


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (binary, little-endian unsigned 32-bit) and the bytes that the ids decode to, of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [own.encode(text or "") for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.binary())],
                    names=["doc_id", "ids", "decoded"])
    return _named(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; ids and bytes stay inside the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = own.encode(text.as_py() or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            n, first, second = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return _named(docs, id_col, text_col).mapInArrow(run, RESULT)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
