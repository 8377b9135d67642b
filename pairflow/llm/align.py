"""Alignment of two tokenizers' tokens by bytes, with corpus-wide counts of the linked token pairs.

A text is cut where neither tokenizer can join what stands on both sides: before a blank or line feed that follows a
character which is no white space. What lies between (a word, as a rule) recurs, so its groups and links are kept in a
bounded memo, and long texts never reach a library whole.

Pairs are counted by external spill counting. A task writes its documents' links as zstd runs: the body (each
document's pairs with their numbers) and, partitioned by the low digits of the A id, the heads: each pair with the
number of documents in the run. Runs and bodies are bounded in size, whatever a task reads. A bucket's heads meet in a
k-way merge by a heap over A ids: all runs that hold the smallest A id give their pairs, which are summed; as the order
is A-major, the A id's highest count is known as soon as its pairs are, and every run gets its pairs' counts back. More
than FAN runs are merged in teams first, and the answers go down the same way. A merge holds at most FAN heads; a
pair that all documents hold has one entry in a run, and an A id has no more entries than there are B ids. The answers
then meet the bodies, run by run.

Results for odd input: a null, empty or not reproducible text has no tokens; an empty table has no rows; repeated rows
are documents of their own and get a row each; a null id stays null; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import sentencepiece
import zstandard
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairflow.llm import textkit, worker
from pairflow.workspace import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 64  # low digits of the A id
FAN = 256  # runs of one merge
RUN_PAIRS = 2_000_000
RUN_BYTES = 48 << 20
B_BITS = 15
MEMO_ENTRIES, MEMO_CHARS = 150_000, 200  # of each of two generations, about 50 MB
BATCH_BYTES = 1 << 20
BLANK, MARK = " ", "▁"
CUT = re.compile(r"(?<=\S)(?=[ \n])")
HEADS = "run long, bucket int, data binary"
_DOC = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
        ("groups_sha256", pa.string())]
_TEAM = pa.schema([("run", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])
RUNS = HEADS + ", " + ", ".join(f"{n} array<{'string' if t == pa.string() else 'long'}>" for n, t in _DOC)
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")


def byte_of() -> dict[str, int]:
    """The character of each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Aligner:
    """Groups and links of texts, word by word."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        values = byte_of()
        self.a_bytes = {i: bytes(values[c] for c in entry) for entry, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        ids = range(self.b.get_piece_size())
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace(MARK, BLANK).encode() for i in ids]
        self.lone = self.b.piece_to_id(MARK)
        joined = re.compile(f"[^{MARK}]{MARK}|\n")
        if any(joined.search(self.b.id_to_piece(i)) for i in ids):
            raise ValueError("pieces of the second vocabulary reach over blanks: texts can't be cut there")
        if len(ids) > 1 << B_BITS or max(self.a_bytes) >= 1 << 32 - B_BITS:
            raise ValueError("vocabularies too large for pairs of 32 bits")
        self.memo: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def parts(self, text: str) -> list[str]:
        """The text's words, each with the blanks or line feed in front; none if marks in the text make it ambiguous."""
        return CUT.split(BLANK + text) if text and MARK not in text else []

    def _aligned(self, word: str, a: list[int], b: list[int]) -> tuple | None:
        """n_a, n_b, groups, links of a word's tokens; None if they don't give the word back."""
        data = word.encode()
        a_parts, b_parts = [self.a_bytes.get(i, b"") for i in a], [self.b_bytes[i] for i in b]
        if b"".join(a_parts) != data or b"".join(b_parts) != data:
            return None
        groups, links, i, j, a_from, b_from, a_to, b_to = [], [], 0, 0, 0, 0, len(a_parts[0]), len(b_parts[0])
        while True:
            links.append(a[i] << B_BITS | b[j])
            if a_to == b_to:
                groups.append(f"{','.join(map(str, a[a_from:i + 1]))}|{','.join(map(str, b[b_from:j + 1]))}")
                i, j = i + 1, j + 1
                if i == len(a):
                    break
                a_from, b_from, a_to, b_to = i, j, a_to + len(a_parts[i]), b_to + len(b_parts[j])
            elif a_to < b_to:
                i += 1
                a_to += len(a_parts[i])
            else:
                j += 1
                b_to += len(b_parts[j])
        return len(a), len(b), ";".join(groups), np.array(links, np.uint32).tobytes(), len(groups)

    def learn(self, words: list[str]) -> dict[str, tuple | None]:
        """What the two libraries make of new words."""
        out = {}
        for s, e in textkit.slices([len(w) for w in words], BATCH_BYTES):
            part = words[s:e]
            # The library puts a mark in front: it stands for the word's own blank, or is taken off before a line feed.
            own = self.b.encode([w[1:] if w[0] == BLANK else w for w in part], num_threads=1)
            for word, a, b in zip(part, self.a.encode_batch_fast(part, add_special_tokens=False), own):
                out[word] = self._aligned(word, a.ids, [self.lone] if word == BLANK else b if word[0] == BLANK else b[1:])
        return out

    def align(self, texts: list[str]) -> list[list[tuple]]:
        """The words' alignments for each text; none for a text without tokens."""
        parts = [self.parts(t) for t in texts]
        if len(self.memo) > MEMO_ENTRIES:
            self.older, self.memo = self.memo, {}
        new = set().union(*parts) - self.memo.keys()
        again = new & self.older.keys()
        self.memo.update((w, self.older[w]) for w in again)
        found = self.learn(list(new - again))
        long = {w: x for w, x in found.items() if len(w) > MEMO_CHARS}
        self.memo.update((w, x) for w, x in found.items() if len(w) <= MEMO_CHARS)
        memo = self.memo
        out = []
        for words in parts:
            known = [memo[w] if w in memo else long[w] for w in words] if long else [memo[w] for w in words]
            out.append([] if None in known else known)
        return out


def pack(codes: np.ndarray, *more: np.ndarray) -> bytes:
    """Codes as differences, and columns of 64-bit numbers beside them or of another length, compressed."""
    sizes = np.array([len(codes), *map(len, more)], np.int64)
    steps = np.diff(codes.astype(np.uint32), prepend=np.uint32(0))
    return zstandard.ZstdCompressor(level=3).compress(
        b"".join([np.int64(len(sizes)).tobytes(), sizes.tobytes(), steps.tobytes(), *(m.astype(np.int64).tobytes() for m in more)]))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8).tolist()
    at = 8 + 8 * n
    out = [np.cumsum(np.frombuffer(raw, np.uint32, sizes[0], at), dtype=np.uint32)]
    at += 4 * sizes[0]
    for size in sizes[1:]:
        out.append(np.frombuffer(raw, np.int64, size, at))
        at += 8 * size
    return out


def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and the sums of their counts."""
    if not codes:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    every, counted = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.ones(len(every), bool)
    first[1:] = every[1:] != every[:-1]
    at = np.flatnonzero(first)
    return every[at], np.add.reduceat(counted[order], at) if len(at) else np.zeros(0, np.int64)


class Run:
    """The links of some documents until they are passed on."""

    def __init__(self):
        self.codes, self.counts, self.pending, self.size, self.body = [], [], 0, 0, 0

    def add(self, codes: np.ndarray, body: bytes) -> None:
        """The distinct pairs of every document, one document after the other."""
        codes, counts = np.unique(codes, return_counts=True)
        self.codes.append(codes)
        self.counts.append(counts)
        self.pending += len(codes)
        self.body += len(body)
        if self.pending > 2 * max(self.size, RUN_PAIRS // 4):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        codes, counts = summed(self.codes, self.counts)
        self.codes, self.counts, self.size, self.pending = [codes], [counts], len(codes), len(codes)
        return codes, counts

    def full(self) -> bool:
        return self.size > RUN_PAIRS or self.body > RUN_BYTES

    def heads(self) -> Iterator[tuple[int, bytes]]:
        codes, counts = self.settle()
        digit = (codes >> np.uint32(B_BITS)) % np.uint32(BUCKETS)
        for bucket in range(BUCKETS):
            own = digit == bucket
            if own.any():
                yield bucket, pack(codes[own], counts[own])


def write_runs(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Heads (run, bucket, data) and bodies (bucket null, data, one list per document column) of id, text rows."""
    schema = pa.schema([*_TEAM, *((n, pa.list_(t)) for n, t in _DOC)])

    def row(run: int, bucket: int | None, data: bytes, columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([run, bucket, data, *columns], schema)], schema=schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker.kept(("align", path_a, path_b), lambda: Aligner(path_a, path_b))
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 24
        run = Run()

        def heads() -> Iterator[pa.RecordBatch]:
            for bucket, data in run.heads():
                yield row(number, bucket, data, [None] * len(_DOC))

        for batch in batches:
            lengths = [0 if t is None else t for t in pa.compute.binary_length(batch.column(1)).to_pylist()]
            for a, b in textkit.slices(lengths, BATCH_BYTES):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                codes, times, sizes, columns = [], [], [], [batch.column(0).slice(a, b - a).to_pylist(), [], [], [], [], []]
                for words in own.align(texts):
                    links = np.frombuffer(b"".join([w[3] for w in words]), np.uint32)
                    distinct, n = np.unique(links, return_counts=True)
                    codes.append(distinct)
                    times.append(n)
                    sizes.append(len(distinct))
                    groups = ";".join([w[2] for w in words])
                    for column, value in zip(columns[1:], (
                            sum([w[0] for w in words]), sum([w[1] for w in words]), sum([w[4] for w in words]), len(links),
                            hashlib.sha256(groups.encode()).hexdigest() if words else "")):
                        column.append(value)
                every = np.concatenate(codes)
                body = pack(every, np.concatenate(times), np.array(sizes))
                run.add(every, body)
                yield row(number, None, body, columns)
                if run.full():
                    yield from heads()
                    number, run = number + 1, Run()
        yield from heads()

    return docs.mapInArrow(write, RUNS)


def merged(heads: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]]:
    """K-way merge of runs (sorted pairs, counts), one A id at a time: its pairs, their summed counts, whether a count
    is the A id's highest, and for each run that holds it the places of the run's pairs among these."""
    cuts = []
    for codes, _ in heads:
        a = codes >> np.uint32(B_BITS)
        starts = np.concatenate(([0], np.flatnonzero(a[1:] != a[:-1]) + 1)) if len(a) else np.zeros(0, np.int64)
        cuts.append((a[starts].tolist(), [*starts.tolist(), len(a)]))
    heap = [(ids[0], r, 0) for r, (ids, _) in enumerate(cuts) if ids]
    heapq.heapify(heap)
    while heap:
        smallest, part = heap[0][0], []
        while heap and heap[0][0] == smallest:
            _, r, k = heap[0]
            ids, at = cuts[r]
            part.append((r, heads[r][0][at[k]:at[k + 1]], heads[r][1][at[k]:at[k + 1]]))
            if k + 1 < len(ids):
                heapq.heapreplace(heap, (ids[k + 1], r, k + 1))
            else:
                heapq.heappop(heap)
        codes, counts = summed([p[1] for p in part], [p[2] for p in part])
        yield codes, counts, counts == counts.max(), [(r, np.searchsorted(codes, own)) for r, own, _ in part]


def _heads(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    return [tuple(unpack(d)[:2]) for d in table.column("data").to_pylist()]


def _answers(table: pa.Table) -> pa.Table:
    """A bucket's runs get their pairs back with the corpus-wide count and whether it is the A id's highest."""
    heads = _heads(table)
    back: list[list] = [[] for _ in heads]
    for _, counts, best, runs in merged(heads):
        for r, places in runs:
            back[r].append((counts[places], best[places]))
    data = [pack(codes, np.concatenate([c for c, _ in own]), np.concatenate([b for _, b in own]))
            for (codes, _), own in zip(heads, back)]
    return pa.table([table.column("run"), table.column("bucket"), pa.array(data, pa.binary())], schema=_TEAM)


def _team(table: pa.Table) -> pa.Table:
    """The runs of a team as one run, whose number is the team's."""
    codes, counts = [], []
    for own, sums, _, _ in merged(_heads(table)):
        codes.append(own)
        counts.append(sums)
    return pa.table([[table.column("team")[0].as_py()], [table.column("bucket")[0].as_py()], [pack(np.concatenate(codes), np.concatenate(counts))]],
                    schema=_TEAM)


def _down(members: pa.Table, answer: pa.Table) -> pa.Table:
    """A team's answer, told to its members."""
    codes, counts, best = unpack(answer.column("data")[0].as_py())
    data = []
    for own, _ in _heads(members):
        at = np.searchsorted(codes, own)
        data.append(pack(own, counts[at], best[at]))
    return pa.table([members.column("run"), members.column("bucket"), pa.array(data, pa.binary())], schema=_TEAM)


def counted(heads: DataFrame, runs: int) -> DataFrame:
    """run, bucket, data: each run's pairs with their corpus-wide count and whether it is the A id's highest."""
    if runs <= FAN:
        return heads.groupBy("bucket").applyInArrow(_answers, HEADS)
    teams = -(-runs // FAN)
    teamed = heads.withColumn("team", F.pmod(F.xxhash64("run"), F.lit(teams)))
    upper = materialize(teamed.groupBy("bucket", "team").applyInArrow(_team, HEADS), "teams")
    answers = materialize(counted(upper, teams), "answers").withColumnRenamed("run", "team")
    return teamed.groupBy("bucket", "team").cogroup(answers.groupBy("bucket", "team")).applyInArrow(_down, HEADS)


def _documents(bodies: pa.Table, answers: pa.Table) -> pa.Table:
    """A run's documents with the sums over their links."""
    told = [unpack(d) for d in answers.column("data").to_pylist()]
    none = [np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    codes, counts, best = (np.concatenate(c) for c in zip(*told, none))
    order = np.argsort(codes)
    codes, counts, best = codes[order], counts[order], best[order]
    columns: dict[str, list] = {n: [] for n, _ in _DOC} | {"n_best": [], "count_sum": []}
    for i in range(bodies.num_rows):
        own, times, sizes = unpack(bodies.column("data")[i].as_py())
        at, doc = np.searchsorted(codes, own), np.repeat(np.arange(len(sizes)), sizes)
        for name, values in (("n_best", best[at] * times), ("count_sum", counts[at] * times)):
            total = np.zeros(len(sizes), np.int64)
            np.add.at(total, doc, values)
            columns[name] += total.tolist()
        for n, _ in _DOC:
            columns[n] += bodies.column(n)[i].as_py()
    names = [f.split()[0] for f in RESULT.split(", ")]
    return pa.table([pa.array(columns[n], pa.string() if n == "groups_sha256" else pa.int64()) for n in names], names=names)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    path_a: a byte-level BPE of the tokenizers library, given a blank and the text; path_b: a SentencePiece model
    that puts a blank in front itself.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    stored = materialize(write_runs(rows, path_a, path_b), "runs")
    heads = stored.filter("bucket IS NOT NULL").select("run", "bucket", "data")
    answers = counted(heads, heads.select("run").distinct().count())
    bodies = stored.filter("bucket IS NULL").select("run", "data", *(n for n, _ in _DOC))
    return bodies.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(_documents, RESULT)
