"""Prefix trie of conversations: range minima over the sorted sequences' common prefixes.

Conversations are sorted as sequences of turn digests over all tasks, equal ones by id, so the members of a prefix are
an interval. A task cuts its rows into pieces of bounded size. In a piece a sparse table holds the minima of the common
prefix lengths of neighbours; every prefix of every row is a candidate that finds its left and its right end by a
binary search of its own; the candidates that start at their own row are the nodes.

A node that touches neither end of its piece is complete there. The others are prefixes of the piece's first or last
row: these two rows go, with what the piece knows of each of their prefixes, to the next level, which treats them in
the same way, until one piece is left. A prefix or conversation that a third of all rows share thus spreads over all
tasks, and each level has a small fraction of the rows below. Ids that end at such a node are written as long strings
of ascending ids; only those meet in one task, which hashes them as a stream (SHA-256 has no other order).

A conversation's turns stand in one row, as 16 bytes each; texts are never shuffled.

Results for odd input: rows without a conv_id belong to no conversation; null roles and texts are empty; turns with
the same number, repeated rows too, all stay and are ordered by their digest; conv_id - conv_id % 20 has the sign rule
of SQL; an empty table has no node; only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairflow.llm import keys
from pairflow.llm.textkit import mix, numbers
from pairflow.workspace import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAMILY = 20  # conversations that share the head of the first of them
TURNS_PER_PIECE = 250_000
ROWS_PER_PIECE = 64  # least number of rows of a piece, so that every level is much smaller than the one before
WORD = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE, ROW, CHUNK = 0, 1, 2
SUMS = ("cnt", "low", "leaves", "saved", "kids")
SCHEMA = ("kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
          "saved_tokens long, ends_sha256 string, key binary, parent_key binary, part long, place long, "
          "seq binary, words array<long>, " + ", ".join(f"{c} array<long>" for c in SUMS) + ", ids string")
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """conv_id, seq (16 bytes a turn), words (words of each turn) of every conversation with its family's head."""
    said = [F.coalesce(conversations[c].cast("string"), F.lit("")) for c in (role, text)]
    turns = conversations.select(
        conversations[conv].cast("long").alias("conv_id"), conversations[turn].cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(said[0]).cast("string"), F.lit(":"), *said).cast("binary"))).alias("d"),
        F.regexp_count(said[1], F.lit(WORD)).cast("long").alias("n")).filter("conv_id IS NOT NULL")
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "d", "n"))).alias("turns"))
    own = materialize(own, "conversations")
    heads = own.filter(f"conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("family"), F.slice("turns", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    whole = F.concat(F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h),
                     F.slice("turns", h + 1, F.size("turns")))
    return (own.withColumn("family", F.expr(f"conv_id - conv_id % {FAMILY}")).join(heads, "family", "left")
            .withColumn("whole", whole)
            .select("conv_id", F.unhex(F.array_join(F.transform("whole", lambda t: F.hex(t["d"])), "")).alias("seq"),
                    F.transform("whole", lambda t: t["n"]).alias("words")))


def common_prefixes(digests: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Common prefix length of each row with the next."""
    if len(lengths) < 2:
        return np.zeros(0, np.int64)
    most = np.minimum(lengths[:-1], lengths[1:])
    step, first = _within(most)
    place = np.arange(len(step)) - first
    same = (digests[starts[:-1][step] + place] == digests[starts[1:][step] + place]).all(axis=1)
    out = most.copy()
    np.minimum.at(out, step[~same], place[~same])
    return out


def _within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of so many entries: each entry's row, and the row's first entry."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.repeat(np.cumsum(sizes) - sizes, sizes)


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all runs of 1, 2, 4, ... values."""
    table = [values]
    while 2 * (half := 1 << (len(table) - 1)) <= len(values):
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def extents(table: list[np.ndarray], n: int, row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share the first `depth` turns with `row`, each by a binary search over range minima."""
    left, right = row.copy(), row.copy()
    for k in range(len(table) - 1, -1, -1):
        if not len(table[k]):
            continue
        width = 1 << k
        at = left - width
        left = np.where((at >= 0) & (table[k][np.maximum(at, 0)] >= depth), at, left)
        fits = right + width <= n - 1
        right = np.where(fits & (table[k][np.where(fits, right, 0)] >= depth), right + width, right)
    return left, right


class Piece:
    """A run of sorted rows and its nodes. sums: per row and depth 0 to its length, what is known of that prefix."""

    def __init__(self, seqs: list[bytes], words: np.ndarray, sums: dict[str, np.ndarray]):
        digests = np.frombuffer(b"".join(seqs), np.uint64).reshape(-1, 2)
        lengths = np.fromiter((len(s) // 16 for s in seqs), np.int64, len(seqs))
        starts = np.cumsum(lengths) - lengths
        self.n, self.seqs, self.lengths, self.words = len(seqs), seqs, lengths, words
        self.row, first = _within(lengths + 1)
        self.depth = np.arange(len(self.row)) - first
        self.first_entry = np.cumsum(lengths + 1) - lengths - 1
        self.lcp = common_prefixes(digests, starts, lengths)
        left, right = extents(sparse_table(self.lcp), self.n, self.row, self.depth)
        # Entries of one depth are cut into nodes; entries and nodes are numbered by row, then depth.
        node_entry = np.flatnonzero(left == self.row)
        number = np.zeros(len(self.row), np.int64)
        number[node_entry] = np.arange(len(node_entry))
        self.node_of = number[self.first_entry[left] + self.depth]
        self.entry, self.left, self.right = node_entry, left[node_entry], right[node_entry]
        self.node_depth = self.depth[node_entry]
        self.parent = np.where(self.node_depth > 0, self.node_of[node_entry - (self.node_depth > 0)], -1)
        self.sum = {c: np.zeros(len(node_entry), np.int64) for c in SUMS}
        for c in SUMS:
            if c == "low":
                self.sum[c] += np.iinfo(np.int64).max
                np.minimum.at(self.sum[c], self.node_of, sums[c])
            else:
                np.add.at(self.sum[c], self.node_of, sums[c])
        self.sum["kids"] += np.bincount(self.parent[self.parent >= 0], minlength=len(node_entry))
        # Fingerprints of prefixes: digests mixed with their place, combined over the prefix.
        place = np.arange(len(digests)) - np.repeat(starts, lengths)
        salted = np.zeros((len(self.row), 2), np.uint64)
        inner = np.flatnonzero(self.depth > 0)
        for j in range(2):
            salted[inner, j] = mix(digests[:, j] + mix(place.astype(np.uint64) * np.uint64(2) + np.uint64(j)))
        run = np.bitwise_xor.accumulate(salted, axis=0)
        self.prints = run ^ run[np.repeat(self.first_entry, lengths + 1)]
        own_words = np.zeros(len(self.row), np.int64)
        own_words[inner] = words
        self.own_words = own_words[node_entry]

    def key(self, entry: int) -> bytes:
        return self.prints[entry].tobytes()

    def settle(self, final: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Complete nodes, and leaves and saved tokens of every node's subtree from complete nodes."""
        done = np.ones(len(self.entry), bool) if final else (self.left > 0) & (self.right < self.n - 1)
        upto = np.searchsorted(self.left, self.right, side="right")  # nodes are numbered by first row
        totals = []
        for known, own in (("leaves", self.sum["kids"] == 0), ("saved", (self.sum["cnt"] - 1) * self.own_words)):
            run = np.concatenate(([0], np.cumsum(np.where(done, own, 0))))
            # What is known of a prefix from below holds all complete nodes under it, so it counts for itself alone.
            totals.append(run[upto] - run[:-1] + self.sum[known])
        return done, totals[0], totals[1]

    def ends(self, ids: np.ndarray) -> dict[int, list[int]]:
        """Node -> ascending ids of the rows that end there."""
        last = self.node_of[self.first_entry + self.lengths]
        cuts = np.flatnonzero(np.diff(last)) + 1
        return {int(last[a]): ids[a:b].tolist() for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), self.n]) if b > a}


def _columns(n: int, **given) -> list:
    return [given.get(f.split()[0], [None] * n) for f in SCHEMA.split(", ")]


def _types() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in SCHEMA.split(", ")])


def _out(n: int, **given) -> pa.RecordBatch:
    types = _types()
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(_columns(n, **given), types)]
    return pa.RecordBatch.from_arrays(arrays, schema=types)


def report(piece: Piece, ids: np.ndarray | None, final: bool, part: int, place: int) -> Iterator[pa.RecordBatch]:
    """Complete nodes, ids that end at others, and the outer rows for the next level."""
    done, leaves, saved = piece.settle(final)
    ends = piece.ends(ids) if ids is not None else {}
    low, cnt, kids = piece.sum["low"], piece.sum["cnt"], piece.sum["kids"]
    at = np.flatnonzero(done)
    parent = piece.parent[at]
    known = (parent >= 0) & done[parent]
    orphan = (parent >= 0) & ~known
    if len(at):
        digest = [NO_ENDS] * len(at) if ids is not None else [None] * len(at)
        where = {int(x): i for i, x in enumerate(at.tolist())}
        for x, members in ends.items():
            if x in where:
                digest[where[x]] = hashlib.sha256(",".join(map(str, members)).encode()).hexdigest()
        yield _out(
            len(at), kind=np.full(len(at), NODE, np.int32), conv_id=low[at], depth=piece.node_depth[at],
            parent_conv_id=pa.array(low[parent], pa.int64(), mask=~known), n_convs=cnt[at], n_children=kids[at],
            n_leaves=leaves[at], saved_tokens=saved[at], ends_sha256=digest,
            key=[piece.key(e) for e in piece.entry[at]] if ids is None else [None] * len(at),
            parent_key=[piece.key(piece.entry[p]) if o else None for p, o in zip(parent, orphan)])
    if final:
        return
    open_ends = [(piece.key(piece.entry[x]), m[0], ",".join(map(str, m))) for x, m in ends.items() if not done[x]]
    if open_ends:
        yield _out(len(open_ends), kind=np.full(len(open_ends), CHUNK, np.int32), key=[e[0] for e in open_ends],
                   conv_id=[e[1] for e in open_ends], ids=[e[2] for e in open_ends])
    closed_kids = kids - np.bincount(piece.parent[(piece.parent >= 0) & ~done], minlength=len(kids))
    values = {"cnt": cnt, "low": low, "leaves": leaves, "saved": saved, "kids": closed_kids}
    outer = [0, piece.n - 1] if piece.n > 1 else [0]
    sums: dict[str, list] = {c: [] for c in SUMS}
    for i, r in enumerate(outer):
        nodes = piece.node_of[piece.first_entry[r]:piece.first_entry[r] + piece.lengths[r] + 1]
        told = (piece.left[nodes] == 0) if i else np.zeros(len(nodes), bool)  # the first row has told of these
        for c in SUMS:
            sums[c].append(np.where(told, np.iinfo(np.int64).max if c == "low" else 0, values[c][nodes]))
    word_starts = np.cumsum(piece.lengths) - piece.lengths
    yield _out(len(outer), kind=np.full(len(outer), ROW, np.int32), part=[part] * len(outer),
               place=[2 * place + i for i in range(len(outer))], seq=[piece.seqs[r] for r in outer],
               words=[piece.words[word_starts[r]:word_starts[r] + piece.lengths[r]] for r in outer], **sums)


def _piece(table: pa.Table) -> tuple[Piece, np.ndarray | None]:
    seqs = [s or b"" for s in table.column("seq").to_pylist()]
    flat = lambda c: numbers(table.column(c).combine_chunks().flatten()).astype(np.int64)
    if "cnt" in table.column_names:
        ids, sums = None, {c: flat(c) for c in SUMS}
    else:
        ids = numbers(table.column("conv_id"))
        size = np.fromiter((len(s) // 16 + 1 for s in seqs), np.int64, len(seqs))
        zero = np.zeros(int(size.sum()), np.int64)
        sums = {c: zero for c in SUMS} | {"cnt": zero + 1, "low": np.repeat(ids, size)}
    return Piece(seqs, flat("words"), sums), ids


def _level(rows: DataFrame, final: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, place, held, turns, n = context.partitionId() if context else 0, 0, [], 0, 0
        for batch in batches:
            held.append(batch)
            turns += len(batch.column(batch.schema.get_field_index("words")).flatten())
            n += batch.num_rows
            if turns >= TURNS_PER_PIECE and n >= ROWS_PER_PIECE and not final:
                yield from report(*_piece(pa.Table.from_batches(held)), final, part, place)
                place, held, turns, n = place + 1, [], 0, 0
        if n:
            yield from report(*_piece(pa.Table.from_batches(held)), final, part, place)

    return rows.mapInArrow(run, SCHEMA)


def _hashed(chunks: DataFrame) -> DataFrame:
    """key, sha: SHA-256 of each key's ids, read as a stream in ascending order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        give = lambda: pa.RecordBatch.from_arrays(
            [pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "sha"])
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != key:
                    if key is not None:
                        yield give()
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if key is not None:
            yield give()

    ordered = chunks.select("key", F.col("conv_id").alias("first_id"), "ids").repartition("key").sortWithinPartitions("key", "first_id")
    return ordered.mapInArrow(run, "key binary, sha string")


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes of rebuilt() conversations: RESULT's columns."""
    spark = sequences.sparkSession
    stored = materialize(sequences, "sequences")
    n, turns = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    parts = max(1, -(-turns // TURNS_PER_PIECE), min(spark.sparkContext.defaultParallelism, n // 1000))
    rows = stored.repartitionByRange(parts, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    levels = [materialize(_level(rows, False), "trie")]
    while True:
        up = levels[-1].filter(F.col("kind") == ROW)
        n, turns = up.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words") + 1), F.lit(0))).first()
        final = turns <= TURNS_PER_PIECE or n <= ROWS_PER_PIECE
        up = up.select("part", "place", "seq", "words", *SUMS)
        if final:
            up = up.repartition(1)
        else:
            up = up.repartitionByRange(max(1, min(-(-turns // TURNS_PER_PIECE), n // (4 * ROWS_PER_PIECE))), "part", "place")
        levels.append(materialize(_level(up.sortWithinPartitions("part", "place"), final), "trie"))
        if final:
            break
    upper = levels[1]
    for level in levels[2:]:
        upper = upper.unionByName(level)
    upper = upper.filter(F.col("kind") == NODE)
    names = keys.sized(upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("named")), "names")
    ends = _hashed(levels[0].filter(F.col("kind") == CHUNK))
    upper = (upper.drop("ends_sha256").join(keys.sized(ends, "ends"), "key", "left")
             .withColumn("ends_sha256", F.coalesce("sha", F.lit(NO_ENDS))))
    columns = [*RESULT, "parent_key"]
    nodes = levels[0].filter(F.col("kind") == NODE).select(columns).unionByName(upper.select(columns))
    kin = nodes.filter("parent_key IS NOT NULL").join(names, "parent_key", "left").withColumn("parent_conv_id", F.col("named"))
    return nodes.filter("parent_key IS NULL").select(RESULT).unionByName(kin.select(RESULT))


def build(conversations: DataFrame, **columns: str) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations."""
    return trie(rebuilt(conversations, **columns))
