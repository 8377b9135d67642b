"""Approximate nearest neighbours by inner product, with a robust-pruned directed graph per shard.

Equal vectors are first gathered to one node that knows its smallest ids, so copies neither clog the graph nor
one task. Nodes are dealt to shards by hash, about SHARD_ROWS each. A shard's vectors fall into bands of length (a
band's longest is BAND_RATIO times its shortest at most), each with a graph of its own, in which the nearest by distance
are nearly the largest by inner product: one more component gives all the same length, and it is short. A graph
grows in batches: a greedy beam search from a few entries, which lie far apart, proposes neighbours for every new node,
robust pruning keeps those that no kept neighbour is ALPHA times nearer to, links are made in both directions, and
nodes with too many links are pruned again. Shards are stored as one row each, with vectors, links and ids.

Queries go to every shard in blocks of QUERY_BLOCK. Bands are searched from the longest vectors down; one whose longest
vector times the query's length is below the query's k-th score so far holds none of its nearest and is skipped, and
one of at most SCANNED vectors is scanned. A beam search finds the others' best nodes, these are scored in double
precision on the original vectors, and the best k of all shards are kept. Memory per task is one shard and one block.
Nothing but counts passes the driver.

Results for odd input: rows with a null id, and vectors that are null, empty, zero or hold null, NaN or
infinite components, take no part; vectors of another length than the query's are not its candidates; repeated
rows count once; of equal scores the smaller id comes first; with fewer than k candidates all found are
returned; an empty table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairflow.workspace import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARD_ROWS = 8192
QUERY_BLOCK = 512
DEGREE = 32
BUILD_BEAM = 48
SEARCH_BEAM = 96
ALPHA = 1.2
BAND_RATIO = 1.1
SCANNED = 256
ENTRIES = 48
_SHARD = ("shard int, dim int, n int, vectors binary, bands array<int>, links binary, entries array<int>, entry_counts array<int>, "
          "ids array<long>, id_counts array<int>")
_FOUND = "query_id long, vec_id long, score double"


class Graph:
    """links: n x DEGREE node numbers, -1 where there is none."""

    def __init__(self, points: np.ndarray, links: np.ndarray, entries: np.ndarray):
        self.points, self.links, self.entries = points, links, entries

    def beam_search(self, targets: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes nearest to each target, nearest first, and their squared distances (-1 and inf where none)."""
        b, n = len(targets), len(self.points)
        rows = np.arange(b)
        norms = np.einsum("ij,ij->i", self.points, self.points)
        ids = np.full((b, beam), -1, dtype=np.int64)
        far = np.full((b, beam), np.inf, dtype=np.float32)
        done = np.zeros((b, beam), dtype=bool)
        seen = np.zeros((b, n + 1), dtype=bool)
        seen[:, n] = True  # where links are -1
        first = self.entries[:beam]
        ids[:, :len(first)] = first
        far[:, :len(first)] = norms[first] - 2 * targets @ self.points[first].T
        seen[:, first] = True
        while True:
            open_ = np.where(done | (ids < 0), np.inf, far)
            pick = open_.argmin(axis=1)
            live = np.isfinite(open_[rows, pick])
            if not live.any():
                break
            own, at = rows[live], pick[live]
            done[own, at] = True
            near = self.links[ids[own, at]]
            near = np.where(seen[own[:, None], near], -1, near)
            seen[own[:, None], near] = True
            d = norms[near] - 2 * np.einsum("bd,brd->br", targets[own], self.points[near])
            d = np.where(near < 0, np.inf, d).astype(np.float32)
            all_far = np.concatenate([far[own], d], axis=1)
            order = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            take = np.arange(len(own))[:, None]
            far[own] = all_far[take, order]
            ids[own] = np.where(np.isfinite(far[own]), np.concatenate([ids[own], near], axis=1)[take, order], -1)
            done[own] = np.concatenate([done[own], np.zeros(near.shape, dtype=bool)], axis=1)[take, order]
        order = np.argsort(far, axis=1, kind="stable")
        return ids[rows[:, None], order], far[rows[:, None], order]


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Up to DEGREE links of each node: nearest first, without those that a chosen one is ALPHA times nearer to.

    candidates: nodes x any, -1 where there is none; links that fill up are the nearest of the rest.
    """
    own = np.arange(len(nodes))[:, None]
    ordered = np.sort(candidates, axis=1)  # equal candidates count once
    again = np.zeros(ordered.shape, dtype=bool)
    again[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
    gone = again | (ordered < 0) | (ordered == nodes[:, None])
    away = points[ordered] - points[nodes][:, None, :]
    far = np.where(gone, np.inf, np.einsum("bcd,bcd->bc", away, away))
    order = np.argsort(far, axis=1, kind="stable")
    ordered, far = ordered[own, order], far[own, order]
    vectors = points[ordered]
    norms = np.einsum("bcd,bcd->bc", vectors, vectors)
    between = norms[:, :, None] + norms[:, None, :] - 2 * vectors @ vectors.transpose(0, 2, 1)
    links = np.full((len(nodes), DEGREE), -1, dtype=np.int32)
    count = np.zeros(len(nodes), dtype=np.int64)
    open_ = np.isfinite(far)
    for c in range(ordered.shape[1]):
        chosen = np.flatnonzero(open_[:, c] & (count < DEGREE))
        if not len(chosen):
            continue
        links[chosen, count[chosen]] = ordered[chosen, c]
        count[chosen] += 1
        open_[chosen] &= ALPHA * ALPHA * between[chosen, c] > far[chosen]
    return links


def levelled(vectors: np.ndarray) -> np.ndarray:
    """Points of equal length: the vectors with one more component."""
    norms = np.einsum("ij,ij->i", vectors, vectors)
    return np.hstack([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]]).astype(np.float32)


def far_apart(points: np.ndarray, count: int) -> np.ndarray:
    """The most central point, then each time the one farthest from those taken."""
    away = points - points.mean(axis=0)
    taken = [int(np.einsum("ij,ij->i", away, away).argmin())]
    nearest = np.full(len(points), np.inf)
    while len(taken) < min(count, len(points)):
        step = points - points[taken[-1]]
        np.minimum(nearest, np.einsum("ij,ij->i", step, step), out=nearest)
        taken.append(int(nearest.argmax()))
    return np.array(taken)


def build_graph(vectors: np.ndarray, seed: int = 7) -> Graph:
    """The graph over distinct vectors (n x d, original scale)."""
    n = len(vectors)
    points = levelled(vectors)
    entries = far_apart(points, ENTRIES)
    rest = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([entries, rest[~np.isin(rest, entries)]])
    graph = Graph(points, np.full((n, DEGREE), -1, dtype=np.int32), entries[:1])
    at = 1
    while at < n:
        batch = order[at:at + max(1, min(at, 256))]
        found, _ = graph.beam_search(points[batch], BUILD_BEAM)
        # Nodes of one batch do not find each other in the graph, so they meet directly.
        d = np.einsum("ij,ij->i", points[batch], points[batch])[None, :] - 2 * points[batch] @ points[batch].T
        mates = batch[np.argsort(d, axis=1)[:, :9]]
        graph.links[batch] = robust_prune(points, batch, np.concatenate([found, mates], axis=1))
        _link_back(graph, batch)
        at += len(batch)
        graph.entries = entries[:min(at, len(entries))]
    return graph


def _link_back(graph: Graph, batch: np.ndarray) -> None:
    """The other direction of the links of new nodes; nodes with too many links are pruned."""
    sources = np.repeat(batch, DEGREE)
    targets = graph.links[batch].ravel()
    sources, targets = sources[targets >= 0], targets[targets >= 0]
    order = np.argsort(targets, kind="stable")
    sources, targets = sources[order], targets[order]
    nodes, first, counts = np.unique(targets, return_index=True, return_counts=True)
    # A node takes in at most DEGREE new links at a time, which bounds the table below.
    for start in range(0, int(counts.max()) if len(counts) else 0, DEGREE):
        some = counts > start
        own, begin, size = nodes[some], first[some] + start, np.minimum(counts[some] - start, DEGREE)
        new = np.full((len(own), DEGREE), -1, dtype=np.int64)
        row = np.repeat(np.arange(len(own)), size)
        col = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        new[row, col] = sources[np.repeat(begin, size) + col]
        for a in range(0, len(own), 512):
            part = slice(a, a + 512)
            graph.links[own[part]] = robust_prune(
                graph.points, own[part], np.concatenate([graph.links[own[part]].astype(np.int64), new[part]], axis=1))


def _bands(lengths: np.ndarray) -> list[int]:
    """Sizes of the bands of lengths that fall."""
    out, start = [], 0
    while start < len(lengths):
        end = int(np.searchsorted(-lengths, -lengths[start] / BAND_RATIO, side="right"))
        out.append(end - start)
        start = end
    return out


def _index_shard(rows: pd.DataFrame) -> pd.DataFrame:
    vectors = np.array(rows["embedding"].tolist(), dtype=np.float64)
    lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    order = np.argsort(-lengths, kind="stable")
    vectors, bands = vectors[order], _bands(lengths[order])
    ids = [np.sort(np.asarray(rows["ids"].iloc[i], dtype=np.int64)) for i in order]
    links, entries, at = [], [], 0
    for size in bands:
        graph = build_graph(vectors[at:at + size]) if size > SCANNED else None
        links.append(graph.links.tobytes() if graph else b"")
        entries.append(graph.entries if graph else np.zeros(0, np.int64))
        at += size
    return pd.DataFrame([{
        "shard": int(rows["shard"].iloc[0]), "dim": vectors.shape[1], "n": len(vectors), "vectors": vectors.tobytes(),
        "bands": np.array(bands, np.int32), "links": b"".join(links), "entries": np.concatenate(entries).astype(np.int32),
        "entry_counts": np.array([len(e) for e in entries], np.int32), "ids": np.concatenate(ids),
        "id_counts": np.array([len(x) for x in ids], np.int32)}])


class Best:
    """The best k ids of one query so far."""

    def __init__(self, query: int, k: int):
        self.query, self.k, self.ids, self.scores = query, k, np.zeros(0, np.int64), np.zeros(0)

    def reaches(self, bound: float) -> bool:
        """A node of that score would be among the best."""
        return len(self.ids) < self.k or bound >= self.scores[-1]

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = ids != self.query
        ids, scores = np.concatenate([self.ids, ids[keep]]), np.concatenate([self.scores, scores[keep]])
        top = np.lexsort((ids, -scores))[:self.k]
        self.ids, self.scores = ids[top], scores[top]


def search_shard(shard: dict, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """The shard's best k for each query, with exact scores."""
    vectors = np.frombuffer(shard["vectors"], dtype=np.float64).reshape(shard["n"], shard["dim"])
    counts = np.asarray(shard["id_counts"], dtype=np.int64)
    ids, begins = np.asarray(shard["ids"], dtype=np.int64), np.cumsum(counts) - counts
    size = np.sqrt(np.einsum("ij,ij->i", queries, queries))
    best = [Best(int(q), k) for q in query_ids]
    at = links_at = entries_at = 0
    for rows, n_entries in zip(shard["bands"], shard["entry_counts"]):
        own = vectors[at:at + rows]
        longest = float(np.sqrt(np.einsum("ij,ij->i", own[:1], own[:1])[0]))
        # A little above the bound, as the scores themselves are rounded.
        live = np.flatnonzero([b.reaches(longest * s * (1 + 1e-9)) for b, s in zip(best, size)])
        if n_entries:
            links = np.frombuffer(shard["links"], dtype=np.int32, count=rows * DEGREE, offset=4 * links_at).reshape(rows, DEGREE)
            graph = Graph(levelled(own), links, np.asarray(shard["entries"][entries_at:entries_at + n_entries], dtype=np.int64))
            # Scaled to the points' length, a query ranks points by distance as by inner product.
            targets = np.hstack([queries[live] / size[live, None] * longest, np.zeros((len(live), 1))]).astype(np.float32)
            found = graph.beam_search(targets, max(SEARCH_BEAM, 2 * k))[0] if len(live) else []
            links_at, entries_at = links_at + rows * DEGREE, entries_at + n_entries
        else:
            found = np.broadcast_to(np.arange(rows), (len(live), rows))
        for i, nodes in zip(live, found):
            nodes = nodes[nodes >= 0]
            score = (own[nodes] * queries[i]).sum(axis=1)
            order = np.argsort(-score, kind="stable")
            order = order[score[order] >= score[order[min(k, len(order) - 1)]]]  # k + 1 and ties: one may be the query itself
            nodes, score = nodes[order] + at, score[order]
            each = counts[nodes]
            members = ids[np.repeat(begins[nodes], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
            best[i].add(members, np.repeat(score, each))
        at += rows
    return pd.DataFrame({"query_id": np.repeat(query_ids, [len(b.ids) for b in best]),
                         "vec_id": np.concatenate([b.ids for b in best] or [np.zeros(0, np.int64)]),
                         "score": np.concatenate([b.scores for b in best] or [np.zeros(0)])})


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                queries = np.array(one["queries"], dtype=np.float64)
                found = search_shard(one, np.array(one["query_ids"], dtype=np.int64), queries, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found["query_id"].to_numpy(np.int64)), pa.array(found["vec_id"].to_numpy(np.int64)),
                     pa.array(found["score"].to_numpy(np.float64))], names=["query_id", "vec_id", "score"])
    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part."""
    v = F.col("embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return (vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("embedding"))
            .filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite)
                    & F.exists(v, lambda x: x != 0)))


def build_index(rows: DataFrame, k: int = 20) -> DataFrame:
    """One row per shard, written to the shared folder."""
    # A query may be one of its vector's ids, so k + 1 of them suffice. Ranks are bounded before the shuffle.
    smallest = (rows.distinct().withColumn("_r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id")))
                .filter(F.col("_r") <= k + 1))
    nodes = materialize(smallest.groupBy("embedding").agg(F.collect_list("vec_id").alias("ids")), "nodes")
    shards = max(1, -(-nodes.count() // SHARD_ROWS))
    placed = nodes.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int"))
    return materialize(
        placed.select("shard", F.size("embedding").alias("length"), "embedding", "ids")
        .groupBy("shard", "length").applyInPandas(lambda pdf: _index_shard(pdf), _SHARD), "shards")


def search(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by `every`."""
    rows = materialize(usable(vectors, id_col, vector_col), "vectors")
    index = build_index(rows, k)
    queries = rows.filter(F.col("vec_id") % every == 0).distinct()
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    grouped = (queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
               .groupBy("block", F.size("embedding").alias("dim"))
               .agg(F.collect_list(F.struct("vec_id", "embedding")).alias("q")))
    places = index.select("shard", "dim")
    # Every block meets every shard, as the search asks: both sides are a row per block and per shard.
    tasks = grouped.join(places, "dim").repartition("block", "shard").join(index, ["shard", "dim"])
    found = tasks.select(
        "shard", "dim", "n", "vectors", "bands", "links", "entries", "entry_counts", "ids", "id_counts",
        F.col("q.vec_id").alias("query_ids"), F.col("q.embedding").alias("queries")).mapInArrow(_searched(k), _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
