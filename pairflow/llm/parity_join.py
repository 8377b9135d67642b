"""N-gram Jaccard join by parity sketches.

A text's shingles fall by hash into the chunks of a sketch; a chunk holds the XOR of its shingles' hashes, so
a shingle that one of two sets lacks changes one chunk at most. Two sets of sizes a <= b and Jaccard
similarity t or more differ in at most (a + b)(1 - t)/(1 + t) shingles, which is at most a(1 - t)/t as b <= a/t.
Of any order of all chunk values, the same for all sets, a set's first D + 1 (D: that bound for its own size)
hold one in common with each linked set, by the pigeonhole. The number of chunks belongs to a size band; a set near
the lower end of its band also enters the band below, where its smaller partners are.

The order is that of rarity: chunk values are counted, and a set looks for partners under its D + 1 rarest. There are
half as many chunks again as needed or so, so a set whose greater part is found nowhere else sends nothing, and a passage
that very many otherwise different texts share makes no candidates.

Pairs are searched in two steps. First every chunk value links its sets to two of them (the hub, which looks under
most values and so has least of its own, and the largest key), which is linear; what is left are sets of different
components that share a chunk value, and these are compared all with all under the Hamming test of parity sketches.
A group of near copies shares very many chunk values, but they have few pairs of hub and largest key: sets meet once
under such a pair and not once under each value. No link that joins two components is lost; links inside a
component need no second witness. Every pair that passes is verified on the shingle sets. Shingles are compared by
64-bit hash.

Results for odd input: null or blank texts and texts without words have size 0 and no links; texts of 1 to 4
words have one shingle; rows with the same shingle set form one class, so repeated rows share a component; a
null id takes part in links, and component_id is the smallest id that is not null (null if there is none).
Only the two named columns are read, others may have any name.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairflow.llm import bloom, keys, textkit, worker
from pairflow.llm.graph import components
from pairflow.workspace import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FOLDS = 8
FOLD_NAMES = [f"f{i}" for i in range(FOLDS)]
# Keys that may be sent to every task (8 MB); more are matched by a shuffle join.
BROADCAST_KEYS = 1_000_000
# Sets of this size on also have a sketch of 4096 bits, as 512 are too few to tell long texts apart: at 400 shingles they
# let similarities from 0.76 on pass for 0.8.
WIDE_FROM, WIDE_BITS = 256, 4096
# Most chunk values belong to one set, so the counts of a task hold nearly every value it reads: a task reads so many
# bytes of profiles (half a million values), and profiles are stored in row groups of as many.
COUNTED_BYTES = 4 << 20
PROFILE = "doc_id long, n_shingles long, node long, sigs array<long>, sizes array<long>, needs array<long>, wide array<long>, " + ", ".join(f"{f} long" for f in FOLD_NAMES)


def max_difference(n: int, percent: int) -> int:
    """Largest symmetric difference of a set of n shingles and any linked set that is not smaller."""
    return n * (100 - percent) // percent


def chunk_count(band: int, percent: int) -> int:
    """Chunks of a band's sketches: enough for its largest sets to fill half as many again as max_difference + 1 or so.

    A set of n shingles leaves a share exp(-n / chunks) of the chunks empty; sets that fill too few chunks look under
    all of them and under their single shingles.
    """
    return max(8, int(1.7 * (max_difference(2 ** (band + 1), percent) + 1)))


def signatures(shingles: np.ndarray, percent: int) -> list[tuple[np.ndarray, int]]:
    """Lists of chunk values, and of how many of each list, the rarest, a set looks for partners under; shingles are
    sorted and distinct."""
    n = len(shingles)
    band = n.bit_length() - 1
    bands = [band]
    if band and (2 ** band - 1) * 100 >= n * percent:  # partners may be in the band below
        bands.append(band - 1)
    need = max_difference(n, percent) + 1
    out = []
    for b in bands:
        chunks = chunk_count(b, percent)
        mixed = textkit.mix(shingles ^ np.uint64(0x5851F42D4C957F2D * (b + 1) % 2**64))
        place = (mixed % np.uint64(chunks)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        used, first = np.unique(place[order], return_index=True)
        values = np.bitwise_xor.reduceat(mixed[order], first)
        keys = textkit.mix(values + (used.astype(np.uint64) << np.uint64(8)) + np.uint64(b))
        out.append((keys, min(need, len(keys))))
        if len(keys) < need:
            out.append((textkit.mix(mixed + np.uint64(0x2545F4914F6CDD1D)), min(need, n)))
    return out


def folded_sketch(shingles: np.ndarray, size: int = 64 * FOLDS) -> np.ndarray:
    """Parity bits (a power of two), 64 in a number; the Hamming distance of two sketches is at most their sets'
    symmetric difference."""
    place = textkit.mix(shingles) >> np.uint64(65 - size.bit_length())
    bits = np.bincount(place.astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def node_key(shingles: np.ndarray) -> int:
    """Key of a shingle set: 64 bits of a digest."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _profiles(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # sets whose signatures this task has sent, so that copies send them once
        for whole in batches:
            lengths = [0 if n is None else n for n in pa.compute.binary_length(whole.column(1)).to_pylist()]
            for a, b in textkit.slices(lengths):
                yield profiled(whole.slice(a, b - a), seen)
        worker.trim()

    def profiled(batch: pa.RecordBatch, seen: set[int]) -> pa.RecordBatch:
        ids, texts = batch.column(0), textkit.text_bytes(batch.column(1))
        sizes, nodes, sigs, lists, needs, folds, wide = [], [], [], [], [], [], []
        for shingles in textkit.shingle_sets(texts):
            sizes.append(len(shingles))
            if not len(shingles):
                for column in (nodes, sigs, lists, needs, wide):
                    column.append(None)
                folds.append(np.zeros(FOLDS, np.int64))
                continue
            key = node_key(shingles)
            nodes.append(key)
            folds.append(folded_sketch(shingles))
            wide.append(folded_sketch(shingles, WIDE_BITS) if len(shingles) >= WIDE_FROM else None)
            own = None if key in seen else signatures(shingles, percent)
            sigs.append(None if own is None else np.concatenate([k for k, _ in own]).view(np.int64))
            lists.append(None if own is None else [len(k) for k, _ in own])
            needs.append(None if own is None else [need for _, need in own])
            if len(seen) < 5_000_000:
                seen.add(key)
        planes = np.array(folds, dtype=np.int64).reshape(len(sizes), FOLDS)
        return pa.RecordBatch.from_arrays(
            [ids.cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
             pa.array(sigs, pa.list_(pa.int64())), pa.array(lists, pa.list_(pa.int64())),
             pa.array(needs, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64()))] + [pa.array(planes[:, i].copy()) for i in range(FOLDS)],
            names=["doc_id", "n_shingles", "node", "sigs", "sizes", "needs", "wide"] + FOLD_NAMES)
    return run


def _held_by(held):
    """(node, list, spare, sig): the chunk values that a Bloom filter of shared ones may hold, of lists that can't make
    do with the others; spare: how many of a list are not needed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = textkit.numbers(batch.column(1).flatten())
            sizes, needs = (textkit.numbers(batch.column(i).flatten()).astype(np.int64) for i in (2, 3))
            lists = textkit.numbers(batch.column(2).value_lengths()).astype(np.int64)
            node = np.repeat(textkit.numbers(batch.column(0)), lists)
            number = np.arange(len(node)) - np.repeat(np.cumsum(lists) - lists, lists)
            own = np.repeat(np.arange(len(sizes)), sizes)
            maybe = bloom.contains(held.value, values.view(np.uint64))
            spare = sizes - needs
            keep = np.flatnonzero(maybe & (np.bincount(own[maybe], minlength=len(sizes)) > spare)[own])
            own = own[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[own]), pa.array(number[own]), pa.array(spare[own]), pa.array(values[keep])],
                names=["node", "list", "spare", "sig"])
    return run


def _sets_of(wanted):
    """(node, shingles) once per task, of the wanted nodes or of all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = None if wanted is None else set(wanted.value.tolist())
        seen: set[int] = set()
        for whole in batches:
            lengths = [0 if n is None else n for n in pa.compute.binary_length(whole.column(0)).to_pylist()]
            for a, b in textkit.slices(lengths):
                nodes, sets = [], []
                for shingles in textkit.shingle_sets(textkit.text_bytes(whole.column(0).slice(a, b - a))):
                    key = node_key(shingles) if len(shingles) else None
                    if key is None or key in seen or (keys is not None and key not in keys):
                        continue
                    if len(seen) < 5_000_000:
                        seen.add(key)
                    nodes.append(key)
                    sets.append(shingles.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])
        worker.trim()
    return run


def _near(a: str, b: str, percent: int):
    """Sizes and folded sketches of columns prefixed a and b allow a link."""
    na, nb = F.col(f"{a}_n"), F.col(f"{b}_n")
    sizes = (100 * F.least(na, nb) >= percent * F.greatest(na, nb))
    hamming = sum(F.bit_count(F.col(f"{a}_{f}").bitwiseXOR(F.col(f"{b}_{f}"))) for f in FOLD_NAMES)
    return sizes & ((100 + percent) * hamming <= (100 - percent) * (na + nb))


def _near_long(a: str, b: str, percent: int):
    """Sketches of long texts, in columns prefixed a and b, allow a link; always true of shorter ones."""
    hamming = F.aggregate(F.zip_with(f"{a}_w", f"{b}_w", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    apart = (100 + percent) * hamming > (100 - percent) * (F.col(f"{a}_n") + F.col(f"{b}_n"))
    return ~F.coalesce(apart, F.lit(False))


def _near_wide(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that the sketches of long texts allow as well."""
    side = lambda p: classes.select(F.col("node").alias(p), F.col("n_shingles").alias(f"{p}_n"), F.col("wide").alias(f"{p}_w"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_near_long("a", "b", percent)).select("a", "b")


def _prefixed(classes: DataFrame, p: str, *more) -> DataFrame:
    return classes.select(F.col("node").alias(p), F.col("n_shingles").alias(f"{p}_n"),
                          *[F.col(f).alias(f"{p}_{f}") for f in FOLD_NAMES], *more)


def _verified(texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    spark = texts.sparkSession
    nodes = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "candidates")
    if nodes.count() <= BROADCAST_KEYS:
        wanted = spark.sparkContext.broadcast(np.sort(textkit.numbers(nodes.toArrow().column(0))))
        sets = texts.mapInArrow(_sets_of(wanted), "node long, shingles array<long>")
    else:
        sets = texts.mapInArrow(_sets_of(None), "node long, shingles array<long>").join(nodes, "node", "left_semi")
    sets = materialize(sets.dropDuplicates(["node"]), "sets")
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"))
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb") - common).alias("united")).filter(
        100 * F.col("common") >= percent * F.col("united")).select("a", "b", "common", "united")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs; see the module's text."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    with worker.batches_of(docs.sparkSession):  # what runs later needs no Python
        return _joined(docs, id_col, text_col, percent)


def _joined(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    with worker.row_groups_of(spark, COUNTED_BYTES):
        profiles = materialize(
            docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(_profiles(percent), PROFILE), "profiles")
    classes = materialize(profiles.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("wide").alias("wide"),
        *[F.first(f).alias(f) for f in FOLD_NAMES]), "classes")

    # Counts combine before the shuffle, so a chunk value that a third of the sets have is a row per task.
    with worker.tasks_of(spark, COUNTED_BYTES):
        counts = materialize(profiles.filter("sigs IS NOT NULL").select(F.explode("sigs").alias("sig")).groupBy("sig").agg(
            F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
    # Most chunk values belong to one set; a filter of the others keeps them out of the next shuffle.
    held = spark.sparkContext.broadcast(bloom.build(counts, "sig", bloom.bits_for(counts.count())))
    found_in = (profiles.filter("sigs IS NOT NULL").select("node", "sigs", "sizes", "needs")
                .mapInArrow(_held_by(held), "node long, list long, spare long, sig long"))
    # A set's shared values, rarest first, without as many of the commonest as it can spare.
    looked = (found_in.join(counts, "sig").groupBy("node", "list").agg(
        F.sort_array(F.collect_set(F.struct("n", "sig"))).alias("s"), F.first("spare").alias("spare"))
        .withColumn("k", (F.size("s") - F.col("spare")).cast("int")).filter("k > 0")
        .select("node", "k", F.explode(F.slice("s", F.lit(1), F.col("k"))).alias("s"))
        .groupBy("node", "s.sig").agg(F.max("k").alias("k")))
    looked = materialize(looked, "looked")
    hubs = looked.groupBy("sig").agg(
        F.min(F.struct(-F.col("k"), "node"))["node"].alias("hub"), F.min("node").alias("low"), F.max("node").alias("high")).filter(
        "low <> high").select("sig", "hub", F.when(F.col("high") == F.col("hub"), F.col("low")).otherwise(F.col("high")).alias("far"))
    shared = materialize(looked.select("node", "sig").join(hubs, "sig"), "shared")
    stars = shared.select("node", F.explode(F.array("hub", "far")).alias("hub")).filter("node <> hub").select(
        F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    near = (stars.join(_prefixed(classes, "a"), "a").join(_prefixed(classes, "b"), "b")
            .filter(_near("a", "b", percent)).select("a", "b"))
    candidates = materialize(_near_wide(near, classes, percent), "pairs")
    links = materialize(_verified(texts, candidates, percent), "verified")
    found = components(links)

    # Sets of different components that share a chunk value: all of them, under the sketch test. A value's hub and far
    # set stand for it, so those that share many values meet once or a few times.
    with_component = (shared.join(found, "node", "left")
                      .select("sig", "hub", "far", "node", F.coalesce("component", "node").alias("component")))
    mixed = with_component.groupBy("sig").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("sig")
    open_rows = materialize(
        with_component.join(mixed, "sig", "left_semi").select("hub", "far", "node", "component").distinct(), "open")
    side = {p: open_rows.withColumnRenamed("component", f"{p}_c").join(
        _prefixed(classes, p, F.col("wide").alias(f"{p}_w")).withColumnRenamed(p, "node"), "node").withColumnRenamed("node", p)
        for p in "ab"}
    rest = (side["a"].join(side["b"], (side["a"].hub == side["b"].hub) & (side["a"].far == side["b"].far)
                           & (F.col("a") < F.col("b")) & (F.col("a_c") != F.col("b_c"))
                           & _near("a", "b", percent) & _near_long("a", "b", percent))
            .select("a", "b").distinct())
    more = materialize(rest.join(candidates, ["a", "b"], "left_anti"), "rest")
    links = links.unionByName(_verified(texts, more, percent))
    found = components(links)

    grouped = classes.select("node", "first_id").join(found, "node", "left").select(
        "node", "first_id", F.coalesce("component", "node").alias("component"))
    grouped = materialize(grouped, "grouped")
    smallest = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_node = grouped.join(smallest, "component").select("node", "component_id")
    return (profiles.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """docs with the row of the smallest id of every component; rows without links and rows with a null id stay."""
    dropped = join(docs, id_col, text_col, percent).filter("doc_id <> component_id").select("doc_id")
    return keys.without(docs, dropped, id_col)
