"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A document's set is its distinct shingles of five words (64-bit hashes). Equal sets are one node from the start, however many documents
have them. A node's sketch has T coordinates: in round i each shingle is hashed to a bin and a value i + fraction, bins keep
their least; after T rounds every round fills one bin for certain, so each coordinate fills and equal coordinates estimate
the Jaccard similarity with concentration. BANDS bands of T / BANDS coordinates make buckets; the star of a bucket (each node to its
least one) keeps it connected in one row per node.

Buckets' connected components are closed worlds: all links lie inside. A node weighs 1 and 1 more for each WEIGHT shingles, so weights
bound bytes. Worlds of at most LIMIT in weight are compared whole in a task: exact on full sets, skipping pairs that are joined already. Larger
ones are cut into blocks by a hash: links inside blocks, then between hubs of the blocks' groups. What is then outside a world's largest
group meets the world block by block; if that is many blocks' worth, only nodes that share a bucket. So a link is found unless no band has caught it (a
similarity of 0.75 escapes all bands with probability 5e-6) and nothing else joins its ends; no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.shared import LOWER, blocks, mixed, prefix_sums, read, span_hashes, staged, texts, word_spans, word_table

SHINGLE, PERCENT, T, BANDS = 5, 75, 128, 32
#: Pairs with a lower estimate aren't compared exactly: about five standard deviations below a similarity of 0.75.
ESTIMATE = 0.5625
#: Weight of nodes that a task compares with each other; of a block of a larger component; shingles that weigh as much as a node.
LIMIT, BLOCK_NODES, WEIGHT = 1000, 400, 512
#: Blocks outside a world's largest group up to which each meets the whole world; more of them meet only what shares a bucket.
FEW = 4
TABLE = word_table(b"\x20\x09\x0a\x0b\x0c\x0d")
SEEDS = np.random.default_rng(20240613).integers(1, 2**63, 2 * T, dtype=np.uint64)
STEP = np.random.default_rng(20240614).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingles of each row; of fewer words than size, the whole sequence as one."""
    low = LOWER[data]
    start, end, row = word_spans(low, offsets, TABLE)
    words = span_hashes(prefix_sums(low), start, end)
    rows = len(offsets) - 1
    edge = np.searchsorted(row, np.arange(rows + 1))
    n = max(0, len(words) - size + 1)
    joined = np.full(n, size, np.uint64)
    for k in range(size):
        joined = joined * STEP[0] + words[k : n + k]
    joined = mixed(joined)
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(joined[a : b - size + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                h = h * STEP[0] + words[k : k + 1]
            out.append(mixed(h))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of T coordinates for each non-empty set: round << 56 | hash."""
    full = np.uint64(2**64 - 1)
    out = np.full((len(sets), T), full)
    if not sets:
        return out
    flat = out.reshape(-1)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    values = np.concatenate(sets)
    for i in range(2 * T):
        if not len(values):
            break
        h = mixed(values ^ SEEDS[i])
        bins = (h & np.uint64(T - 1)).astype(np.int64) if i < T else i - T
        np.minimum.at(flat, owner * T + bins, np.uint64(i << 56 if i < 256 else 255 << 56) | h >> np.uint64(8))
        open_ = (out == full).any(axis=1)
        if not open_.any():
            break
        keep = open_[owner]
        values, owner = values[keep], owner[keep]
    return out


def bands(sketch: np.ndarray) -> np.ndarray:
    """BANDS bucket keys for each row; the band is part of the key."""
    per = T // BANDS
    parts = sketch.reshape(len(sketch), BANDS, per)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * STEP[1]
    for k in range(per):
        key = mixed(key * STEP[2] + parts[:, :, k])
    return key.view(np.int64)


def digest(own: np.ndarray) -> int:
    """64 bits that equal sets share, whatever their order."""
    a, b = np.add.reduce(mixed(own)), np.bitwise_xor.reduce(mixed(own * STEP[3]))
    return int(mixed(np.array([a ^ mixed(np.array([b + np.uint64(len(own))]))[0]]))[0].view(np.int64))


def row_key() -> Column:
    """Never null, and equal for rows that are equal in doc_id and text, null or not."""
    text = F.coalesce(F.concat(F.lit("text "), F.col("text").cast("string")), F.lit("null"))
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), F.lit(" "), text), 256))


def fetch_key() -> Column:
    """By what a row is found again: its doc_id, or without one its text's hash. Rows that share it are told apart by their sets."""
    return F.coalesce("doc_id", F.xxhash64("text"))


def signatures(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, fetch, n_shingles, node (null for empty sets), bands, and if keyed, row_key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in blocks(b.column(1)):
                sets = shingle_sets(data, offsets)
                some = [i for i, s in enumerate(sets) if len(s)]
                keys = bands(sketches([sets[i] for i in some]))
                nodes, lists = [None] * len(sets), [None] * len(sets)
                for k, i in enumerate(some):
                    nodes[i], lists[i] = digest(sets[i]), keys[k]
                own = b.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(lists, pa.list_(pa.int64())), *own.columns[3:]], names=["doc_id", "fetch", "n_shingles", "node", "bands", "row_key"][: 5 + keyed])

    rows = texts(docs).withColumn("fetch", fetch_key())
    rows = rows.withColumn("row_key", row_key()) if keyed else rows
    return rows.mapInArrow(run, "doc_id long, fetch long, n_shingles long, node long, bands array<long>" + ", row_key binary" * keyed)


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, label: one node of the connected component, the same for all its nodes, for all nodes of edges (a, b).

    Each round every node moves to its least neighbour's least neighbour, and the edges are contracted to where their ends
    have moved; loops and repeats go, so edges shrink from round to round. At the end the moves are followed from the last to the first.
    """
    flipped = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    left, moves = staged(flipped(edges), f"{name}-edges"), []
    while not left.isEmpty():
        near = left.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        near = staged(near, f"{name}-near")
        far = near.select(F.col("node").alias("to"), F.col("to").alias("further"))
        moved = staged(near.join(far, "to").select("node", F.col("further").alias("to")), f"{name}-moves")
        moves.append(moved)
        a, b = moved.select(F.col("node").alias("a"), F.col("to").alias("a2")), moved.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        left = staged(flipped(left.where("a < b").join(a, "a").join(b, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))), f"{name}-edges")
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = moves[-1].select("node", F.col("to").alias("label"))
    for moved in moves[-2::-1]:
        last = labels.select(F.col("node").alias("to"), "label")
        labels = staged(moved.join(last, "to", "left").select("node", F.coalesce("label", "to").alias("label")), f"{name}-labels")
    return labels


def links(label: np.ndarray, side: np.ndarray, sets: list[np.ndarray], sketch: np.ndarray) -> list[tuple[int, int]]:
    """(label, label) of links that join different groups among nodes of side 0 and between sides 1 and 2.

    A node is compared with all nodes at once that aren't in its group yet: sizes and sketches first, then exactly, by marking its shingles.
    """
    group, out = label.copy(), []
    size = np.array([len(s) for s in sets], np.int64)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    end = np.cumsum(size)
    first = end - size
    marked = np.zeros(len(shingle), bool)
    index = np.arange(len(sets))
    for i in np.flatnonzero(side < 2).tolist():
        other = index[i + 1 :] if side[i] == 0 else np.flatnonzero(side == 2)
        other = other[(group[other] != group[i]) & (100 * np.minimum(size[other], size[i]) >= PERCENT * np.maximum(size[other], size[i]))]
        if not len(other):
            continue
        other = other[(sketch[other] == sketch[i]).mean(axis=1) >= ESTIMATE]
        if not len(other):
            continue
        own = shingle[first[i] : end[i]]
        marked[own] = True
        n = size[other]
        stop = np.cumsum(n)
        common = np.add.reduceat(marked[shingle[np.repeat(first[other] - (stop - n), n) + np.arange(stop[-1])]].astype(np.int64), stop - n)
        marked[own] = False
        for j in other[100 * common >= PERCENT * (size[other] + size[i] - common)].tolist():
            if group[j] != group[i]:
                out.append((int(label[i]), int(label[j])))
                group[group == group[j]] = group[i]
    return out


def compare(rows: DataFrame, key: str) -> DataFrame:
    """Edges (a, b) between labels, found inside each (key, world) of rows (key, world, node, label, side, shingles, sketch)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.groupby("world", sort=False):
            own = own.drop_duplicates(["node", "side"])
            if len(own) < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in own["shingles"]]
            sketch = np.frombuffer(b"".join(own["sketch"]), np.uint8).reshape(len(own), T)
            out += links(own["label"].to_numpy(np.int64), own["side"].to_numpy(), sets, sketch)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.select(key, "world", "node", "label", "side", "shingles", "sketch").groupBy(key).applyInPandas(run, "a long, b long")


def with_sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen nodes (node, fetch, world, size) with their weight, shingles and one byte of each coordinate of their sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in blocks(b.column(0)):
                sets = shingle_sets(data, offsets)
                own = b.slice(first, end - first)
                nodes = own.column(1).to_pylist()
                good = [i for i, s in enumerate(sets) if len(s) and digest(s) == nodes[i]]
                if good:
                    sketch = sketches([sets[i] for i in good]).astype(np.uint8)
                    kept = own.take(pa.array(good))
                    weight = pa.array([1 + len(sets[i]) // WEIGHT for i in good], pa.int64())
                    arrays = [kept.column(1), kept.column(2), kept.column(3), weight, pa.array([sets[i].tobytes() for i in good], pa.binary()), pa.array([x.tobytes() for x in sketch], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["node", "world", "size", "weight", "shingles", "sketch"])

    joined = texts(docs).withColumn("fetch", fetch_key()).join(chosen.select("node", "fetch", "world", "size"), "fetch").select("text", "node", "world", "size")
    return staged(joined.mapInArrow(run, "node long, world long, size long, weight long, shingles binary, sketch binary"), "sets")


def regroup(labels: DataFrame | None, edges: DataFrame, name: str) -> DataFrame:
    """node, label after edges between labels."""
    new = components(edges, name).select(F.col("node").alias("was"), F.col("label").alias("now"))
    if labels is None:
        return new.select(F.col("was").alias("node"), F.col("now").alias("label"))
    return staged(labels.join(new, F.col("label") == F.col("was"), "left").select("node", F.coalesce("now", "label").alias("label")), name)


def large_worlds(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """node, label inside worlds of more than LIMIT in weight, by the buckets (node, key) of their nodes: blocks, hubs, then what is apart in a bucket."""
    rows = staged(sets.withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK_NODES))).withColumn("key", F.xxhash64("world", "block")), "large")
    own = rows.withColumn("label", F.col("node")).withColumn("side", F.lit(0))
    labels = staged(rows.select("node", "node").toDF("node", "label").distinct(), "large-nodes")
    labels = regroup(labels, staged(compare(own, "key"), "inside"), "large-inside")
    # hubs: of each block's groups the first node by hash, compared in blocks of hubs
    hubs = rows.join(labels, "node").withColumn("n", F.row_number().over(W.partitionBy("key", "label").orderBy(F.xxhash64("node", F.lit(1)), "node"))).where("n = 1")
    per_world = hubs.groupBy("world").agg(F.sum("weight").alias("hubs"))
    hubs = hubs.join(per_world, "world").withColumn("key", F.xxhash64("world", F.pmod(F.xxhash64("node", F.lit(2)), F.ceil(F.col("hubs") / LIMIT))))
    labels = regroup(labels, staged(compare(hubs.withColumn("side", F.lit(0)), "key"), "hubs"), "large-hubs")
    # the rest, exactly: nodes outside their world's largest group
    blocks_ = F.ceil(F.col("size") / BLOCK_NODES)
    placed = staged(rows.dropDuplicates(["node"]).select("node", "world", "weight", "size", "shingles", "sketch").join(labels, "node"), "large-placed")
    groups = placed.groupBy("world", "label").agg(F.sum("weight").alias("n"))
    first = groups.groupBy("world").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.ceil((F.sum("n") - F.max("n")) / BLOCK_NODES).alias("parts")).where("parts > 0")
    outside = placed.join(first, "world").where("label <> largest").select("node", "world", "parts", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).alias("part"), blocks_.alias("blocks"))
    outside = staged(outside, "large-outside")
    if outside.isEmpty():
        return labels
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    # few parts: each meets the whole world, block by block
    a = outside.where(F.col("parts") <= FEW).select("node", "part", upto("blocks").alias("block"))
    world = placed.select("node", "world", F.pmod(F.xxhash64("node"), blocks_).alias("block"))
    b = world.join(first.where(F.col("parts") <= FEW).select("world", "parts"), "world").select("node", upto("parts").alias("part"), "block")
    # many: each meets what shares a bucket with it
    asked = staged(keys.join(outside.where(F.col("parts") > FEW).select("node", "part", "blocks"), "node"), "large-asked")
    met = keys.join(asked.select("key", "blocks").distinct(), "key").select("key", "node", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))
    met = staged(met, "large-met")
    a = a.unionByName(asked.join(met.select("key", "block").distinct(), "key").select("node", "part", "block").distinct())
    b = b.unionByName(met.join(asked.select("key", "part").distinct(), "key").select("node", "part", "block").distinct())
    pairs = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(2)), allowMissingColumns=True).join(placed, "node")
    return regroup(labels, staged(compare(pairs.withColumn("key", F.xxhash64("world", "part", "block")), "key"), "rest"), "large-rest")


def near_duplicates(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and if keyed, row_key() of each row of docs (doc_id, text).

    Documents without words have an empty set and are linked with nothing. Equal sets are linked. Repeated rows each get
    their row; of a doc_id with several texts each row goes by its own text. Documents without doc_id are linked as others are; a
    null is a component's id only if all its documents' ids are null. An empty table gives an empty result; other columns are left out.
    """
    signed = staged(signatures(docs, keyed), "signatures")
    key = ["row_key"] if keyed else []
    found_by = F.coalesce(F.min("doc_id"), F.min("fetch"))
    nodes = staged(signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), found_by.alias("fetch"), (F.min("n_shingles") / WEIGHT).cast("long").alias("more"), F.first("bands").alias("bands")), "nodes")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    stars = keys.join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    worlds = components(stars, "worlds").withColumnRenamed("label", "world").join(nodes.select("node", "fetch", "more"), "node")
    sizes = worlds.groupBy("world").agg(F.sum(F.col("more") + 1).alias("size"))
    sets = with_sets(docs, worlds.join(sizes, "world"))
    small = sets.where(F.col("size") <= LIMIT)
    weight = small.agg(F.sum("weight").alias("n")).collect()[0]["n"] or 0
    groups = max(1, -(-weight // LIMIT))
    small = small.withColumn("key", F.pmod(F.xxhash64("world"), F.lit(groups))).withColumn("label", F.col("node")).withColumn("side", F.lit(0))
    labels = regroup(None, staged(compare(small, "key"), "links"), "small")
    large = sets.where(F.col("size") > LIMIT)
    if not large.isEmpty():
        labels = labels.unionByName(large_worlds(large, keys))
    placed = nodes.select("node", "rep").join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    first = placed.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_node = placed.join(first, "label").select("node", "component_id")
    out = signed.select("doc_id", "n_shingles", "node", *key).join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *key)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
