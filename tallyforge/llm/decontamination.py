"""Benchmark decontamination by a distributed positional inverted index.

`index` turns documents into postings: a row for each term (64-bit hash of a word) and block of documents (about BLOCK_BYTES of text), with the
positions as one array, and a row for each block with its documents. All tokens are indexed, whatever is searched; the index is a table in
the shared folder. `search` never sends items to all blocks: the items' distinct windows are a table, their terms are joined to the index,
a window with a term that occurs nowhere is done, and of every other window the rarest term's rows say which blocks to
ask. In a block the lists of a window's terms, less their offsets, are intersected from the rarest on, exactly or within a slop.
Windows that occur in the same items are a class, so a passage that many items share is one row until the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.shared import LOWER, blocks, prefix_sums, read, span_hashes, staged, texts, word_spans, word_table

WINDOW = 10
#: Words: runs of bytes other than these, after lower-casing A-Z.
BETWEEN = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
TABLE = word_table(BETWEEN)
#: Unused positions between two documents; a slop stays below it. Text of a block of documents; windows that one row asks for.
GAP, BLOCK_BYTES, ASKED = 64, 1 << 23, 500
#: term and the rest of the postings, or (term null) the documents of a block.
INDEX = "block long, term long, n long, at binary, doc_ids array<long>, n_words array<long>"


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word."""
    low = LOWER[data]
    start, end, row = word_spans(low, offsets, TABLE)
    return span_hashes(prefix_sums(low), start, end), row


def index(docs: DataFrame) -> DataFrame:
    """The index of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting, size = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            ids = [x for w in waiting for x in w[0]]
            n_words = np.concatenate([w[2] for w in waiting])
            term = np.concatenate([w[1] for w in waiting])
            at = np.arange(len(term), dtype=np.int64) + np.repeat(np.arange(len(ids)), n_words) * GAP
            order = np.argsort(term, kind="stable")
            term, at = term[order], at[order].astype("<i8" if len(at) and at[-1] >> 31 else "<i4")
            new = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
            edge = np.r_[new, len(term)]
            for a in range(0, len(new), 50_000):
                z = min(len(new), a + 50_000)
                own = at[edge[a] : edge[z]]
                where = pa.py_buffer(((edge[a : z + 1] - edge[a]) * at.itemsize).astype(np.int32))
                postings = pa.Array.from_buffers(pa.binary(), z - a, [None, where, pa.py_buffer(own)])
                arrays = [pa.array(np.full(z - a, number)), pa.array(term[new[a:z]].view(np.int64)), pa.array(np.diff(edge[a : z + 1])), postings, pa.nulls(z - a, pa.list_(pa.int64())), pa.nulls(z - a, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=NAMES)
            arrays = [pa.array([number]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([n_words], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=NAMES)

        for b in batches:
            for first, end, data, offsets in blocks(b.column(1)):
                term, row = words(data, offsets)
                waiting.append((b.column(0).slice(first, end - first).to_pylist(), term, np.bincount(row, minlength=end - first)))
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield from send()
                    waiting, size, number = [], 0, number + 1
        if waiting:
            yield from send()

    return staged(texts(docs).mapInArrow(run, INDEX), "index")


NAMES = ["block", "term", "n", "at", "doc_ids", "n_words"]


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """window (a hash), terms, item_id: all windows of size consecutive words of each item (item_id, text); one with fewer words, but not none, is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                term, _ = words(raw, np.array([0, len(raw)], np.int64))
                k = min(size, len(term))
                if k:
                    rows = np.unique(np.lib.stride_tricks.sliding_window_view(term.view(np.int64), k), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.int64())), pa.array(np.full(len(rows), item))], names=["terms", "item_id"])

    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL")
    found = own.mapInArrow(run, "terms array<long>, item_id long")
    return staged(found.select(F.xxhash64("terms").alias("window"), "terms", "item_id").distinct(), "windows")


def intersect(terms: np.ndarray, counts: np.ndarray, at: np.ndarray, wanted: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of each occurrence of the wanted windows in a block; with slop each later term may stand so far from its place."""
    none = np.zeros(0, np.int64)
    if not len(terms) or not len(wanted):
        return none, none
    number = np.searchsorted(terms, wanted)
    number[number == len(terms)] = 0
    alive = np.flatnonzero((terms[number] == wanted).all(axis=1))
    if not len(alive):
        return none, none
    number, ends = number[alive], np.cumsum(counts)
    order = np.argsort(counts[number], axis=1, kind="stable")  # rarest first
    keys = np.repeat(np.arange(len(terms), dtype=np.int64) << 40, counts) + at  # sorted
    rarest = np.take_along_axis(number, order[:, :1], 1)[:, 0]
    n = counts[rarest]
    who = np.repeat(np.arange(len(alive)), n)
    inner = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    place = at[(ends[rarest] - n)[who] + inner] - order[who, 0]
    who, place = who[place >= 0], place[place >= 0]
    for k in range(1, wanted.shape[1]):
        offset = order[who, k]
        key = (number[who, offset] << 40) + place + offset
        found = np.searchsorted(keys, key - slop)
        found[found == len(keys)] = 0
        good = (keys[found] >= key - slop) & (keys[found] <= key + slop)
        who, place = who[good], place[good]
    return alive[who], place


def stretches(indexed: DataFrame, found: DataFrame, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """block, row (in the block), doc_id, class, start, end: the stretches of each document's words that windows of a class cover; and class, item_id.

    found has the rows of windows(). Windows of a class occur in the same items.
    """
    # a class is named by one of its windows; item sets are compared by two sums of hashes and their size
    digest = F.struct(F.count("*"), F.sum(F.shiftright(F.xxhash64("item_id"), 8)), F.bit_xor(F.xxhash64("item_id", F.lit(1))))
    per_window = found.groupBy("window").agg(digest.alias("items"), F.first("terms").alias("terms"))
    named = per_window.groupBy("items").agg(F.min("window").alias("class"))
    distinct = staged(per_window.join(named, "items").select("window", "class", "terms"), "classes")
    members = found.join(named.select(F.col("class").alias("window")), "window").select(F.col("window").alias("class"), "item_id")

    each = distinct.select("window", F.posexplode("terms").alias("pos", "term"))
    own = staged(indexed.where("term IS NOT NULL").join(each.select("term").distinct(), "term").select("block", "term", "n", "at"), "postings")
    counts = own.groupBy("term").agg(F.sum("n").alias("total"))
    # the rarest term of each window all of whose terms occur
    rarest = each.join(counts, "term", "left").groupBy("window").agg(F.count_if(F.col("total").isNull()).alias("absent"), F.min_by("term", F.struct("total", "pos")).alias("term")).where("absent = 0")
    asked = staged(distinct.join(rarest.select("window", "term"), "window"), "asked")
    per_term = asked.groupBy("term").agg(F.ceil(F.count("*") / ASKED).alias("rows"))
    lists = asked.join(per_term, "term").groupBy("term", F.pmod(F.xxhash64("window"), F.col("rows")).alias("part")).agg(F.collect_list(F.struct("class", "terms")).alias("asked"))
    asks = own.select("block", "term").join(lists.select("term", "asked"), "term").select(F.col("block").alias("asked_block"), "asked")
    documents = indexed.where("term IS NULL").select("block", "doc_ids", "n_words")
    lists_of = own.select("block", "term", "n", "at").unionByName(documents, allowMissingColumns=True)

    def meet(block: pa.Table, asks: pa.Table) -> pa.Table:
        wanted: dict[int, list] = {}
        for row in asks.column("asked").to_pylist():
            for w in row:
                wanted.setdefault(len(w["terms"]), []).append((w["class"], w["terms"]))
        docs = block.filter(pc.is_null(block.column("term")))
        ids, n_words = (docs.column(c).to_pylist()[0] if len(docs) else [] for c in ("doc_ids", "n_words"))
        block_terms = block.filter(pc.is_valid(block.column("term")))
        terms = block_terms.column("term").to_numpy().view(np.uint64)
        order = np.argsort(terms)
        terms, counts = terms[order], block_terms.column("n").to_numpy()[order]
        raw = block_terms.column("at").to_pylist()
        at = np.concatenate([np.frombuffer(raw[i], "<i4" if len(raw[i]) == 4 * n else "<i8") for i, n in zip(order.tolist(), counts.tolist(), strict=True)]).astype(np.int64) if len(terms) else np.zeros(0, np.int64)
        first = np.cumsum(np.r_[0, np.array(n_words[:-1], np.int64)]) + np.arange(max(1, len(ids))) * GAP
        hits = [np.zeros((3, 0), np.int64)]
        for k, rows in wanted.items():
            matrix, kind = np.array([t for _, t in rows], np.int64).view(np.uint64), np.array([c for c, _ in rows], np.int64)
            for step in range(0, len(rows), 2_000):
                window, place = intersect(terms, counts, at, matrix[step : step + 2_000], slop)
                hits.append(np.stack([kind[step + window], place, place + k]))
        kind, start, end = np.concatenate(hits, axis=1)
        row = np.searchsorted(first, start, side="right") - 1
        order = np.lexsort((start, kind, row))
        kind, start, end, row = kind[order], start[order], end[order], row[order]
        if len(row):
            # runs of overlapping windows of one class in one document become one stretch; the furthest end so far starts anew with each
            other = (kind[1:] != kind[:-1]) | (row[1:] != row[:-1])
            lift = np.cumsum(np.r_[False, other]) * (end.max() + 1)
            new = np.flatnonzero(np.r_[True, other | (start[1:] > (np.maximum.accumulate(end + lift) - lift)[:-1])])
            row, kind, start, end = row[new], kind[new], start[new], np.maximum.reduceat(end, new)
        number = block.column("block")[0].as_py() if len(block) else 0
        doc = pa.array(ids, pa.int64()).take(pa.array(row))
        return pa.table({"block": pa.array(np.full(len(row), number)), "row": pa.array(row), "doc_id": doc, "class": pa.array(kind), "start": pa.array(start - first[row]), "end": pa.array(end - first[row])})

    hits = asks.groupBy("asked_block").cogroup(lists_of.groupBy("block")).applyInArrow(lambda a, b: meet(b, a) if len(a) else meet(b.slice(0, 0), a), "block long, row long, doc_id long, class long, start long, end long")
    return staged(hits, "hits"), members


def search(indexed: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = 0) -> DataFrame:
    """block, row (in the block), doc_id, item_id, start, end: the stretches of each document's words (from 0) that windows of an item (item_id, text) cover.

    With slop > 0 a window's terms may stand up to slop words from their places (proximity); 0 is the exact phrase.
    """
    if slop >= GAP:
        raise ValueError(f"slop must be below {GAP}")
    hits, members = stretches(indexed, windows(items, size), slop)
    each = hits.join(members, "class")
    # stretches of several classes of one item are joined where they overlap or touch
    own = W.partitionBy("block", "row", "item_id").orderBy("start", "end")
    reached = F.max("end").over(own.rowsBetween(W.unboundedPreceding, -1))
    island = each.withColumn("new", F.when(F.col("start") <= reached, 0).otherwise(1)).withColumn("island", F.sum("new").over(own))
    return island.groupBy("block", "row", "doc_id", "item_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs (doc_id, text).

    A word is hit if any occurrence of a window of an item covers it. Null and empty texts have no words; repeated rows give a
    row each; a null item_id is left out, repeated items count once by id. Without items or documents the result has no hits or
    no rows. Matches are of word hashes of 64 bits.
    """
    indexed = index(docs)
    hits, members = stretches(indexed, windows(benchmark, size))
    # words under the union of a document's stretches: of each stretch what no earlier one has reached
    reached = F.max("end").over(W.partitionBy("block", "row").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(reached, F.lit(0))))
    n_hit = hits.withColumn("fresh", fresh).groupBy("block", "row").agg(F.sum("fresh").alias("n_hit"))
    per_doc = hits.select("block", "row", "class").distinct().join(members, "class").groupBy("block", "row").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    all_docs = indexed.where("term IS NULL").select("block", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("row", "doc")).select("block", F.col("row").cast("long").alias("row"), F.col("doc.doc_ids").alias("doc_id"), F.col("doc.n_words").alias("n_words"))
    joined = all_docs.join(n_hit.join(per_doc, ["block", "row"]), ["block", "row"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    items_text = F.coalesce(F.array_join(F.sort_array("items"), ","), F.lit(""))
    return joined.select("doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(items_text, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
