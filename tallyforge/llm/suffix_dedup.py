"""Removal of repeated passages by suffix arrays: every byte under a SPAN-byte string that also starts elsewhere.

1. Texts get a row number and go to a table bucketed by it, so that later steps bring small requests to texts and shuffle texts no more.
2. Each SPAN-byte window chooses an anchor, its least-hashed GRAM-byte string; equal windows choose equal anchors. A run of windows with
   one anchor is a piece. Equal pieces are counted together (before they are shuffled, too); a piece whose anchor occurs nowhere else
   holds no repeated window. Of every other distinct piece the bytes of one occurrence are fetched.
3. Pieces are dealt to shards by anchor; an anchor with very many distinct pieces is dealt to several shards by content, and one that a
   sample of rows shows to be frequent is dealt by content from the start, so that no task gets all its pieces.
   Each shard builds the suffix array of its pieces by Larsson-Sadakane refinement (ranks by 8 bytes, then doubling, only groups
   that aren't sorted yet), and Kasai's common prefixes between neighbours: a window is repeated if it shares SPAN bytes
   with a neighbour, or its piece occurs twice.
4. Shards that share an anchor are merged: each gives its distinct windows once, in sorted runs cut into ranges (a row for each shard
   and range), and a binary search in the union of the runs finds windows that start in two shards.
5. Each piece's covered stretches are merged into one row. A chunk of texts asks once for each of its distinct pieces (what asks for
   frequent ones is dealt over several tasks); its answers come back together as one row for each text, and go to the texts by row number.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.shared import blocks, mixed, powers, prefix_sums, read, shared_dir, short_batches, span_hashes, staged

SPAN, GRAM = 200, 32
#: Bytes of a shard; distinct pieces of an anchor beyond which it is dealt to several shards.
SHARD_BYTES, HOT = 1 << 20, 1500
#: One of so many rows is looked at for frequent anchors; at most so many anchors or pieces are listed as frequent. No result depends on either list.
SAMPLED, LISTED = 32, 1000
#: Windows of a range in the merge of shards.
RANGE = 200_000
#: Pieces of a chunk of texts, which a task sorts together before it sends them on.
TOGETHER = 250_000
#: Bytes of pieces that a task brings to the shards at once.
BROUGHT = 1 << 23
LOW = np.uint64((1 << 24) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i, by running minima from both ends of blocks."""
    n = len(x) - width + 1
    y = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(y, axis=1).reshape(-1)
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, anchor, content, start (in the row) and number of windows of each piece."""
    if len(data) < SPAN:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    sums = prefix_sums(data)
    n_grams = len(data) - GRAM + 1
    h = mixed((sums[GRAM:] - sums[:-GRAM]) * powers(len(sums))[1][:n_grams])
    # 40 bits of hash, then the place, so that of equal grams in a window the first is chosen
    least = sliding_min((h & ~LOW) | (np.arange(n_grams, dtype=np.uint64) & LOW), SPAN - GRAM + 1)
    s = np.arange(len(least))
    anchor = s + (((least & LOW).astype(np.int64) - s) & int(LOW))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(s)]
    inside = s + SPAN <= offsets[row + 1]
    new = np.flatnonzero(inside & np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    end = np.minimum(np.r_[new[1:], len(s)], offsets[row[new] + 1] - SPAN + 1)
    return row[new], h[anchor[new]].view(np.int64), span_hashes(sums, new, end + SPAN - 1).view(np.int64), new - offsets[row[new]], end - new


def occurrences(table: DataFrame, where: bool) -> DataFrame:
    """Equal pieces of a chunk of texts once (TOGETHER pieces at most, about): anchor, content, row and at (start << 16 | windows) of the first, and

    k, their number; or, with where, the chunk's number and more, the rest as row, at, row, at ...
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n, chunk = [], 0, TaskContext.get().partitionId() << 32

        def send() -> pa.RecordBatch:
            anchor, content, row, at = (np.concatenate(x).astype(np.int64) for x in zip(*waiting, strict=True))
            order = np.lexsort((at, row, content, anchor))
            anchor, content, row, at = (x[order] for x in (anchor, content, row, at))
            new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])]) if len(order) else order
            size = np.diff(np.r_[new, len(order)])
            if where:
                rest = np.ones(len(order), bool)
                rest[new] = False
                more = pa.ListArray.from_arrays(pa.array(np.r_[0, 2 * np.cumsum(size - 1)].astype(np.int32)), pa.array(np.stack([row[rest], at[rest]], axis=1).reshape(-1)))
                extra = [pa.array(np.full(len(new), chunk)), more]
            else:
                extra = [pa.array(size)]
            return pa.RecordBatch.from_arrays([*(pa.array(x[new]) for x in (anchor, content, row, at)), *extra], names=["anchor", "content", "row", "at", *(["chunk", "more"] if where else ["k"])])

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for first, _, data, offsets in blocks(b.column(1)):
                row, anchor, content, start, windows = pieces(data, offsets)
                waiting.append((anchor, content, ids[first + row], start << 16 | windows))
                n += len(row)
                if n >= TOGETHER:
                    yield send()
                    waiting, n, chunk = [], 0, chunk + 1
        if n:
            yield send()

    return table.select("row", "text").mapInArrow(run, "anchor long, content long, row long, at long, " + ("chunk long, more array<long>" if where else "k long"))


def suffix_order(x: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of x, its ranks and the 8 bytes at each place; a suffix stops at the end of its piece (ends, of each place), at most depth bytes on.

    Larsson-Sadakane: ranks by the first few bytes, then each round sorts the members of groups that are still together by the rank of the
    suffix h bytes on, and h doubles. Of a suffix and its beginning the beginning comes first; equal ones stay in order of place, as common_prefixes needs it.
    Keys and places are sorted together as one number where 64 bits hold them.
    """
    n = len(x)
    padded = np.concatenate([x, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | padded[k : n + k]
    left = ends - np.arange(n)
    bits = n.bit_length()
    h = (61 - bits) // 8  # bytes, 3 bits of length and the place
    short = np.minimum(left, h).astype(np.uint64)
    drop = np.uint64(8) * (np.uint64(8) - short)
    key = (word >> drop << (drop - np.uint64(64 - 8 * h))) << np.uint64(3) | short
    packed = np.sort(key << np.uint64(bits) | np.arange(n, dtype=np.uint64))
    order, key = (packed & np.uint64((1 << bits) - 1)).astype(np.int64), packed >> np.uint64(bits)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:n])
    size = np.diff(np.r_[first, n])
    group = np.repeat(first, size)  # the place of its group's first
    rank = np.empty(n, np.int64)
    rank[order] = group
    places = np.flatnonzero(np.repeat(size > 1, size))
    group = group[places]
    while h < depth and len(places):
        own = order[places]
        on = np.where(left[own] > h, rank[np.minimum(own + h, n - 1)], -1) + 1
        some = len(own).bit_length()
        if 2 * bits + some <= 64:
            both = np.sort((group << bits | on).astype(np.uint64) << np.uint64(some) | np.arange(len(own), dtype=np.uint64))
            again, both = (both & np.uint64((1 << some) - 1)).astype(np.int64), both >> np.uint64(some)
        else:
            both = group * (n + 1) + on
            again = np.argsort(both, kind="stable")
            both = both[again]
        own = own[again]
        order[places] = own
        at = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        size = np.diff(np.r_[at, len(own)])
        group = np.repeat(places[at], size)
        rank[own] = group
        go_on = np.repeat((size > 1) & (on[again[at]] > 0), size)  # equal ones that have ended stay together
        places, group = places[go_on], group[go_on]
        h *= 2
    exact = np.empty(n, np.int64)
    exact[order] = np.arange(n)
    return order, exact, word


def equal_bytes(differ: np.ndarray) -> np.ndarray:
    """How many leading bytes of two words are equal, of their exclusive or."""
    top = differ & ~(differ >> np.uint64(1))  # the same highest bit, and no rounding up to the next in a double
    return 8 - (np.frexp(top.astype(np.float64))[1].astype(np.int64) + 7 >> 3)


def common_prefixes(order: np.ndarray, rank: np.ndarray, word: np.ndarray, ends: np.ndarray, first: np.ndarray, n_own: np.ndarray, cap: int = SPAN) -> np.ndarray:
    """For each place that a piece owns, the common prefix (up to cap) with the suffix before it in order; 0 elsewhere.

    Kasai: going right by one place, at most one byte of the prefix is lost. All pieces go along together, 8 bytes at once; of those that
    share these all further words are compared together.
    """
    out = np.zeros(len(order), np.int64)
    h = np.zeros(len(first), np.int64)
    steps = np.arange(0, cap, 8)
    for j in range(int(n_own.max(initial=0))):
        who = np.flatnonzero(n_own > j)
        i = first[who] + j
        r = rank[i]
        before = order[np.maximum(r - 1, 0)]
        most = np.where(r > 0, np.minimum(np.minimum(ends[i] - i, ends[before] - before), cap), 0)
        have = np.minimum(np.maximum(h[who] - 1, 0), most)
        open_ = np.flatnonzero(have < most)
        same = equal_bytes(word[i[open_] + have[open_]] ^ word[before[open_] + have[open_]])
        have[open_] += same
        open_ = open_[(same == 8) & (have[open_] < most[open_])]
        if len(open_):
            on = have[open_][:, None] + steps
            last = len(word) - 1
            differ = word[np.minimum(i[open_][:, None] + on, last)] ^ word[np.minimum(before[open_][:, None] + on, last)]
            at = np.argmax(differ != 0, axis=1)  # the first word that differs; without one the first of all, in which 8 bytes are equal
            found = differ[np.arange(len(at)), at]
            have[open_] += np.where(found == 0, 8 * len(steps), 8 * at + equal_bytes(found))
        h[who] = out[i] = np.minimum(have, most)
    return out


def runs_of(piece: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of neighbouring windows, as (first, end) rows of 16 bits, and the piece of each; piece and at are sorted and distinct."""
    new = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, np.int64)
    end = np.r_[new[1:], len(at)] - 1 if len(new) else new
    return np.stack([at[new], at[end] + 1], axis=1).astype("<u2"), piece[new]


def shard(anchor: np.ndarray, content: np.ndarray, k: np.ndarray, windows: np.ndarray, raw: list[bytes], hot: np.ndarray, ranges: int) -> pd.DataFrame:
    """What one shard finds: per piece the runs of repeated windows (spans), with range -1.

    Of hot anchors also each distinct window once, a row for each range of d1 that has any: anchors, contents, at, d1 and d2 as sorted arrays.
    """
    x = np.frombuffer(b"".join(raw), np.uint8)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    end = np.cumsum(size)
    first = end - size
    ends = np.repeat(end, size)
    order, rank, word = suffix_order(x, ends, int(size.max(initial=0)))
    prefix = common_prefixes(order, rank, word, ends, first, windows)
    piece = np.repeat(np.arange(len(raw)), windows)
    place = first[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    in_order = prefix[order] >= SPAN  # shares a window with the one before
    group = np.cumsum(~in_order)[rank[place]]
    _, which = np.unique(group, return_inverse=True)
    repeated = np.bincount(which, k[piece])[which] > 1
    offset = place - first[piece]
    spans, of = runs_of(piece[repeated], offset[repeated])
    has, cut_at = np.unique(of, return_index=True)
    cut_at = np.r_[cut_at, len(of)]
    out = {"anchor": anchor[has], "content": content[has], "spans": [spans[a:z].tobytes() for a, z in zip(cut_at[:-1], cut_at[1:], strict=True)], "range": -1}
    out = pd.DataFrame(out | {c: b"" for c in RUN})
    if hot.any():
        _, one = np.unique(which, return_index=True)
        one = one[hot[piece[one]]]
        sums, s = prefix_sums(x), place[one]
        d1 = span_hashes(sums, s, s + SPAN)
        a = np.lib.stride_tricks.as_strided(word, (len(word), 1), (8, 8))[:, 0] if len(word) else word
        d2 = np.zeros(len(s), np.uint64)
        for step in range(0, SPAN, 8):
            d2 = mixed(d2 * np.uint64(0xD1342543DE82EF95) + a[s + step])
        run = np.lexsort((d2, d1))
        columns = {"anchors": anchor[piece[one]], "contents": content[piece[one]], "at": offset[one].astype("<i4"), "d1": d1.view(np.int64), "d2": d2.view(np.int64)}
        columns = {c: v[run] for c, v in columns.items()}
        which_range = (d1[run] >> np.uint64(32)).astype(np.int64) * ranges >> 32
        some, edge = np.unique(which_range, return_index=True)
        edge = np.r_[edge, len(run)]
        found = {c: [v[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)] for c, v in columns.items()}
        out = pd.concat([out, pd.DataFrame({"anchor": 0, "content": 0, "spans": b"", "range": some} | found)], ignore_index=True)
    return out


RUN = ("anchors", "contents", "at", "d1", "d2")
FOUND = "anchor long, content long, spans binary, range long, " + ", ".join(f"{c} binary" for c in RUN)


def merged(runs: pd.DataFrame) -> pd.DataFrame:
    """Windows that two shards have, as spans of each piece: a binary search of each shard's sorted run in the union of all runs of the range."""
    windows = {c: np.frombuffer(b"".join(runs[c]), "<i4" if c == "at" else "<i8") for c in RUN}
    key = np.empty(len(windows["d1"]), [("d1", "<i8"), ("d2", "<i8")])
    key["d1"], key["d2"] = windows["d1"], windows["d2"]
    union = np.sort(key)
    twice = np.flatnonzero(np.searchsorted(union, key, side="right") - np.searchsorted(union, key) > 1)
    own = {c: windows[c][twice].astype(np.int64) for c in ("anchors", "contents", "at")}
    order = np.lexsort((own["at"], own["contents"], own["anchors"]))
    anchor, content, at = (own[c][order] for c in ("anchors", "contents", "at"))
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])] if len(at) else np.zeros(0, bool)
    spans, of = runs_of(np.cumsum(new), at)
    cut_at = np.r_[np.searchsorted(of, np.arange(1, new.sum() + 1)), len(of)]
    return pd.DataFrame({"anchor": anchor[new], "content": content[new], "spans": [spans[a:z].tobytes() for a, z in zip(cut_at[:-1], cut_at[1:], strict=True)]})


def frequent_anchors(table: DataFrame) -> list[int]:
    """Anchors with many distinct pieces in a sample of rows, the most frequent LISTED at most. They are only dealt out differently."""
    sample = occurrences(table.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLED)) == 0), False)
    kinds = sample.groupBy("anchor", "content").agg(F.lit(1).alias("one")).groupBy("anchor").agg(F.count("*").alias("n"))
    return [r["anchor"] for r in kinds.where(F.col("n") > max(1, HOT // SAMPLED)).orderBy(F.desc("n"), "anchor").limit(LISTED).collect()]


def repeated_pieces(table: DataFrame, n_buckets: int) -> DataFrame:
    """anchor, content, k (its occurrences), spans (arrays of runs of windows) of each distinct piece with repeated windows."""
    frequent = frequent_anchors(table)
    listed = F.col("anchor").isin(frequent) if frequent else F.lit(False)
    # pieces of an anchor meet in one task, those of a frequent anchor in several
    salted = occurrences(table, False).withColumn("salt", F.when(listed, F.col("content")).otherwise(F.lit(0)))
    counted = salted.repartition("anchor", "salt").groupBy("anchor", "salt", "content").agg(F.sum("k").alias("k"), F.min(F.struct("row", "at")).alias("one"))
    of_anchor = W.partitionBy("anchor", "salt")
    chosen = counted.withColumn("total", F.sum("k").over(of_anchor)).withColumn("kinds", F.count("*").over(of_anchor)).where(listed | (F.col("total") > 1))
    hot = listed | (F.col("kinds") > HOT)
    chosen = staged(chosen.select("anchor", "content", "k", hot.alias("hot"), F.col("one.row").alias("row"), F.col("one.at").alias("at")), "chosen")
    windows = F.expr("at & 65535")
    sizes = chosen.agg(F.sum(windows + SPAN - 1).alias("bytes"), F.sum(F.when(F.col("hot"), windows)).alias("windows")).collect()[0]
    shards, ranges = max(1, -(-(sizes["bytes"] or 0) // SHARD_BYTES)), max(1, -(-(sizes["windows"] or 0) // RANGE))
    # a hot anchor's pieces are dealt over all the shards, by content
    dealt = chosen.withColumn("shard", F.pmod(F.when(F.col("hot"), F.xxhash64("content")).otherwise(F.xxhash64("anchor")), F.lit(shards)))
    wanted = dealt.repartition(n_buckets, "row").groupBy("row").agg(F.collect_list(F.struct("anchor", "content", "k", "at", "shard", "hot")).alias("list"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [memoryview(v.as_buffer()) for v in b.column(0)]
            listed = b.column(1).flatten()
            own = {c: listed.field(c) for c in ("shard", "hot", "anchor", "content", "k")}
            at, of = listed.field("at").to_numpy(), np.repeat(np.arange(len(b)), b.column(1).value_lengths().to_numpy())
            start, windows = at >> 16, at & 65535
            end = start + windows + SPAN - 1
            edge = np.flatnonzero(np.diff(np.cumsum(end - start) // BROUGHT, prepend=-1, append=-1))
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                raw = [bytes(texts[t][s:e]) for t, s, e in zip(of[i:j].tolist(), start[i:j].tolist(), end[i:j].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(v[i:j] for v in own.values()), pa.array(windows[i:j].astype(np.int32)), pa.array(raw, pa.binary())], names=[*own, "windows", "raw"])

    brought = table.join(wanted, "row").select("text", "list").mapInArrow(fetch, "shard long, hot boolean, anchor long, content long, k long, windows int, raw binary")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return shard(*(pdf[c].to_numpy() for c in ("anchor", "content", "k")), pdf["windows"].to_numpy(np.int64), list(pdf["raw"]), pdf["hot"].to_numpy(bool), ranges)

    found = staged(brought.groupBy("shard").applyInPandas(build, FOUND), "found")
    inside = found.where("range < 0").select("anchor", "content", "spans")
    across = found.where("range >= 0").groupBy("range").applyInPandas(merged, "anchor long, content long, spans binary")
    # at most a row per window of the piece, so lists are short
    spans = inside.unionByName(across).groupBy("anchor", "content").agg(F.collect_list("spans").alias("spans"))
    return staged(spans.join(chosen.select("anchor", "content", "k"), ["anchor", "content"]), "repeated")


def covered(table: DataFrame, found: DataFrame, salts: int) -> DataFrame:
    """row, spans (first window and end of each stretch, 64 bits each) of each text with found pieces.

    A chunk of texts asks once for each of its distinct pieces, and its answers come back together. What asks for a frequent piece is
    dealt over salts tasks, where a copy of the piece's row waits; pieces with over a LISTED-th of all occurrences are listed, fewer than LISTED.
    """
    total = found.agg(F.sum("k").alias("n")).collect()[0]["n"] or 0
    often = [r["content"] for r in found.where(F.col("k") > max(salts, total // LISTED)).select("content").collect()]
    listed = F.col("content").isin(often) if often else F.lit(False)
    zero = F.lit(0).cast("long")
    asked = occurrences(table, True).withColumn("salt", F.when(listed, F.pmod(F.xxhash64("chunk"), F.lit(salts))).otherwise(zero).cast("long"))
    copies = F.when(listed, F.sequence(zero, F.lit(salts - 1).cast("long"))).otherwise(F.array(zero))
    waiting = found.select("anchor", "content", "spans", F.explode(copies).alias("salt"))
    answers = asked.join(waiting, ["anchor", "content", "salt"]).select("chunk", "row", "at", "more", "spans")

    def by_row(answers: pa.Table) -> pa.Table:
        row, at, more, spans = (answers.column(c).combine_chunks() for c in ("row", "at", "more", "spans"))
        n, rest = np.arange(len(row)), more.flatten().to_numpy()
        # the runs of each answer, then those of each place that it is for
        runs = np.frombuffer(b"".join(spans.flatten().to_pylist()), "<u2").astype(np.int64).reshape(-1, 2)
        size = np.bincount(np.repeat(n, spans.value_lengths().to_numpy()), pc.binary_length(spans.flatten()).to_numpy() // 4, len(n)).astype(np.int64)
        of = np.r_[n, np.repeat(n, more.value_lengths().to_numpy() // 2)]
        row, at = np.r_[row.to_numpy(), rest[::2]], np.r_[at.to_numpy(), rest[1::2]] >> 16
        order = np.argsort(row, kind="stable")
        of, row, at = of[order], row[order], at[order]
        own = size[of]
        which = np.repeat((np.cumsum(size) - size)[of] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        placed = (runs[which] + np.repeat(at, own)[:, None]).astype("<i8")
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        edge = 16 * np.r_[0, np.cumsum(np.add.reduceat(own, first))]
        data = memoryview(placed.tobytes())
        return pa.table({"row": pa.array(row[first]), "spans": pa.array([bytes(data[a:z]) for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.binary())})

    return answers.groupBy("chunk").applyInArrow(by_row, "row long, spans binary")


def cut(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Maximal covered runs, (first, end) rows, of stretches of n bytes."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    covered = np.cumsum(step)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
    return edge.reshape(-1, 2)


def remove_repeats(docs: DataFrame, text_col: str = "text", with_text: bool = False) -> DataFrame:
    """docs' other columns with n_bytes, n_removed, n_spans, kept_sha256 (and kept_text) for each row of docs; columns of docs with one of these names give way.

    Every byte under a SPAN-byte string that also starts elsewhere, in any row or the same, goes; all are judged on the input. Null and
    empty texts have no bytes. Repeated rows are repeats of each other. kept_text leaves out the rests of characters that lost
    a part of their bytes; the digest is of all bytes left. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    short_batches(spark)
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
    rest = [c for c in docs.columns if c not in (text_col, *names)]
    # under names of their own, whatever the columns are called
    packed = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.struct(*[F.col(c) for c in rest]).alias("rest"))
    name, n_buckets = f"texts_{uuid.uuid4().hex}", max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed.repartition(n_buckets, "row").write.bucketBy(n_buckets, "row").option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    found = repeated_pieces(table, n_buckets)
    spans = covered(table, found, n_buckets).repartition(n_buckets, "row")
    joined = table.join(spans, "row", "left").select("rest", "text", "spans")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(len(b)):
                raw, own = b.column(1)[i].as_buffer().to_pybytes(), b.column(2)[i].as_py()
                runs = np.zeros((0, 2), np.int64)
                if own:
                    spans = np.frombuffer(own, "<i8").reshape(-1, 2)
                    runs = cut(len(raw), spans[:, 0], spans[:, 1] + SPAN - 1)
                kept = b"".join(raw[a:z] for a, z in zip(np.r_[0, runs[:, 1]].tolist(), np.r_[runs[:, 0], len(raw)].tolist(), strict=True))
                out.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "ignore")] if with_text else [])))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)], names=["rest", *names])

    schema = f"rest {docs.select(F.struct(*[F.col(c) for c in rest]).alias('rest')).schema['rest'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(finish, schema).select("rest.*", *names)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
