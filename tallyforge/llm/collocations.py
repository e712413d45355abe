"""Phrase collocations by weighted acyclic automata whose transitions are words.

1. Counting: a shard of SHARD bytes of text gives its sorted phrases of up to `longest` words with their counts, a slice of first words at a
   time. They are cut by ranges of prefixes and each cut is built, block by block, into a minimal acyclic count transducer: states whose
   transitions, counts and targets are equal are one state, found in a register when their block is frozen.
2. Union: the transducers of one range, from all shards, are added up; phrases under the least count go, as all parts of a frequent
   phrase are as frequent themselves. What is left is little, so ranges side by side become one, up to FREQUENT bytes of transducers.
3. Parts: each range builds a transducer of the parts that its candidates ask for (both sides of each cut), weighted by the largest
   count of a candidate that asks. Cut by ranges, it is composed with the counts of the range that has the parts. Counts come
   back in the order in which they were asked; the weights tell the other range which of its candidates lie inside a longer one.
4. Scores are exact integers. A range hands on the best of each language, which are ranked in two steps.

A very frequent word or pair counts once in each shard and each asking range, and may be cut anywhere among the phrases that it begins.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.shared import LOWER, blocks, mixed, prefix_sums, read, short_batches, span_hashes, staged, word_spans, word_table

LONGEST, LEAST, TOP = 3, 10, 2000
#: A phrase lies inside a longer one, and is dropped, if the longer one has this many hundredths of its occurrences.
INSIDE = 50
#: Bytes of text whose words a task tells apart at a time, of text whose phrases it builds at a time, and of text for each range of prefixes. A shard has a
#: piece for each range, so pieces are (text / SHARD) * (text / RANGE). Larger ones share more, and take more memory.
SHARD, SLICE, RANGE = 16 << 20, 4 << 20, 4 << 20
#: Bytes of packed transducers of frequent phrases that ask, and are asked, together.
FREQUENT = 512 << 10
#: Bytes of text sampled to lay the ranges, for each of them. Where ranges begin decides no result.
SAMPLED = 64 << 10
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
WORD = word_table(b"\x20\x09" + BREAKS)
BREAK = ~word_table(BREAKS)
#: Phrases of a range's transducers that are added up together.
TOGETHER = 500_000
#: First-word subtrees that are frozen together.
BLOCK_OF = 4096

Key = tuple[bytes, ...]


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and which one each key is."""
    return np.unique(key, return_inverse=True)


@dataclass
class Trie:
    """Phrases as a tree in sorted order: at each level a node's parent (at the level before), word and count. Level 0 is the language."""

    words: list[bytes]  # each with a space after it, sorted: so phrases are in the order of their bytes, too
    parent: list[np.ndarray]
    label: list[np.ndarray]
    count: list[np.ndarray]

    def __len__(self) -> int:
        return sum(map(len, self.label))

    @cached_property
    def number(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    @property
    def depth(self) -> int:
        return len(self.label)

    def first_child(self, level: int, node):
        """The first node of a level whose parent is not before node."""
        return np.searchsorted(self.parent[level], node)

    def bounds(self, key: Key) -> list[int]:
        """How many nodes of each level come before the phrase key."""
        out, at, exact = [], 0, True
        for level in range(self.depth):
            if level >= len(key) or not exact:
                at = int(self.first_child(level, at)) if level else at
                out.append(at)
                continue
            a, z = (0, len(self.label[0])) if not level else (int(x) for x in self.first_child(level, np.array([at, at + 1])))
            word = bisect_left(self.words, key[level])
            known = word < len(self.words) and self.words[word] == key[level]
            at = a + int(np.searchsorted(self.label[level][a:z], word))
            exact = known and at < z and self.label[level][at] == word
            out.append(at + (exact and level < len(key) - 1))
        return out

    def part(self, a: list[int], z: list[int]) -> Trie | None:
        """The nodes a[level] to z[level] with their counts, and those above them without."""
        starts, first = [], None
        for level in range(self.depth - 1, -1, -1):
            above = [int(self.parent[level + 1][first])] if first is not None else []
            own = [a[level]] if a[level] < z[level] else []
            first = min(above + own, default=None)
            starts.append(z[level] if first is None else first)
        starts = starts[::-1]
        if first is None:
            return None
        label = [x[s:e] for x, s, e in zip(self.label, starts, z, strict=True)]
        count = [np.where(np.arange(s, e) < lo, 0, x[s:e]) for x, s, e, lo in zip(self.count, starts, z, a, strict=True)]
        parent = [x[s:e] - p for x, s, e, p in zip(self.parent, starts, z, [0, *starts], strict=False)]
        return Trie(self.words, parent, label, count).fewer_words()

    def fewer_words(self) -> Trie:
        used, place = np.unique(np.concatenate(self.label), return_inverse=True)
        label = np.split(place, np.cumsum([len(x) for x in self.label])[:-1])
        return Trie([self.words[i] for i in used.tolist()], self.parent, label, self.count)

    def kept(self, keep: list[np.ndarray]) -> Trie:
        """The nodes to keep (one boolean array for each level) and those above them."""
        keep = [k.copy() for k in keep]
        for level in range(self.depth - 1, 0, -1):
            keep[level - 1][self.parent[level][keep[level]]] = True
        number = [np.cumsum(k) - 1 for k in keep]
        parent = [self.parent[0][keep[0]]] + [number[i - 1][self.parent[i][keep[i]]] for i in range(1, self.depth)]
        return Trie(self.words, parent, [x[k] for x, k in zip(self.label, keep, strict=True)], [x[k] for x, k in zip(self.count, keep, strict=True)]).fewer_words()

    def paths(self, level: int) -> np.ndarray:
        """The words' numbers of each node of a level, from level 0 to its own."""
        out = np.empty((len(self.label[level]), level + 1), np.int64)
        at = np.arange(len(out))
        for i in range(level, -1, -1):
            out[:, i] = self.label[i][at]
            at = self.parent[i][at]
        return out


def tree(words: list[bytes], paths: list[tuple[np.ndarray, np.ndarray]], total=np.add, start: int = 0) -> Trie:
    """The trie of (paths of one length, counts) for lengths 1, 2, ...; the counts of equal paths meet by total. Paths above others come in without counts."""
    depth, width = len(paths), max(1, len(words))
    tries = [np.zeros(len(p), np.int64) for p, _ in paths]  # the node of each path, as far as it has been followed
    out: tuple[list, list, list] = ([], [], [])
    for level in range(depth):
        longer = range(level, depth)
        key = np.concatenate([tries[i] * width + paths[i][0][:, level] for i in longer])
        distinct, which = grouped(key)
        count = np.full(len(distinct), start, np.int64)
        total.at(count, which[: len(paths[level][0])], paths[level][1])
        for i, own in zip(longer, np.split(which, np.cumsum([len(tries[i]) for i in longer])[:-1]), strict=True):
            tries[i] = own
        for x, y in zip(out, (distinct // width, distinct % width, count), strict=True):
            x.append(y)
    return Trie(words, *out)


def union(tries: list[Trie], total=np.add) -> Trie:
    """All phrases of tries of one depth, their counts added up (or met by another total)."""
    if len(tries) == 1:
        return tries[0]
    words = sorted(set().union(*(t.words for t in tries)))
    number = {w: i for i, w in enumerate(words)}
    to = [np.array([number[w] for w in t.words], np.int64) for t in tries]
    node = [np.zeros(1, np.int64) for _ in tries]
    parent, label, count = [], [], []
    for level in range(tries[0].depth):
        key = np.concatenate([n[t.parent[level]].astype(np.int64) * max(1, len(words)) + m[t.label[level]] for t, n, m in zip(tries, node, to, strict=True)])
        distinct, which = grouped(key)
        own = np.zeros(len(distinct), np.int64)
        total.at(own, which, np.concatenate([t.count[level] for t in tries]))
        node = np.split(which, np.cumsum([len(t.label[level]) for t in tries])[:-1])
        parent.append(distinct // max(1, len(words)))
        label.append(distinct % max(1, len(words)))
        count.append(own)
    return Trie(words, parent, label, count)


class Transducer:
    """The minimal acyclic automaton of a trie: by depth, states as runs of transitions (word, count, target state of the next depth). State 0 has none."""

    def __init__(self, trie: Trie):
        n = [len(x) for x in trie.label]
        self.words, self.depth = trie.words, trie.depth
        self.label, self.count, self.target = ([np.zeros(k, np.int64) for k in n] for _ in range(3))
        self.first = [np.zeros(k + 2, np.int64) for k in (1, *n[:-1])]
        self.states, self.register = [1] * self.depth, [{} for _ in n]
        to = [np.zeros(k, np.int64) for k in n]
        if self.depth > 1:
            for i in range(0, n[1], BLOCK_OF):
                self.freeze_block(trie, to, i, min(i + BLOCK_OF, n[1]))
            self.freeze(trie, to, 1, 0, n[1], 0, n[0])
        self.freeze(trie, to, 0, 0, n[0], 0, 1)
        for d in range(self.depth):
            end = int(self.first[d][self.states[d]])
            self.label[d], self.count[d], self.target[d], self.first[d] = self.label[d][:end], self.count[d][:end], self.target[d][:end], self.first[d][: self.states[d] + 1]

    def freeze_block(self, trie: Trie, to: list[np.ndarray], a: int, z: int) -> None:
        """All states below the first words a to z, deepest first."""
        runs = [(a, z)]
        for level in range(2, trie.depth):
            runs.append(tuple(int(x) for x in trie.first_child(level, np.array(runs[-1]))))
        for level in range(trie.depth - 1, 1, -1):
            self.freeze(trie, to, level, *runs[level - 1], *runs[level - 2])

    def freeze(self, trie: Trie, to: list[np.ndarray], d: int, a: int, z: int, pa_: int, pz: int) -> None:
        """States of depth d of the nodes pa_ to pz of the level above, from their transitions a to z; equal ones become one."""
        size = np.bincount(trie.parent[d][a:z] - pa_, minlength=pz - pa_)
        has = np.flatnonzero(size)
        size, start = size[has], a + (np.cumsum(size) - size)[has]
        if not len(has):
            return
        label, count, target = trie.label[d], trie.count[d], to[d]
        salt = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
        x = mixed(mixed(mixed(label[a:z].astype(np.uint64) * salt[0]) + count[a:z].astype(np.uint64) * salt[1]) + target[a:z].astype(np.uint64) * salt[2])
        sums, one, which = np.unique(np.add.reduceat(x, start - a), return_index=True, return_inverse=True)
        keys, register = sums.tolist(), self.register[d]
        ids = np.fromiter(map(register.get, keys, repeat(-1)), np.int64, len(keys)) if register else np.full(len(keys), -1)
        fresh = np.flatnonzero(ids < 0)
        ids[fresh] = self.states[d] + np.arange(len(fresh))
        if d > 1 and trie.depth > 1 and len(trie.label[1]) > BLOCK_OF:  # other blocks follow
            register.update(zip(keys, ids.tolist(), strict=True))
        self.append(trie, to, d, start[one[fresh]], size[one[fresh]])
        state = ids[which]
        # equal sums are checked: a state is shared only if its transitions are the same
        first = self.first[d]
        same = first[state + 1] - first[state] == size
        if same.all():
            at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
            there = np.repeat(first[state] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            equal = (label[at] == self.label[d][there]) & (count[at] == self.count[d][there]) & (target[at] == self.target[d][there])
            same = np.logical_and.reduceat(equal, np.cumsum(size) - size)
        if not same.all():
            odd = np.flatnonzero(~same)
            state[odd] = self.states[d] + np.arange(len(odd))
            self.append(trie, to, d, start[odd], size[odd])
        if d:
            to[d - 1][pa_ + has] = state
        else:
            self.root = int(state[0])

    def append(self, trie: Trie, to: list[np.ndarray], d: int, start: np.ndarray, size: np.ndarray) -> None:
        end = int(self.first[d][self.states[d]])
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        for own, x in ((self.label, trie.label), (self.count, trie.count), (self.target, to)):
            own[d][end : end + len(at)] = x[d][at]
        self.first[d][self.states[d] + 1 : self.states[d] + 1 + len(size)] = end + np.cumsum(size)
        self.states[d] += len(size)

    def pack(self) -> bytes:
        """Words, then sizes of states, words, counts and targets of each depth, in as few bytes a number as they need."""
        out = [np.array([self.depth], "<i8").tobytes()]
        for x in [np.frombuffer(b"".join(self.words), np.uint8), *(y for d in range(self.depth) for y in (np.diff(self.first[d]), self.label[d], self.count[d], self.target[d]))]:
            kind = np.min_scalar_type(int(x.max(initial=0)))
            out += [np.array([len(x), kind.itemsize], "<i8").tobytes(), x.astype(kind).tobytes()]
        return b"".join(out)


def unpack(raw: bytes) -> Trie:
    """The trie of a packed transducer: its transitions, followed from the root."""
    at, found = 8, []
    depth = int(np.frombuffer(raw, "<i8", 1)[0])
    for _ in range(1 + 4 * depth):
        n, width = np.frombuffer(raw, "<i8", 2, at).tolist()
        found.append(np.frombuffer(raw, f"<u{width}", n, at + 16))
        at += 16 + n * width
    words = [w + b" " for w in found[0].tobytes().split(b" ")[:-1]]
    parent, label, count, state, above = [], [], [], np.array([1]), np.zeros(1, np.int32)
    for d in range(depth):
        sizes, words_of, counts, targets = found[1 + 4 * d : 5 + 4 * d]
        size, ends = sizes[state].astype(np.int64), np.cumsum(sizes, dtype=np.int64)
        own = np.cumsum(size)
        at = np.repeat((ends - sizes)[state] - (own - size), size) + np.arange(own[-1] if len(own) else 0)
        # small numbers: a range's phrases are many
        parent.append(np.repeat(above, size))
        label.append(words_of[at].astype(np.int32))
        count.append(counts[at].astype(np.int32 if counts.itemsize < 4 else np.int64))
        state, above = targets[at].astype(np.int32), np.arange(len(at), dtype=np.int32)
    return Trie(words, parent, label, count)


def packed(trie: Trie) -> bytes:
    return Transducer(trie).pack()


def cuts(trie: Trie, keys: list[Key]) -> Iterator[tuple[int, Trie]]:
    """(range, its part of the trie) for the ranges that have any; range i begins with keys[i - 1]."""
    if not len(trie.label[0]):
        return
    first, last = (tuple(trie.words[x[at]] for x in trie.label[:depth] if len(x)) for at, depth in ((0, 1), (-1, trie.depth)))
    a, z = bisect_right(keys, first), bisect_right(keys, last)
    before = [0] * trie.depth
    for i, z in enumerate([*map(trie.bounds, keys[a:z]), [len(x) for x in trie.label]], a):
        part = trie.part(before, z) if z != before else None
        if part:
            yield i, part
        before = z


def compose(asked: Trie, counts: Trie) -> np.ndarray:
    """The counts of the asked phrases (those with a weight), level by level, each in its order; 0 for unknown ones."""
    to = np.array([counts.number.get(w, -1) for w in asked.words], np.int64)
    node, width, out = np.zeros(1, np.int64), max(1, len(counts.words)), []
    for level in range(min(asked.depth, counts.depth)):
        keys = counts.parent[level].astype(np.int64) * width + counts.label[level]
        label, above = to[asked.label[level]], node[asked.parent[level]]
        key = np.where((label < 0) | (above < 0), -1, above * width + label)
        at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        known = (keys[at] == key) if len(keys) else np.zeros(len(key), bool)
        node = np.where(known, at, -1)
        out.append(node)
    return out


def shard_tries(words: np.ndarray, follows: np.ndarray, langs: np.ndarray, texts: list[bytes], names: list[bytes], longest: int, slices: int) -> Iterator[Trie]:
    """The phrases of a shard: of each word occurrence its word and language (numbers in texts and names) and whether the next one follows in the same piece.

    They come as tries of equally many occurrences, in the order of their languages and first words; counts of a first word that two of them have add up.
    """
    vocabulary = sorted({*texts, *names})
    number = {w: i for i, w in enumerate(vocabulary)}
    word = np.array([number[w] for w in texts], np.int32)[words] if len(words) else words
    lang = np.array([number[w] for w in names], np.int32)[langs] if len(words) else langs
    del number, texts, words, langs
    width = np.int64(max(1, len(vocabulary)))
    order = np.argsort(lang * width + word, kind="stable").astype(np.int32) if slices > 1 else np.arange(len(word), dtype=np.int32)
    for at in np.array_split(order, slices):  # where the phrases of the level's length begin
        own, which = grouped(lang[at].astype(np.int64))
        parent, label, count = [np.zeros(len(own), np.int64)], [own], [np.zeros(len(own), np.int64)]
        for level in range(longest):
            distinct, place = grouped(which * width + word[at + level])
            parent.append(distinct // width)
            label.append(distinct % width)
            count.append(np.bincount(place, minlength=len(distinct)))
            on = follows[at + level]
            at, which = at[on], place[on]
        yield Trie(vocabulary, parent, label, count)


def shards(batches: Iterator[pa.RecordBatch], longest: int, size: int, slice_bytes: int = SLICE) -> Iterator[Trie]:
    """The tries of runs of about size bytes of the batches' texts (language, text), in slices for about slice_bytes each."""
    got, raws, room = [], [], size
    names: dict[bytes, int] = {}

    def flush() -> Iterator[Trie]:
        block_of = [len(x[0]) for x in got]
        columns = [list(x) for x in zip(*got, strict=True)]
        got.clear()
        hashes, start, end, follows, langs = (np.concatenate(columns.pop(0)) for _ in range(5))
        first, words = np.unique(hashes, return_index=True, return_inverse=True)[1:]
        words = words.astype(np.int32)
        block = np.repeat(np.arange(len(block_of)), block_of)[first]
        texts = [raws[i][a:z] + b" " for i, a, z in zip(block.tolist(), start[first].tolist(), end[first].tolist(), strict=True)]
        slices = -(-sum(map(len, raws)) // slice_bytes)
        raws.clear()
        del hashes, start, end, first, block
        yield from shard_tries(words, follows, langs, texts, list(names), longest, slices)

    for batch in batches:
        lang = np.array([names.setdefault(x.encode().hex().encode() + b" ", len(names)) for x in batch.column(0).to_pylist()], np.int64)
        for first, _, data, offsets in blocks(batch.column(1)):
            data = LOWER[data]
            start, end, row = word_spans(data, offsets, WORD)
            if not len(start):
                continue
            broken = np.r_[0, np.cumsum(BREAK[data])]
            follows = np.r_[(row[1:] == row[:-1]) & (broken[start[1:]] == broken[end[:-1]]), False]
            got.append((span_hashes(prefix_sums(data), start, end), start.astype(np.int32), end.astype(np.int32), follows, lang[first + row].astype(np.int32)))
            raws.append(data.tobytes())
            room -= len(data)
            if room <= 0:
                yield from flush()
                room = size
    if got:
        yield from flush()


def sort_key(key: Key) -> bytes:
    return b"".join(key)


def range_keys(docs: DataFrame, total: int, longest: int, range_bytes: int) -> list[Key]:
    """Where ranges begin, but for the first: quantiles of the distinct phrases of sampled documents."""
    ranges = -(-total // range_bytes)
    if ranges < 2:
        return []
    every = max(1, SAMPLED // 50)  # about 50 phrases for each range, from a phrase for every byte or so of text

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for trie in shards(batches, longest, SAMPLED * 8):
            keys = [sort_key([trie.words[i] for i in path]) for level in range(1, trie.depth) for path in trie.paths(level)[level::every].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["key"])

    sampled = docs.sample(min(1.0, ranges * SAMPLED / max(1, total)), 1)
    keys = staged(sampled.mapInArrow(phrases, "key binary"), "phrase-sample")
    n = keys.count()
    share = max(1, n // ranges)
    ordered = staged(keys.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "phrase-order")
    # places in the whole order: those in a part, lifted by the parts before
    lift = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lifts = ordered.groupBy("part").agg(F.count("*").alias("n")).select("part", lift.alias("lift"))  # a row for each part
    place = F.row_number().over(W.partitionBy("part").orderBy("key")) + F.col("lift")
    found = ordered.join(lifts, "part").withColumn("place", place).where(F.col("place") % share == 0).select("key").distinct().collect()  # about as many as there are ranges
    return sorted((tuple(w + b" " for w in r["key"].split(b" ")[:-1]) for r in found), key=sort_key)


def arrow(kind: str) -> list[str]:
    return [x.split(" ")[0] for x in kind.split(", ")]


RANGED = "range long, origin long, body binary"


def built(docs: DataFrame, keys: list[Key], longest: int, shard_bytes: int, slice_bytes: int) -> DataFrame:
    """range, origin (0), body: the packed transducers of the ranges of all shards."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for trie in shards(batches, longest, shard_bytes, slice_bytes):
            for i, part in cuts(trie, keys):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([0], pa.int64()), pa.array([packed(part)], pa.binary())], names=arrow(RANGED))

    return docs.mapInArrow(build, RANGED)


def wider(counts: DataFrame, keys: list[Key], most: int) -> tuple[DataFrame, list[Key]]:
    """The frequent phrases with ranges side by side as one range, for each `most` bytes of transducers, and where those begin."""
    starts, size = [], 0
    for r in counts.select("range", F.octet_length("body").alias("n")).orderBy("range").collect():  # two numbers for each range
        if not starts or size + r["n"] > most:
            starts, size = [*starts, r["range"]], 0
        size += r["n"]
    later = [F.lit(x).cast("long") for x in starts[1:]]

    def add_up(group: pa.Table) -> pa.Table:
        bodies = [body for _, body in rows_of(group)]
        return table([(group.column("range")[0].as_py(), COUNTS, bodies[0] if len(bodies) == 1 else packed(union([unpack(b) for b in bodies])))])

    if later:
        counts = counts.withColumn("range", F.size(F.filter(F.array(*later), lambda x: x <= F.col("range"))).cast("long"))
    else:
        counts = counts.withColumn("range", F.lit(0).cast("long"))
    return staged(counts.groupBy("range").applyInArrow(add_up, RANGED), "frequent-phrases"), [keys[i - 1] for i in starts[1:]]


def parts(trie: Trie) -> Trie:
    """What the candidates of a trie ask for: both parts at each cut; weights are the largest count of those who ask."""
    asked: list[list] = [[] for _ in range(trie.depth - 1)]
    for level in range(2, trie.depth):
        has = np.flatnonzero(trie.count[level])
        path, count = trie.paths(level)[has], trie.count[level][has]
        for k in range(1, level):
            asked[k].append((path[:, : 1 + k], count))
            asked[level - k].append((np.delete(path, range(1, 1 + k), axis=1), count))
    none = lambda i: (np.zeros((0, i + 1), np.int64), np.zeros(0, np.int64))
    paths = [tuple(np.concatenate(x) for x in zip(*own, strict=True)) if own else none(i) for i, own in enumerate(asked)]
    return tree(trie.words, paths, np.maximum)


@dataclass
class Answer:
    """Counts of a range's parts, by level, in the order of the parts."""

    values: list[np.ndarray]

    def pack(self) -> bytes:
        return b"".join(np.array([len(v)], "<i8").tobytes() + v.astype("<i8").tobytes() for v in self.values)

    @staticmethod
    def unpack(raw: bytes) -> Answer:
        out, at = [], 0
        while at < len(raw):
            n = int(np.frombuffer(raw, "<i8", 1, at)[0])
            out.append(np.frombuffer(raw, "<i8", n, at + 8))
            at += 8 + 8 * n
        return Answer(out)


def table(rows: list[tuple]) -> pa.Table:
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate((("range", pa.int64()), ("origin", pa.int64()), ("body", pa.binary())))})


def rows_of(group: pa.Table) -> list[tuple[int, bytes]]:
    """(origin, body) of a range's rows, by origin."""
    return sorted(zip(group.column("origin").to_pylist(), group.column("body").to_pylist(), strict=True), key=lambda r: r[0])


COUNTS, WEIGHTS, WORDS = -3, -2, -1


def mined(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, inside: int = INSIDE, shard_bytes: int = SHARD, range_bytes: int = RANGE, slice_bytes: int = SLICE, frequent_bytes: int = FREQUENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of 2 to `longest` words of each language of docs (lang, text).

    Words are what stands between spaces, tabs and the ends of pieces (BREAKS), A-Z lower-cased; a null lang counts as `und`, a null text as empty.
    n counts the language's words, a the phrase's occurrences (at least `least`, and those over the fewer than the whole `inside` hundredths that
    make a longer candidate stand for it), l and r those of its two parts at the cut with the lowest score
    floor(1000000 a a / (l r)), the first such cut. Ranked by score, a (both falling) and the phrase's UTF-8 bytes. Repeated rows count each; texts
    of any length count whole; an empty table gives an empty result; other columns are left out.
    """
    short_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    keys = range_keys(docs, total, longest, range_bytes)

    def add_up(group: pa.Table) -> pa.Table:
        """The frequent phrases of a range, and the number of words of each language that begin here."""
        at, whole, own = group.column("range")[0].as_py(), [], []
        for body in group.column("body"):
            own.append(unpack(body.as_py()))
            if sum(map(len, own)) >= max(TOGETHER, sum(map(len, whole)) // 2):
                whole, own = [union(whole + own)], []
        whole = union(whole + own)
        words = np.bincount(whole.parent[1], whole.count[1], len(whole.label[0])).astype(np.int64)
        rows = [(at, WORDS, whole.words[w] + str(n).encode()) for w, n in zip(whole.label[0].tolist(), words.tolist(), strict=True) if n]
        frequent = [(c >= least) for c in whole.count]
        frequent[0][:] = False
        if any(k.any() for k in frequent):
            kept = whole.kept(frequent)
            rows.append((at, COUNTS, packed(kept)))
        return table(rows)

    found = staged(built(docs, keys, longest, shard_bytes, slice_bytes).groupBy("range").applyInArrow(add_up, RANGED), "phrases")
    counts, keys = wider(found.where(F.col("origin") == COUNTS), keys, frequent_bytes)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, body in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                asked = parts(unpack(body.as_py()))
                if any(len(x) for x in asked.label[1:]):
                    for i, part in cuts(asked, keys):
                        yield table([(i, at, packed(part))]).to_batches()[0]

    def tell(group: pa.Table) -> pa.Table:
        """The counts that others ask this range for, and the largest weight with which each of its phrases was asked for."""
        at, rows, own = group.column("range")[0].as_py(), rows_of(group), None
        out = []
        for origin, body in rows:
            trie = unpack(body)
            if origin == COUNTS:
                own, weights = trie, [np.zeros(len(x), np.int64) for x in trie.label]
                continue
            answer = []
            for level, node in enumerate(compose(trie, own) if own else []):
                asked = trie.count[level] > 0
                node, weight = node[asked], trie.count[level][asked]
                np.maximum.at(weights[level], node[node >= 0], weight[node >= 0])
                answer.append(np.where(node >= 0, own.count[level][node], 0))
            out.append((origin, at, Answer(answer).pack()))
        return table(out + ([(at, WEIGHTS, Answer(weights).pack())] if own else []))

    asked = counts.mapInArrow(ask, RANGED)
    answers = staged(counts.unionByName(asked).groupBy("range").applyInArrow(tell, RANGED), "phrase-parts")

    def score(group: pa.Table) -> pa.Table:
        """The best phrases of a range."""
        own, weights, answer = None, None, []
        for origin, body in rows_of(group):
            if origin == COUNTS:
                own = unpack(body)
            elif origin == WEIGHTS:
                weights = Answer.unpack(body).values
            else:
                answer.append(Answer.unpack(body).values)
        best: dict[bytes, list[tuple]] = defaultdict(list)
        asked = parts(own)
        # by level, what the ranges answered, in the order of the ranges and so of the parts
        known = [np.concatenate([np.zeros(0, np.int64)] + [v[level] for v in answer if level < len(v)]) for level in range(asked.depth)]
        value = [np.zeros(len(x), np.int64) for x in asked.count]
        for v, x, k in zip(value, asked.count, known, strict=True):
            v[x > 0] = k
        look = Trie(asked.words, asked.parent, asked.label, value)
        for level in range(2, own.depth):
            stays = np.flatnonzero((own.count[level] > 0) & (100 * weights[level] < inside * own.count[level]))
            path, a = own.paths(level)[stays], own.count[level][stays]
            sides = [(counted(own, look, path[:, : 1 + k]), counted(own, look, np.delete(path, range(1, 1 + k), axis=1))) for k in range(1, level)]
            for i, (line, n) in enumerate(zip(path.tolist(), a.tolist(), strict=True)):
                cut = min((1_000_000 * n * n // (int(left[i]) * int(right[i])), k) for k, (left, right) in enumerate(sides))
                left, right = sides[cut[1]]
                best[own.words[line[0]]].append((-cut[0], -n, b"".join(own.words[w] for w in line[1:])[:-1], int(left[i]), int(right[i])))
        rows = [(lang, *r) for lang, own_rows in best.items() for r in sorted(own_rows)[:top]]
        text = lambda b: b.decode("utf-8", "replace")
        columns = [[text(bytes.fromhex(r[0][:-1].decode())) for r in rows], [text(r[3]) for r in rows], [-r[2] for r in rows], [r[4] for r in rows], [r[5] for r in rows], [-r[1] for r in rows]]
        return pa.table({c: pa.array(v, pa.string() if c in ("lang", "phrase") else pa.int64()) for c, v in zip(("lang", "phrase", "a", "l", "r", "score"), columns, strict=True)})

    scored = staged(counts.unionByName(answers).groupBy("range").applyInArrow(score, "lang string, phrase string, a long, l long, r long, score long"), "scored-phrases")
    return ranked(scored, top).join(words_of(found), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def counted(own: Trie, look: Trie, path: np.ndarray) -> np.ndarray:
    """The values of paths (in own's words) in look."""
    to = np.array([look.number.get(w, -1) for w in own.words], np.int64)
    node, width = np.zeros(len(path), np.int64), max(1, len(look.words))
    for level in range(path.shape[1]):
        keys = look.parent[level].astype(np.int64) * width + look.label[level]
        node = np.searchsorted(keys, node * width + to[path[:, level]])
    return look.count[path.shape[1] - 1][node]


def words_of(found: DataFrame) -> DataFrame:
    """lang, n: the words of each language."""
    body = F.split(F.decode("body", "utf-8"), " ")
    return found.where(F.col("origin") == WORDS).select(F.decode(F.unhex(body[0]), "utf-8").alias("lang"), body[1].cast("long").alias("words")).groupBy("lang").agg(F.sum("words").alias("n"))


def ranked(scored: DataFrame, top: int) -> DataFrame:
    """The best of each language, with rank; first within hash buckets, so that no language meets whole."""
    order: list[Column] = [F.desc("score"), F.desc("a"), F.col("phrase")]
    first = scored.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = first.withColumn("rank", F.row_number().over(W.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("bucket")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(read(spark, sf_dir, "documents"))


SQL = rf"""WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
runs AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM runs
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM runs
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM runs),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= {LEAST}),
cut AS MATERIALIZED (SELECT lang, phrase, a, place, array_to_string(w[:place], ' ') AS head, array_to_string(w[place + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS place FROM c)),
sides AS (SELECT u.lang, u.phrase, u.a, u.place, x.n AS l, y.n AS r, ((1000000::HUGEINT * u.a * u.a) // (x.n::HUGEINT * y.n))::BIGINT AS score FROM cut u
  JOIN f x ON x.lang = u.lang AND x.phrase = u.head JOIN f y ON y.lang = u.lang AND y.phrase = u.tail),
best AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, place) = 1),
held AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
most AS (SELECT lang, phrase, max(a) AS a FROM held GROUP BY ALL),
left_over AS (SELECT b.* FROM best b LEFT JOIN most m ON m.lang = b.lang AND m.phrase = b.phrase WHERE coalesce(100 * m.a, 0) < {INSIDE} * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM left_over JOIN total USING (lang)
QUALIFY rank <= {TOP}"""
