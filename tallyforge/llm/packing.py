"""Best-fit packing planned on a histogram of lengths.

1. Each text becomes token ids, an end id, and pieces of at most `capacity` ids (tokenised once, written to the shared folder).
2. The histogram of piece lengths, at most `capacity` numbers, goes to the driver. Best fit runs over counts: lengths from
   long to short, all pieces of a length at once into the classes of equally full sequences, tightest first.
3. The plan says of each length which ranks take which sequences. Pieces are ranked within their length (per hash bucket,
   lifted by the buckets before, so that no task has a whole length) and take their places by arithmetic on the rank.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.sharding import slots
from tallyforge.llm.shared import blocks, prefix_sums, read, span_hashes, staged, texts, word_spans, word_table

CAPACITY, END_ID = 2048, 0
#: Chunks of text whose ids a worker remembers in each of the two generations of its cache.
CACHE = 200_000
_loaded: dict = {}
#: Bytes of chunks: all but ASCII white space. Other white space stands inside chunks, which then go through the whole tokenizer.
CHUNK = word_table(b"\x20\x09\x0a\x0b\x0c\x0d")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Chunks whose words the next pattern splits as the tokenizer does, lower-cased; all others go through the whole tokenizer.
PLAIN = re.compile("[!-~\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf-\u012f\u0131-\u024f\u2010-\u2027\u20ac]+")
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 characters for themselves, the other bytes in order from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = byte_letters()
#: Marks that are words of their own after a word; an apostrophe isn't always.
MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")


class ChunkEncoder:
    """Ids of texts by a tokenizer that drops white space and never joins across it: chunks between white space are encoded, each new one once.

    A block of texts is cut into chunks by numpy, equal chunks (by 64-bit hashes) are looked up together, and the ids of all are gathered at once.
    Chunks are kept in two generations. When the young one has `size` of them it becomes the old one, and what nobody has asked the old one
    for since is forgotten: frequent chunks stay, rare ones go, in bounded memory. New plain chunks are split into words here, and
    the distinct words go to the tokenizer's model together, as one text; the id that ends a word tells where the next begins.
    """

    def __init__(self, path: str, size: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.size, self.young, self.old = Tokenizer.from_file(path), size, {}, {}
        self.by_words = Tokenizer(self.tokenizer.model)
        self.by_words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct lower-case words."""
        letters = [w if w.isascii() else w.encode().decode("latin-1").translate(LETTERS) for w in words]
        ids = np.array(self.by_words.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(ends) != len(words):  # not with this vocabulary: each word for itself then
            return {w: np.array([t.id for t in self.tokenizer.model.tokenize(x)], "<u4").tobytes() for w, x in zip(words, letters, strict=True)}
        raw = ids.tobytes()
        return {w: raw[a:z] for w, a, z in zip(words, [0, *ends[:-1].tolist()], ends.tolist(), strict=True)}

    def learn(self, new: list[str]) -> list[bytes]:
        """The ids of new chunks. An ASCII word with one mark at its end is that word and that mark."""
        out: list[bytes] = [b""] * len(new)
        one, low_one, two, low_two = [], [], [], []  # places of chunks that are a word, or a word and a mark, and those words
        known: dict[str, bytes] = dict.fromkeys(MARKS, b"")
        rest: dict[int, list[str]] = {}
        for i, chunk in enumerate(new):
            low = chunk.lower()
            if low.isalpha() and (low.isascii() or PLAIN.fullmatch(chunk)):
                one.append(i)
                low_one.append(low)
            elif "<|" in chunk or not PLAIN.fullmatch(chunk):
                out[i] = self.whole(chunk)
            elif low[-1] in MARKS and low[:-1].isalpha():
                two.append(i)
                low_two.append(low)
            else:
                rest[i] = WORD.findall(low)
        known.update(dict.fromkeys(low_one, b""))
        known.update(dict.fromkeys([w[:-1] for w in low_two], b""))
        known.update(dict.fromkeys([w for own in rest.values() for w in own], b""))
        words = list(known)
        for i in range(0, len(words), 20_000):
            known.update(self.of_words(words[i : i + 20_000]))
        for i, w in zip(one, low_one, strict=True):
            out[i] = known[w]
        for i, w in zip(two, low_two, strict=True):
            out[i] = known[w[:-1]] + known[w[-1]]
        for i, own in rest.items():
            out[i] = b"".join(map(known.__getitem__, own))
        return out

    def of_chunks(self, keys: list[int], chunk_at) -> list[bytes]:
        """The ids of distinct chunks, by their hashes; chunk_at(i) is the i-th chunk's text."""
        young = self.young
        found = list(map(young.get, keys))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            new = []
            for i in missing:
                x = self.old.get(keys[i])
                if x is None:
                    new.append(i)
                else:
                    young[keys[i]] = found[i] = x
            if new:
                for i, ids in zip(new, self.learn([chunk_at(i) for i in new]), strict=True):
                    young[keys[i]] = found[i] = ids
            if len(young) > self.size:
                self.old, self.young = young, {}
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin and end."""
        start, end, row = word_spans(data, offsets, CHUNK)
        if not len(start):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        keys, first, which = np.unique(span_hashes(prefix_sums(data), start, end), return_index=True, return_inverse=True)
        raw, a, z = data.tobytes(), start[first].tolist(), end[first].tolist()
        ids = self.of_chunks(keys.tolist(), lambda i: raw[a[i] : z[i]].decode("utf-8", "replace"))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, at = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        n = size[which]
        out_end = np.cumsum(n)
        out = flat[np.repeat(at[which] - (out_end - n), n) + np.arange(out_end[-1])]
        return out, np.r_[0, out_end][np.searchsorted(row, np.arange(len(offsets)))]


def encoder(path: str) -> ChunkEncoder:
    if path not in _loaded:
        _loaded[path] = ChunkEncoder(path)
    return _loaded[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): the token pieces of each text, END_ID closing the last."""
    path = tokenizer or default_tokenizer()
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column(1)):
                flat, at = enc.encode(data, offsets)
                # the end id after each text's ids
                size = np.diff(at) + 1
                text_end = np.cumsum(size)
                text_start = text_end - size
                full = np.full(int(text_end[-1]), END_ID, "<u4")
                full[np.arange(len(flat)) + np.repeat(np.arange(len(size)), size - 1)] = flat
                n = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                a, view = text_start[doc] + start, memoryview(full).cast("B")
                crc = [zlib.crc32(view[4 * x : 4 * (x + k)]) for x, k in zip(a.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).slice(first, end - first).take(pa.array(doc)), piece.astype(np.int32), start, length, crc]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(full.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return texts(docs).mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best fit of counts[length] pieces, longest first. Rows: length, first rank, sequences, pieces in each, first sequence, place.

    Sequences that are equally full and follow each other make a class. A length fills the tightest class it fits, as many
    pieces to a sequence as fit, and splits it where the pieces end; what fits nowhere opens new sequences.
    """
    open_, heap, rows, sequences = {}, [], [], 0  # by room left: list of (first sequence, how many)

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            open_.setdefault(room, []).append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        heap = sorted(r for r in open_ if r >= length)
        heapq.heapify(heap)
        while left and heap:
            room = heap[0]
            if not open_.get(room):
                open_.pop(room, None)
                heapq.heappop(heap)
                continue
            first, n = open_[room].pop()
            each = room // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, full, each, first, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            first, n = first + full, n - full
            if n and left and left < each:
                rows.append((length, rank, 1, left, first, capacity - room))
                put(room - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(room, first, n)
        each = capacity // length
        for n, k in ((left // each, each), (1, left % each)):
            if n and k:
                rows.append((length, rank, n, k, sequences, 0))
                put(capacity - k * length, sequences, n)
                rank, sequences = rank + n * k, sequences + n
    return np.array(rows, np.int64).reshape(-1, 6)


def place(ranked: DataFrame, table: np.ndarray) -> DataFrame:
    """ranked (its columns, with length and slot) with sequence_id and offset by the plan, which has a few rows per length."""
    by_key = table[np.lexsort((table[:, 1], table[:, 0]))]
    keys = by_key[:, 0] << 44 | by_key[:, 1]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "slot"))
            r = by_key[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            d = rank - r[:, 1]
            extra = [pa.array(r[:, 4] + d // r[:, 3]), pa.array(r[:, 5] + d % r[:, 3] * length)]
            keep = [i for i, name in enumerate(b.schema.names) if name != "slot"]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + extra, names=[b.schema.names[i] for i in keep] + ["sequence_id", "offset"])

    rest = ranked.drop("slot")
    return ranked.mapInArrow(fill, ", ".join(f"`{c}` {t}" for c, t in rest.dtypes) + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Columns: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset. A null or empty text has the end id alone. Repeated rows
    are packed each; ties in rank are broken by content, so equal rows may swap places. A null doc_id stays null. An
    empty table gives an empty result. Other columns are left out.
    """
    made = staged(pieces(docs, tokenizer, capacity, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    return place(slots(made, "length", ("doc_id", "piece", "ids_crc32")), plan(counts, capacity))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
