"""Token counts by distinct pre-tokens: no text's ids are ever built.

1. Each text is cut into pre-tokens, which are counted per document (one pass). Documents stand in units of about UNIT bytes; within
   a unit a pre-token is a number. A table in the shared folder keeps the documents' (number, times) lists and each unit's pre-tokens,
   numbered and listed by hash buckets.
2. A bucket has each of its pre-tokens from all units: the distinct ones' pieces are counted once, by the tokenizer's model, and every
   unit gets its list's counts back, in its order. However often a pre-token occurs, a unit asks for it once.
3. Each unit sums times x pieces over its documents' lists.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.shared import prefix_sums, read, shared_dir, span_hashes, texts

LIMIT = 512
#: Bytes of text in a unit; a longer document is a unit of its own. There is a bucket of pre-tokens for each BUCKET bytes of text.
UNIT, BUCKET = 16 << 20, 16 << 20
# fixed values: the byte-level pre-tokenizer's pattern
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of which this module's and the tokenizer's pattern libraries know the same classes; texts with others go through the tokenizer's.
OTHER = regex.compile(r"[^\x00-\u0530\u2010-\u2070\u20a0-\u20bf\u2190-\u2600\u3000-\u9fa5\uac00-\ud7a3\uff00-\uffef]")
_loaded: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PreTokens:
    """The pre-tokens of texts, and the pieces of a pre-token, by a byte-level BPE tokenizer file without normaliser; others are refused.

    Special strings in texts are one token each, as by the library's default.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens") or []
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and model.get("type") == "BPE" and not model.get("dropout")
        if not plain or any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: not a byte-level BPE file without normaliser, whose pre-tokens can be counted apart")
        self.split, self.find = Tokenizer.from_file(path).pre_tokenizer, regex.compile(PATTERN).findall
        self.special = {t["content"] for t in added}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.by_model = Tokenizer(Tokenizer.from_file(path).model)
        self.by_model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def plain(self, text: str) -> list[str]:
        if OTHER.search(text):
            return [text[a:z] for _, (a, z) in self.split.pre_tokenize_str(text)]
        return self.find(text)

    def counts(self, text: str) -> Counter:
        """How often each pre-token occurs."""
        if self.at_special is None or not self.at_special.search(text):
            return Counter(self.plain(text))
        out: Counter = Counter()
        for part in self.at_special.split(text):
            out.update([part] if part in self.special else self.plain(part))
        return out

    def pieces(self, words: list[str]) -> list[int]:
        found = self.by_model.encode_batch_fast(words, add_special_tokens=False)
        return [1 if w in self.special else len(e.ids) for w, e in zip(words, found, strict=True)]


def pre_tokens(path: str) -> PreTokens:
    if path not in _loaded:
        _loaded[path] = PreTokens(path)
    return _loaded[path]


KINDS = pa.schema([("unit", pa.int64()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("steps", pa.binary()), ("times", pa.binary()), ("words", pa.list_(pa.string()))])


def narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs, after a byte that says how many those are."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


class Unit:
    """The documents of a unit with their pre-tokens' numbers, in order of first use until the unit ends."""

    def __init__(self, number: int):
        self.number, self.room = number, 0
        self.words: defaultdict = defaultdict()
        self.words.default_factory = self.words.__len__
        self.ids, self.sizes, self.lists = [], [], []

    def add(self, doc_id: int | None, size: int, counts: Counter) -> None:
        self.ids.append(doc_id)
        self.sizes.append(size)
        self.room += size
        n = len(counts)
        self.lists.append((np.fromiter(map(self.words.__getitem__, counts), np.int32, n), np.fromiter(counts.values(), np.int64, n)))

    def rows(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """Rows of the documents, whose numbers go by bucket now, and one row of words for each bucket."""
        words = pa.array(list(self.words), pa.string())
        bucket = np.zeros(0, np.int64)
        if len(words):
            offsets = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].astype(np.int64)
            hashes = span_hashes(prefix_sums(np.frombuffer(words.buffers()[2] or b"", np.uint8)), offsets[:-1], offsets[1:])
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        for i in range(0, len(self.ids), 1000):
            rows = []
            for doc_id, size, (which, times) in zip(self.ids[i : i + 1000], self.sizes[i : i + 1000], self.lists[i : i + 1000], strict=True):
                at = place[which]
                by = np.argsort(at)
                rows.append((self.number, None, doc_id, size, narrow(np.diff(at[by], prepend=0)), narrow(times[by]), None))
            yield self.batch(rows)
        first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        listed = words.take(pa.array(order))
        for i in range(0, len(first), 1000):
            starts = first[i : i + 1000]
            ends = np.r_[first[i + 1 : i + 1001], len(order)][: len(starts)]
            yield self.batch([(self.number, int(bucket[order[a]]), None, None, None, None, listed[a:z].to_pylist()) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)])

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), KINDS, strict=True)], schema=KINDS)


def frequencies(docs: DataFrame, path: str, unit_bytes: int, buckets: int) -> DataFrame:
    """Rows of documents (unit, doc_id, n_bytes, steps, times) and of their units' pre-tokens (unit, bucket, words), written once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, unit = pre_tokens(path), Unit(TaskContext.get().partitionId() << 32)
        for batch in batches:
            bytes_of = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for doc_id, size, text in zip(batch.column(0).to_pylist(), bytes_of, batch.column(1), strict=True):
                if unit.ids and unit.room + size > unit_bytes:
                    yield from unit.rows(buckets)
                    unit = Unit(unit.number + 1)
                unit.add(doc_id, size, own.counts(text.as_py() or ""))
        if unit.ids:
            yield from unit.rows(buckets)

    made = docs.mapInArrow(count, "unit long, bucket int, doc_id long, n_bytes long, steps binary, times binary, words array<string>")
    folder = f"{shared_dir(docs.sparkSession)}/pre-tokens-{uuid.uuid4().hex}"
    made.write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(made.schema).parquet(folder)


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, unit_bytes: int = UNIT, bucket_bytes: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for each row of docs (doc_id, text).

    Counts are those of the tokenizer file without begin, end or added special tokens; special strings inside texts are one token each. A
    null text counts as empty and has no tokens; a null doc_id stays null; repeated rows are counted each. A pre-token may be as long as a
    text. An empty table gives an empty result; other columns are left out, whatever their names.
    """
    path, docs = tokenizer or default_tokenizer(), texts(docs)
    pre_tokens(path)  # refuses here what it can't count
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    table = frequencies(docs, path, unit_bytes, max(1, -(-total // bucket_bytes)))

    def pieces(asked: pa.Table) -> pa.Table:
        """The pieces of the pre-tokens of a bucket, for each unit in its order."""
        asked = asked.combine_chunks()
        lists = asked.column("words").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        words, found = coded.dictionary.to_pylist(), []
        for i in range(0, len(words), 10_000):
            found += pre_tokens(path).pieces(words[i : i + 10_000])
        values = np.array(found, np.int64)[coded.indices.to_numpy()]
        ends = np.cumsum(lists.value_lengths().to_numpy())
        return pa.table({"unit": asked.column("unit"), "bucket": asked.column("bucket"), "pieces": pa.array([narrow(x) for x in np.split(values, ends[:-1])], pa.binary())})

    def sums(own: pa.Table, answers: pa.Table) -> pa.Table:
        by = np.argsort(answers.column("bucket").to_numpy())
        listed = answers.column("pieces").to_pylist()
        pieces = np.concatenate([np.zeros(0, np.int64)] + [wide(listed[i]) for i in by])
        steps, times = own.column("steps").to_pylist(), own.column("times").to_pylist()
        tokens = [int(pieces[np.cumsum(wide(a))] @ wide(b)) if len(a) > 1 else 0 for a, b in zip(steps, times, strict=True)]
        return pa.table({"doc_id": own.column("doc_id"), "n_bytes": own.column("n_bytes"), "n_tokens": pa.array(tokens, pa.int64()), "over_limit": pa.array([n > limit for n in tokens], pa.bool_())})

    asked = table.where("bucket IS NOT NULL").select("unit", "bucket", "words")
    answers = asked.groupBy("bucket").applyInArrow(pieces, "unit long, bucket int, pieces binary").withColumnRenamed("unit", "of")
    documents = table.where("bucket IS NULL").select("unit", "doc_id", "n_bytes", "steps", "times")
    return documents.groupBy("unit").cogroup(answers.groupBy("of")).applyInArrow(sums, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
