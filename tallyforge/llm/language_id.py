"""Language identification by prediction by partial matching.

For each language a context tree of bytes, variable in order up to ORDER: a byte is coded in its longest known context by its count
there, or by an escape and the next shorter context (escape of method C), down to a uniform byte. Statistics are frozen after
training, so the code length of a byte depends on the ORDER bytes before it and itself alone: one table over the seen
(ORDER + 1)-grams holds exact code lengths for all languages, and shorter tables serve what it misses. A text's language
is the one with the shortest code.

Training counts (language, gram) in Spark over a sample: whole texts of at most DOCS_PER_LANGUAGE documents of each
language, about, taken by a hash of the doc_id. The tables go to the executors as one broadcast bounded by that sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.shared import LOWER, blocks, held_out, read, staged

ORDER, DOCS_PER_LANGUAGE, START = 4, 1500, 10
#: Bytes of text scored at a time.
STEP = 1 << 19
LETTER = re.compile(r"[^\W\d_]")
ASCII_LETTERS = np.zeros(256, bool)
ASCII_LETTERS[65:91] = ASCII_LETTERS[97:123] = True


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the (ORDER + 1)-gram that ends with it, as a number; before a text stand ORDER newlines. A-Z are lower-cased."""
    n_rows = len(offsets) - 1
    padded = np.full(len(data) + ORDER * n_rows, START, np.uint64)
    at = np.arange(len(data)) + ORDER * np.repeat(np.arange(1, n_rows + 1), np.diff(offsets))
    padded[at] = LOWER[data]
    out = np.zeros(len(data), np.uint64)
    for back in range(ORDER, -1, -1):
        out = out << np.uint64(8) | padded[at - back]
    return out


class Lookup:
    """Row number of each known key, -1 for others: a table by hash, and a search where two keys share a place."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.shift = np.uint64(64 - max(4, int(len(self.keys) * 4).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), np.int32)
        place = self.place(self.keys)
        self.table[place] = np.arange(len(self.keys))
        self.lost = np.flatnonzero(self.table[place] != np.arange(len(self.keys)))  # their place is another key's

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        row = self.table[self.place(keys)]
        missed = np.flatnonzero(self.keys[row] != keys)
        if len(missed):
            own, wanted = self.keys[self.lost], keys[missed]
            if len(own):
                at = np.searchsorted(own, wanted)
                at[at == len(own)] = 0
                row[missed] = np.where(own[at] == wanted, self.lost[at], -1)
            else:
                row[missed] = -1
        return row


class Model:
    """Code lengths in bits. costs[k]: for known (k + 1)-grams, by language; escapes[k]: for known contexts of k bytes."""

    def __init__(self, languages: list[str], counts: pd.DataFrame):
        """counts: lang (position in languages), gram ((ORDER + 1) bytes), n."""
        self.languages = languages
        n_langs = max(1, len(languages))
        lang, gram, n = (counts[c].to_numpy() for c in ("lang", "gram", "n"))
        gram = gram.astype(np.int64).astype(np.uint64)
        self.costs: list[tuple[Lookup, np.ndarray]] = []
        self.escapes: list[tuple[Lookup, np.ndarray]] = []
        for k in range(ORDER + 1):
            own = gram & np.uint64((1 << 8 * (k + 1)) - 1)
            look = Lookup(own)
            seen = np.zeros((len(look.keys), n_langs))
            np.add.at(seen, (look(own), lang), n)
            context = look.keys >> np.uint64(8)
            contexts = Lookup(context)
            at = contexts(context)
            total, kinds = np.zeros((len(contexts.keys), n_langs)), np.zeros((len(contexts.keys), n_langs))
            np.add.at(total, at, seen)
            np.add.at(kinds, at, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                direct = -np.log2(seen / (total + kinds)[at])
            shorter = self.shorter(look.keys & np.uint64((1 << 8 * k) - 1), k, n_langs)
            cost = np.where(seen > 0, direct, escape[at] + shorter)
            self.costs.append((look, cost.astype(np.float32)))
            self.escapes.append((contexts, escape.astype(np.float32)))

    def shorter(self, keys: np.ndarray, k: int, n_langs: int) -> np.ndarray:
        """Code lengths of k-grams (order k - 1); of nothing known, a uniform byte."""
        if k == 0:
            return np.full((len(keys), n_langs), 8.0)
        look, cost = self.costs[k - 1]
        row = look(keys)
        out = cost[row].astype(float) if len(cost) else np.zeros((len(keys), n_langs))
        missed = np.flatnonzero(row < 0)
        if len(missed):
            contexts, escape = self.escapes[k - 1]
            at = contexts(keys[missed] >> np.uint64(8))
            more = np.where(at[:, None] >= 0, escape[at], 0.0) if len(escape) else 0.0
            out[missed] = more + self.shorter(keys[missed] & np.uint64((1 << 8 * (k - 1)) - 1), k - 1, n_langs)
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text by language; a text much longer than STEP is summed in parts."""
        n_langs = max(1, len(self.languages))
        sums = np.zeros((len(offsets) - 1, n_langs))
        keys = grams(data, offsets)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for at in range(0, len(keys), STEP):
            cost, own = self.shorter(keys[at : at + STEP], ORDER + 1, n_langs), row[at : at + STEP]
            new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            sums[own[new]] += np.add.reduceat(cost, new, axis=0)
        return sums


def train(docs: DataFrame, lang_col: str = "lang", limit: int = DOCS_PER_LANGUAGE) -> Model:
    """The model of docs (doc_id, text, lang), from about limit documents of each language; rows without text or language are left out."""
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    languages = sorted(sizes)
    if not languages:
        return Model([], pd.DataFrame({"lang": np.zeros(0, np.int64), "gram": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)}))
    table = F.create_map(*[x for i, name in enumerate(languages) for x in (F.lit(name), F.struct(F.lit(i).alias("number"), F.lit(min(1.0, limit / sizes[name])).alias("share")))])
    rows = rows.withColumn("own", table[F.col("lang")])
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.col("own.share") * float(1 << 20)).select(F.col("own.number").alias("lang"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(0).to_numpy(zero_copy_only=False)
            for first, end, data, offsets in blocks(b.column(1), 4 << 20):
                gram, lang = grams(data, offsets).astype(np.int64), np.repeat(langs[first:end].astype(np.int64), np.diff(offsets))
                pair, n = np.unique(gram | lang << 40, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair >> 40), pa.array(pair & (1 << 40) - 1), pa.array(n)], names=["lang", "gram", "n"])

    counts = staged(sample.mapInArrow(count, "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    return Model(languages, counts.toArrow().to_pandas())


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    sums = np.r_[0, np.cumsum(ASCII_LETTERS[data])]
    out = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = bool(LETTER.search(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs (doc_id, text): the language of the shortest code and its share of exp2(-bits) over all.

    `und` with score 0 where the text is null or has no letter, or nothing was learned; of equal codes the first language in
    order of names. Repeated rows give a row each; an empty table none; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            names, scores = [], []
            for _, _, data, offsets in blocks(b.column(1), STEP):
                known = has_letter(data, offsets) & bool(m.languages)
                bits = m.bits(data, offsets)
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                names += [m.languages[i] if k else "und" for i, k in zip(best, known, strict=True)]
                scores += np.where(known, share, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs, train(docs.where(~held_out("doc_id", 4, 2))))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
