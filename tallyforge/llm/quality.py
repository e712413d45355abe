"""Quality classifier by supervised subword embeddings.

A word's vector is the mean of the learned vectors of its hashed whole form and of its hashed character n-grams; a document's the mean
over its tokens; a softmax over the two labels turns it into a probability. A word that repeats one of the last REACH words also
counts as one of a few marker tokens, so that loops are words to the model. All is trained by stochastic gradient descent in numpy, on
a sample of at most SAMPLE labelled rows, about, taken by a hash of the doc_id; the model is one broadcast of fixed size.

The score is linear in the document's mean, so in prediction each distinct word costs its subwords once per worker and each
text one sum over its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.shared import held_out, mixed, read, short_batches, texts

#: Labelled rows (whole texts) that the fit takes, at most about; hash buckets; vector length; passes; rows in a step.
SAMPLE, BUCKETS, DIM, EPOCHS, BATCH, RATE = 2400, 1 << 17, 8, 4, 32, 4.0
N_GRAMS = (3, 4)
#: Distinct words that a worker remembers; then it starts afresh.
CACHE = 300_000
#: Texts whose new words are looked up together.
STEP = 256
#: Steps of a fit at least: a small sample is passed more often.
STEPS = 300
#: Marker tokens: a word equal to the one before, and to one of the REACH before that.
REACH = 4
AGAIN, NEAR = "\x01again", "\x01near"


ODD = np.random.default_rng(20240611).integers(1, 2**62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each word's whole form and of each of its character n-grams, < and > standing at its ends."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    end = np.cumsum(size)
    word = np.repeat(np.arange(len(words)), size)
    left = end[word] - np.arange(len(codes))  # characters from here to the word's end
    place = (size[word] - left).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    whole = np.add.reduceat(mixed(codes * ODD[0] + place * ODD[1]), end - size) if len(words) else np.zeros(0, np.uint64)
    who, hashes = [np.arange(len(words))], [mixed(whole)]
    for n in N_GRAMS:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, np.uint64)
            for k in range(n):
                h = h * ODD[2] + codes[k : len(codes) - n + 1 + k]
            inside = np.flatnonzero(left[: len(h)] >= n)
            who.append(word[inside])
            hashes.append(mixed(h[inside] * ODD[3]))
    return np.concatenate(who), (np.concatenate(hashes) >> np.uint64(20)).astype(np.int64) % BUCKETS


def tokens(text: str) -> list[str]:
    """Words between white space, and the markers of repetition."""
    words = text.split()
    again = sum(map(str.__eq__, words[1:], words))
    near = 0
    for back in range(2, 2 + REACH):
        near += sum(map(str.__eq__, words[back:], words))
    return words + [AGAIN] * again + [NEAR] * near


@dataclass
class Model:
    vectors: np.ndarray
    weights: np.ndarray
    bias: float
    products: np.ndarray | None = None

    def word_scores(self, words: list[str]) -> list[float]:
        """What each word adds to the score of a text that is it alone, without the bias."""
        who, bucket = subwords(words)
        return (np.bincount(who, self.by_bucket()[bucket], len(words)) / np.bincount(who, minlength=len(words))).tolist()

    def by_bucket(self) -> np.ndarray:
        if self.products is None:
            self.products = self.vectors @ self.weights
        return self.products


def fit(rows: list[tuple[str, int]], seed: int = 7) -> Model:
    """The model of (text, label) rows, label 0 or 1. Without rows of both labels the score is the smoothed share of label 1."""
    labels = np.array([y for _, y in rows], float)
    share = (labels.sum() + 1) / (len(labels) + 2)
    rng = np.random.default_rng(seed)
    model = Model((rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM, np.zeros(DIM, np.float32), float(np.log(share / (1 - share))))
    if len(set(labels)) < 2:
        return model
    number: dict[str, int] = {}
    counted = []  # each document as word numbers and their shares of its tokens
    for text, _ in rows:
        own = Counter(tokens(text))
        ids = np.fromiter((number.setdefault(w, len(number)) for w in own), np.int32, len(own))
        counted.append((ids, np.fromiter(own.values(), np.float32, len(own)) / max(1, own.total())))
    words, parts = list(number), []
    for at in range(0, len(words), 20_000):
        who, bucket = subwords(words[at : at + 20_000])
        parts.append((np.bincount(who, minlength=min(20_000, len(words) - at)), bucket[np.argsort(who, kind="stable")].astype(np.int32)))
    del number, words
    n_sub, bucket = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(2))
    ends = np.cumsum(n_sub)
    docs = []
    for at, share_of in counted:  # each document as buckets and their shares of its mean
        k = n_sub[at]
        ids = bucket[np.repeat(ends[at] - np.cumsum(k), k) + np.arange(k.sum())]
        distinct, where = np.unique(ids, return_inverse=True)
        docs.append((distinct, np.bincount(where, np.repeat(share_of / np.maximum(k, 1), k), len(distinct)).astype(np.float32)))
    del counted, parts, bucket
    per_epoch = -(-len(docs) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // per_epoch))
    steps, total_steps = 0, epochs * per_epoch
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(docs), BATCH):
            rate = RATE * (1 - steps / total_steps)
            chosen = order[at : at + BATCH]
            ids = np.concatenate([docs[i][0] for i in chosen])
            parts = np.concatenate([docs[i][1] for i in chosen])
            row = np.repeat(np.arange(len(chosen)), [len(docs[i][0]) for i in chosen])
            mean = np.stack([np.bincount(row, parts * model.vectors[ids, d], len(chosen)) for d in range(DIM)], axis=1)
            p = 1 / (1 + np.exp(-(mean @ model.weights + model.bias)))
            error = (labels[chosen] - p) / len(chosen)
            step = (rate * error)[row] * parts
            old = model.weights.copy()
            model.weights += (rate * error @ mean).astype(np.float32)
            model.bias += rate * error.sum() * 0.1
            if not steps:
                old = model.weights  # all weights start at 0
            distinct, where = np.unique(ids, return_inverse=True)
            # the mean of a document moves by the squared shares only: the vectors' rate makes up for their number
            model.vectors[distinct] += (np.bincount(where, step, len(distinct))[:, None] * old * 100).astype(np.float32)
            steps += 1
    return model


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """The model of the labelled rows: labels (doc_id, quality) with docs (doc_id, text). Null labels and ids, and ids with both labels, are left out."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_other")).where("quality = _other").drop("_other")
    sizes = {r["quality"]: r["n"] for r in own.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in sizes.items():  # at most half the sample from each label
        share = F.when(F.col("quality") == label, min(1.0, limit / 2 / n)).otherwise(share)
    chosen = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * float(1 << 20))
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")  # about limit rows, by their shares
    found = sorted((r["doc_id"], r["text"] or "", r["quality"]) for r in rows.collect())
    model = fit([(t, q) for _, t, q in found])
    if len(sizes) == 2:  # the sample is balanced; the table isn't
        kept = {label: min(1.0, limit / 2 / n) for label, n in sizes.items()}
        model.bias += float(np.log(kept[0] / kept[1]))
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with all its columns as a struct rest, and score, the probability of label 1, of each row's whole text.

    A null or empty text has the score of the bias alone. Repeated rows give a row each, an empty table none.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("rest"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}
        for b in batches:
            out = []
            for first in range(0, len(b), STEP):
                split = [tokens(t or "") for t in b.column(1).slice(first, STEP).to_pylist()]
                if len(known) > CACHE:
                    known.clear()
                new = list({w for words in split for w in words if w not in known})
                known.update(zip(new, m.word_scores(new) if new else [], strict=True))
                out += [m.bias + (sum(map(known.__getitem__, words)) / len(words) if words else 0.0) for words in split]
            out = 1 / (1 + np.exp(-np.clip(np.array(out, float), -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["rest", "score"])

    return rows.mapInArrow(run, f"rest {rows.schema['rest'].dataType.simpleString()}, score double")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of docs (doc_id, text), as scored gives them; other columns are left out."""
    return scored(texts(docs), model).select("rest.doc_id", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = predict(docs, train(docs, labels.where(~held_out("doc_id", 3, 1))))
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
