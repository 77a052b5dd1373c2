"""Quality classifier: supervised subword embeddings, trained by numpy gradient descent.

A document's features are hashed words, pairs of neighbouring words (a repeated
word is a feature of its own), word shapes and character n-grams inside words.
Each feature has a learned vector; the vectors are averaged within each of the
four families, the families averaged, and a softmax gives the classes. As the
output is linear in the average, a trained model scores with one number per
feature bucket; workers get that table (1 MiB).

The model is trained on the driver, on at most MAX_TRAIN_DOCS labelled
documents of at most MAX_TRAIN_DOC_BYTES bytes each, those with the smallest
hashes of their ids. Every document is scored, over its whole text.

Defined results: a null or empty text has no features and gets the prior's
score; labels that are null are ignored; with labels of one class or none the
score is the smoothed share of label 1 (0.5 without labels); a null doc_id is
never held out; repeated rows are scored alike; the input's columns come back
as they were, and the score's column is renamed should they hold one like it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .bytesvec import SPACE, R, mix, pieces, powers, span_hashes, text_buffer, words
from .staging import free_name, give_back, prepare

BUCKETS = 1 << 18
DIM = 8
GRAMS = (3, 4)
FAMILIES = 4
EPOCHS = 6
RATE = 0.3
MAX_TRAIN_DOCS = 4000
MAX_TRAIN_DOC_BYTES = 32 * 1024
FOLDS, HELD_OUT = 3, 1

#: Bytes to shape classes: capitals, small letters, digits; bytes of longer UTF-8 sequences count as small letters.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 97


def features(raw: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of every feature occurrence, by family."""
    mask = np.uint64(BUCKETS - 1)
    start, end, text = words(raw, off, SPACE)
    h = span_hashes(raw, start, end)
    out = [((mix(h) & mask), text)]
    pair_text = text[1:][text[1:] == text[:-1]]
    both = text[1:] == text[:-1]
    x, y = h[:-1][both], h[1:][both]
    pair = mix(x * np.uint64(R) + y)
    out.append((np.where(x == y, mix(np.full(len(x), 77, np.uint64)), pair) & mask, pair_text))
    # Shapes: classes with runs of one class taken together.
    classes = _SHAPE[raw]
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = classes[1:] != classes[:-1]
    cuts = off[1:-1]
    keep[cuts[cuts < len(raw)]] = True
    short = classes[keep]
    at = np.concatenate(([0], np.cumsum(keep)))[off]
    s, e, t = words(short, at, SPACE)
    out.append((mix(span_hashes(short, s, e) + np.uint64(11)) & mask, t))
    # Character n-grams of words with a blank before and behind.
    n = len(raw)
    blank = SPACE[raw]
    r, ri = powers(n + 1)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((np.where(blank, np.uint8(32), raw).astype(np.uint64) + np.uint64(1)) * r[:n], out=prefix[1:])
    blanks = np.concatenate(([0], np.cumsum(blank)))
    of = np.repeat(np.arange(len(off) - 1), np.diff(off))
    grams, texts = [], []
    for k in GRAMS:
        if n < k:
            continue
        i = np.arange(n - k + 1)
        inner = blanks[i + k - 1] - blanks[i + 1]
        ok = (inner == 0) & (of[: n - k + 1] == of[k - 1 :])
        i = i[ok]
        g = mix((prefix[i + k] - prefix[i]) * ri[i] + np.uint64(k))
        grams.append(g & mask)
        texts.append(of[i])
    out.append((np.concatenate(grams), np.concatenate(texts)) if grams else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return [(b.astype(np.int64), t) for b, t in out]


class Model:
    """weights: each bucket's share of the difference between the classes' outputs; bias: that of an empty text."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, col: pa.Array) -> np.ndarray:
        out = np.zeros(len(col))
        for start, stop in pieces(col, 1 << 20):
            raw, off = text_buffer(col.slice(start, stop - start))
            z = np.full(stop - start, self.bias)
            if len(raw):
                for bucket, text in features(raw, off):
                    total = np.bincount(text, weights=self.weights[bucket], minlength=stop - start)
                    z += total / np.maximum(np.bincount(text, minlength=stop - start), 1) / FAMILIES
            out[start:stop] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return out


def _examples(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text, its distinct buckets and their weights in its average."""
    out = []
    for start, stop in pieces(texts, 1 << 18):  # features take some hundred times a piece
        raw, off = text_buffer(texts.slice(start, stop - start))
        if not len(raw):
            out += [(np.zeros(0, np.int64), np.zeros(0))] * (stop - start)
            continue
        parts = features(raw, off)
        code = np.concatenate([t * BUCKETS + b for b, t in parts])
        weight = np.concatenate([1 / np.maximum(np.bincount(t, minlength=stop - start), 1)[t] / FAMILIES for _, t in parts])
        code, back = np.unique(code, return_inverse=True)
        weight = np.bincount(back, weights=weight)
        cut = np.searchsorted(code, np.arange(stop - start + 1) * BUCKETS)
        bucket = (code % BUCKETS).astype(np.int32)
        out += [(bucket[a:b], weight[a:b]) for a, b in zip(cut, cut[1:])]
    return out


def train(texts: pa.Array, labels: np.ndarray, seed: int = 0, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Minimise the softmax's cross-entropy by stochastic gradient descent over small batches, with a falling rate."""
    prior = (labels.sum() + 1) / (len(labels) + 2)
    start = float(np.log(prior / (1 - prior)))
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS), start)
    rng = np.random.default_rng(seed)
    examples = _examples(texts)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out = np.zeros((2, DIM))
    bias = np.array([0.0, start])
    target = np.eye(2)[labels.astype(int)]
    size, steps = 16, 0
    total = epochs * -(-len(examples) // size)
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for i in range(0, len(order), size):
            batch = order[i : i + size]
            bucket = np.concatenate([examples[k][0] for k in batch])
            weight = np.concatenate([examples[k][1] for k in batch])
            row = np.repeat(np.arange(len(batch)), [len(examples[k][0]) for k in batch])
            lr = rate * (1 - steps / total)
            hidden = np.zeros((len(batch), DIM))
            for d in range(DIM):
                hidden[:, d] = np.bincount(row, weights=vectors[bucket, d] * weight, minlength=len(batch))
            z = hidden @ out.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - target[batch]) * lr
            step = error @ out
            out -= error.T @ hidden
            bias -= 0.1 * error.sum(0)
            # A step is divided by the squared norm of its document's weights, so long texts learn as fast as short ones.
            step /= np.maximum(np.bincount(row, weights=weight * weight, minlength=len(batch)), 1e-12)[:, None]
            for d in range(DIM):
                np.subtract.at(vectors[:, d], bucket, weight * step[row, d])
            steps += 1
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))


def fold(doc_id):
    """The remainder that decides whether a row's label may be learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def training_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN_DOCS) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels to learn from: not held out, the `most` rows with the smallest hashes of their ids."""
    label = F.col("quality").cast("int")
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.alias("label"))
        .filter(label.isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(most)
    )
    # At most `most` rows of 12 bytes: the limit is the bound on what is broadcast.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
        .filter(F.octet_length("text") <= MAX_TRAIN_DOC_BYTES)
        .join(F.broadcast(picked), "doc_id")
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("label", "ascending"), ("text", "ascending")])
    )
    rows = rows.slice(0, most)  # repeated ids may bring more
    return rows.column("text").combine_chunks(), rows.column("label").to_numpy()


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN_DOCS) -> Model:
    texts, y = training_sample(docs, labels, most)
    model = train(texts, y)
    del texts
    give_back(docs.sparkSession)
    return model


def with_score(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """docs and a double column `name` (underscores are added while docs has a column of that name)."""
    name = free_name(name, docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            col = batch.column(at).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(col))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels), "score")
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
