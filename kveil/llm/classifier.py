"""Quality classifier: supervised subword embeddings.

A word has one hashed vector of its own and one for each of its character n-grams
(bytes, with border marks); their mean is the word's vector. The mean over all words, and
one vector for words equal to their predecessor, weighted by their share, make up the
document's. A softmax layer turns it into class probabilities. Vectors and layer
are learned together by numpy stochastic gradient descent in one Spark task, over a
sample of at most ``SAMPLE_ROWS`` labelled rows of at most ``SAMPLE_BYTES`` each; the
model has a fixed size. All rows are scored, with their whole texts.

The output layer is linear, so scoring needs one number per bucket: the dot product of
its vector with the difference of the class weights.

Null and wordless texts get the score of the bias alone. Null labels are not learned
from; rows with a null id are scored and held out. Without any labelled row every score
is 0.5. Repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kveil.llm import words

SAMPLE_ROWS = 4000
SAMPLE_BYTES = 1 << 18
BUCKETS = 1 << 17
DIM = 8
EPOCHS = 8
RATE = 4.0
GRAMS = (3, 4, 5)
SAME = BUCKETS  # the vector of words equal to their predecessor
ROWS = BUCKETS + 1


class Model(NamedTuple):
    vectors: np.ndarray  # ROWS x DIM
    layer: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2

    def folded(self) -> tuple[np.ndarray, float]:
        """Score difference of the classes per bucket, and for no word at all."""
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def word_features(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all distinct words, word after word, and where each word begins."""
    n = len(distinct)
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    bounds = np.frombuffer(distinct.buffers()[1], np.int64)[: n + 1]
    data = np.frombuffer(distinct.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    sizes = np.diff(bounds)
    marked = np.full(len(data) + 2 * n + 8, ord(">"), np.uint8)
    begin = np.append(0, np.cumsum(sizes + 2))
    marked[begin[:-1]] = ord("<")
    marked[words.ranges(begin[:-1] + 1, sizes)] = data
    total = int(begin[-1])
    place = np.arange(total) - np.repeat(begin[:-1], sizes + 2)
    left = np.repeat(sizes + 2, sizes + 2) - place
    owner = np.repeat(np.arange(n), sizes + 2)
    with np.errstate(over="ignore"):
        whole = words.mix(words.Words(data, bounds - bounds[0], np.ones(256, bool), False).hashes())
        parts, owners = [whole], [np.arange(n)]
        gram = np.zeros(total, np.uint64)
        for k in range(max(GRAMS)):
            gram = gram * np.uint64(0x100000001B3) + marked[k : total + k]
            if k + 1 in GRAMS:
                fits = left >= k + 1
                parts.append(words.mix(gram[fits] + np.uint64(k)))
                owners.append(owner[fits])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    buckets = (np.concatenate(parts)[order] % np.uint64(BUCKETS)).astype(np.int64)
    return buckets, np.append(0, np.cumsum(np.bincount(owner, minlength=n)))


def repeats(codes: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Running count of words equal to the word before them in their text."""
    same = np.append(False, codes[1:] == codes[:-1])[: len(codes)]
    same[ptr[:-1][ptr[:-1] < len(codes)]] = False
    return np.append(0, np.cumsum(same))


def document_features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text, its distinct buckets and their weights."""
    for i, j in words.slices(offsets):
        part = words.split(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=False)
        codes, distinct = part.codes()
        buckets, at = word_features(distinct)
        again = repeats(codes, part.ptr)
        for a, b in zip(part.ptr[:-1].tolist(), part.ptr[1:].tolist()):
            own, times = np.unique(codes[a:b], return_counts=True)
            size = at[own + 1] - at[own]
            ids, inverse = np.unique(buckets[words.ranges(at[own], size)], return_inverse=True)
            weight = np.repeat(times / (max(1, b - a) * size), size)
            weight = np.bincount(inverse, weight, len(ids))
            yield np.append(ids, SAME), np.append(weight, (again[b] - again[a]) / max(1, b - a)).astype(np.float32)


def train(data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """Stochastic gradient descent with a linearly falling rate, one document a step."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((ROWS, DIM)) - 0.5) / DIM).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    docs = list(document_features(data, offsets))
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)).tolist():
            ids, weight = docs[i]
            rate = RATE * (1 - done / steps)
            done += 1
            rows = vectors[ids]
            hidden = weight @ rows
            logit = hidden @ layer + bias
            error = np.exp(logit - logit.max())
            error /= error.sum()
            error[labels[i]] -= 1
            back = layer @ error
            layer -= rate * np.outer(hidden, error)
            bias -= 0.05 * rate * error
            vectors[ids] = rows - rate * weight[:, None] * back
    return Model(vectors, layer, bias)


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """text and label of the training rows, the first by a hash of the id."""
    draw = F.xxhash64("doc_id", F.lit(11))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))
    )
    chosen = usable.orderBy(draw, "label").limit(SAMPLE_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small = texts.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    # At most SAMPLE_ROWS labels; rows of one id are cut to the bound again.
    joined = small.join(F.broadcast(chosen), "doc_id")
    return joined.orderBy(draw, F.xxhash64("text"), "label").limit(SAMPLE_ROWS).select("text", "label")


def _train(table: pa.Table) -> pa.Table:
    labels = table["label"].to_numpy()
    order = np.lexsort((labels, table["tkey"].to_numpy()))
    table = table.take(pa.array(order))
    model = train(*words.flat(table["text"]), labels[order])
    return pa.table([pa.array([x.astype("<f4").tobytes()], pa.binary()) for x in model], names=["vectors", "layer", "bias"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Train on the sample; the model (a few MB, whatever the input) comes to the driver."""
    rows = sample(docs, labels, label).withColumn("tkey", F.xxhash64("text"))
    got = rows.groupBy(F.lit(0).alias("one")).applyInArrow(_train, "vectors binary, layer binary, bias binary").collect()
    if not got:
        return Model(np.zeros((ROWS, DIM), np.float32), np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32))
    return Model(*(np.frombuffer(x, "<f4").reshape(shape) for x, shape in zip(got[0], ((ROWS, DIM), (DIM, 2), (2,)))))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value
        for batch in batches:
            data, offsets = words.flat(batch.column(1))
            out = []
            for i, j in words.slices(offsets):
                part = words.split(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=False)
                codes, distinct = part.codes()
                buckets, at = word_features(distinct)
                sums = np.append(0, np.cumsum(table[buckets], dtype=np.float64))
                word = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(1, np.diff(at))
                sums = np.append(0, np.cumsum(word[codes]))
                again = repeats(codes, part.ptr)
                total = sums[part.ptr[1:]] - sums[part.ptr[:-1]] + table[SAME] * (again[part.ptr[1:]] - again[part.ptr[:-1]])
                out.append(total / np.maximum(1, np.diff(part.ptr)) + bias)
            logit = np.concatenate(out) if out else np.zeros(0)
            score = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score of label 1 and predicted label of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.folded())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_score(shared), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
