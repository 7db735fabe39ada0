"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its features: hashed words, hashed character
n-grams inside words, and hashed pairs of neighbouring words (a word that repeats its
predecessor gives one common feature). A softmax over two outputs, trained together with
the vectors by stochastic gradient descent in numpy, tells label 1 from label 0.

Because the mean and the output layer are linear, a document's logit is the sum of its
words' logits over the count of its features plus a bias; scoring keeps the logit and the
feature count of each distinct word and needs no vector arithmetic for a document.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Grown, hash_share, mapped, slices, spare_name, stored, word_hashes, WordTable

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


@dataclass(frozen=True)
class QualityParams:
    """``sample`` bounds the labelled documents that the model is fitted to (expected number)."""

    buckets: int = 1 << 17
    width: int = 10
    grams: tuple[int, int] = (3, 5)
    sample: int = 3000
    epochs: int = 4
    rate: float = 0.6
    seed: int = 20
    threshold: float = 0.7


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return (h >> np.uint64(64 - int(np.log2(buckets)))).astype(np.int64)


def word_features(words: list[bytes], params: QualityParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of the words, the word of each, and the words' 64-bit hashes."""
    hashes = word_hashes(words)
    texts = [f"<{w.decode(errors='replace')}>" for w in words]
    code = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, texts), np.int64, len(texts)))
    buckets, owners = [_bucket(hashes, params.buckets)], [np.arange(len(words))]
    low, high = params.grams
    rolled = code
    for n in range(2, high + 1):
        if len(rolled) < 2:
            break
        rolled = rolled[:-1] * _STEP + code[n - 1 :]
        if n >= low:
            inside = owner[: len(rolled)] == owner[n - 1 :]
            buckets.append(_bucket(rolled[inside] + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64)), params.buckets))
            owners.append(owner[: len(rolled)][inside])
    return np.concatenate(buckets), np.concatenate(owners), hashes


def pair_buckets(h: np.ndarray, params: QualityParams) -> np.ndarray:
    """Buckets of the pairs of neighbours in a sequence of word hashes; a repeated word has the pair 0."""
    left, right = h[:-1], h[1:]
    return _bucket(np.where(left == right, np.uint64(1), (left * np.uint64(3)) ^ (right * np.uint64(5)) ^ _MIX), params.buckets)


def _document_features(text: bytes, params: QualityParams) -> tuple[np.ndarray, np.ndarray]:
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter((distinct[w] for w in words), np.int64, len(words))
    buckets, owner, hashes = word_features(list(distinct), params)
    weight = np.bincount(ids, minlength=len(distinct))[owner]
    both = np.concatenate([buckets, pair_buckets(hashes[ids], params)])
    weights = np.concatenate([weight, np.ones(len(words) - 1, np.int64)])
    feature, inverse = np.unique(both, return_inverse=True)
    return feature, np.bincount(inverse, weights=weights) / weights.sum()


@dataclass
class QualityModel:
    """``logit``: of a feature in each bucket; ``bias``: of a document without features."""

    logit: np.ndarray
    bias: float
    params: QualityParams

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, logit=self.logit.astype(np.float32), bias=np.array([self.bias]))
        return out.getvalue()

    @staticmethod
    def unpack(data: bytes, params: QualityParams) -> QualityModel:
        x = np.load(io.BytesIO(data))
        return QualityModel(x["logit"].astype(np.float64), float(x["bias"][0]), params)


def train(texts: list[bytes], labels: list[int], params: QualityParams) -> QualityModel:
    """Stochastic gradient descent, a document at a time, with a rate that falls to nothing."""
    rng = np.random.default_rng(params.seed)
    vectors = (rng.random((params.buckets, params.width), np.float32) - 0.5) / params.width
    output, bias = np.zeros((params.width, 2), np.float32), np.zeros(2)
    documents = [(f, w.astype(np.float32)) for f, w in (_document_features(t, params) for t in texts)]
    step, steps = 0, max(1, params.epochs * len(documents))
    for _ in range(params.epochs):
        for i in rng.permutation(len(documents)).tolist():
            rate, step = params.rate * (1 - step / steps), step + 1
            feature, weight = documents[i]
            rows = vectors[feature]
            hidden = weight @ rows
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = output @ p.astype(np.float32)
            output -= (rate * np.outer(hidden, p)).astype(np.float32)
            bias -= 0.1 * rate * p
            # a step in the mean moves each vector by its weight; scaled up so that long documents still train their words
            vectors[feature] = rows - np.float32(rate) * weight[:, None] * back * np.float32(min(64.0, max(1.0, len(feature) / 8)))
    direction = output[:, 1] - output[:, 0]
    return QualityModel((vectors @ direction).astype(np.float64), float(bias[1] - bias[0]), params)


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> QualityModel:
    """Fits to a sample of the labelled documents, chosen by a hash of their ids, in one task.

    The sample holds about ``params.sample`` documents, or all if there are fewer: the one
    bound here. Rows with a null id, text or label are left out; an id labelled twice takes
    its larger label. With no labelled rows the model scores everything 0.5.
    """
    given = labels.select(F.col(id_column).alias("_id"), F.col(label_column).cast("int").alias("_label")).dropna()
    share = min(1.0, params.sample / max(1, given.count()))
    # written first: its size, about ``sample`` rows, is then known when the join is planned
    given = stored(given.filter(hash_share(F.col("_id"), params.seed) < share).groupBy("_id").agg(F.max("_label").alias("_label")), "labels")
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("text")).dropna().join(given, "_id")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((i, t, y) for b in batches for i, t, y in zip(b.column("_id").to_pylist(), b.column("text").to_pylist(), b.column("_label").to_pylist(), strict=True))
        if found:
            yield pa.RecordBatch.from_pydict({"model": [train([t.encode() for _, t, _ in found], [int(y > 0) for *_, y in found], params).pack()]})

    made = mapped(rows.repartition(1), task, "model binary").collect()
    return QualityModel.unpack(bytes(made[0][0]), params) if made else QualityModel(np.zeros(params.buckets), 0.0, params)


class Scorer:
    """Scores texts in a worker; keeps each distinct word's logit and number of features."""

    def __init__(self, model: QualityModel):
        self.model, self.table, self.resets = model, WordTable(), 0
        self.logit, self.count, self.hashes = Grown(np.float64), Grown(np.int64), Grown(np.uint64)

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        ids, counts = self.table.ids(texts)
        if self.table.resets != self.resets:
            self.resets = self.table.resets
            for grown in (self.logit, self.count, self.hashes):
                grown.clear()
        if fresh := self.table.take_fresh():
            buckets, owner, hashes = word_features(fresh, self.model.params)
            self.logit.extend(np.bincount(owner, weights=self.model.logit[buckets], minlength=len(fresh)))
            self.count.extend(np.bincount(owner, minlength=len(fresh)))
            self.hashes.extend(hashes)
        doc = np.repeat(np.arange(len(texts)), counts)
        total = np.bincount(doc, weights=self.logit.data[ids], minlength=len(texts))
        n = np.bincount(doc, weights=self.count.data[ids], minlength=len(texts))
        if len(ids) > 1:
            inside = doc[:-1] == doc[1:]
            pair = self.model.logit[pair_buckets(self.hashes.data[ids], self.model.params)][inside]
            total += np.bincount(doc[:-1][inside], weights=pair, minlength=len(texts))
            n += np.bincount(doc[:-1][inside], minlength=len(texts))
        z = total / np.maximum(n, 1) + self.model.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def score(
    docs: DataFrame, model: QualityModel, *, text_column: str = "text", keep: list[str] | None = None, threshold: float | None = None, score_column: str = "score", predicted_column: str = "predicted"
) -> DataFrame:
    """``keep`` columns (default: all) with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on).

    Every whole text is scored; a null or empty text has no features and gets the model's
    bias. Columns of the input called score or predicted are replaced; other names can be given for the results.
    """
    added = [score_column, predicted_column]
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    threshold = model.params.threshold if threshold is None else threshold
    # the text goes to the workers once, also if it is kept
    source = text_column if text_column in keep else spare_name(keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if source == text_column else [F.col(text_column).alias(source)]))
    shared, params = spark.sparkContext.broadcast(model.pack()), model.params
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumns({score_column: F.lit(0.0), predicted_column: F.lit(0)}).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(QualityModel.unpack(shared.value, params))
        for part, texts in slices(batches, source):
            s = scorer(texts)
            columns = [part.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, *added])

    return mapped(rows, task, schema)
