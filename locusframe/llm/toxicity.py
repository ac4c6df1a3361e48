"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios (Wang and Manning, 2012).

A document's features are the n-grams of its distinct words. They add up over words, so a word has a score of its own,
which each task caches: scoring costs a lookup a word. The model is fitted on the driver on a bounded sample of labelled
rows (``per_class`` of each class, texts of at most ``train_chars``); scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import table, union_all

SIZES = (3, 4, 5)
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
CACHED_WORDS = 200_000
WORDS_AT_ONCE = 10_000
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """The distinct lower-cased words of a text; null has none."""
    return set(_LETTERS.findall((text or "").lower()))


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every character n-gram of ``<word>``, for all words at once."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))  # characters from here to the word's end
    owners, buckets = [], []
    mixed = np.zeros(len(code), np.uint64)
    for n in range(1, max(SIZES) + 1):
        mixed = (mixed[: len(code) - n + 1] + code[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        if n in SIZES:
            inside = left[: len(mixed)] >= n
            owners.append(word[: len(mixed)][inside])
            buckets.append(((mixed[inside] + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


class Model:
    """bias + sum over distinct words of (sum over n-grams of weight x log-count ratio)."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.cache: dict[str, float] = {}

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], weights: list[float] | None = None, rounds: int = 120, smooth: float = 1.0, ridge: float = 3e-4) -> Model:
        """``weights``: how many rows each row of a sample stands for; the loss and the bias are those of all rows."""
        y = np.array(labels, np.float64)
        each = np.ones(len(y)) if weights is None else np.array(weights, np.float64)
        mean_of = lambda x: (each * x).sum() / each.sum()
        if not 0 < y.sum() < len(y):
            share = min(max(mean_of(y) if len(y) else 0.0, 1e-4), 1 - 1e-4)
            return cls(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
        number: dict[str, int] = {}
        doc_words = [[number.setdefault(w, len(number)) for w in sorted(words_of(t))] for t in texts]
        words = list(number)
        row = np.repeat(np.arange(len(texts)), [len(x) for x in doc_words])
        col = np.array([w for x in doc_words for w in x], np.int64)
        gram_word, gram = grams_of(words)

        def scores(w: np.ndarray) -> np.ndarray:
            of_word = np.bincount(gram_word, w[gram], len(words))
            return np.bincount(row, of_word[col], len(texts))

        def back(of_doc: np.ndarray) -> np.ndarray:
            of_word = np.bincount(col, of_doc[row], len(words))
            return np.bincount(gram, of_word[gram_word], BUCKETS)

        positive, negative = back(y) + smooth, back(1 - y) + smooth
        ratio = np.log(positive / positive.sum()) - np.log(negative / negative.sum())
        weight, bias = np.zeros(BUCKETS), float(np.log(mean_of(y) / (1 - mean_of(y))))
        mean, square = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
        for t in range(1, rounds + 1):  # Adam on the ridge-penalised logistic loss
            error = 1 / (1 + np.exp(-np.clip(scores(weight * ratio) + bias, -30, 30))) - y
            slope = np.r_[back(each * error) * ratio / each.sum() + ridge * weight, mean_of(error)]
            mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
            step = 0.02 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
            weight, bias = weight - step[:-1], bias - step[-1]
        return cls((weight * ratio).astype(np.float32), float(bias))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if len(self.cache) > CACHED_WORDS:
            self.cache = {}
        words = [words_of(t) for t in texts]
        missing = list(set().union(*words).difference(self.cache)) if words else []
        for k in range(0, len(missing), WORDS_AT_ONCE):
            some = missing[k : k + WORDS_AT_ONCE]
            owner, bucket = grams_of(some)
            self.cache.update(zip(some, np.bincount(owner, self.weights[bucket], len(some)).tolist()))
        total = np.array([sum(sorted(map(self.cache.__getitem__, x))) for x in words]) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2000, train_chars: int = 20_000) -> Model:
    """Fit on at most ``per_class`` rows of each class, drawn by hash, with crc32(doc_id) mod 5 other than 0.

    A row of a sampled class counts as many times as there are labels for each drawn, so scores and the 0.5 cut follow the
    class shares of all training labels at any table size.
    Rows with a null id, text or label and texts of over ``train_chars`` characters are passed over; of rows that share an
    id one is taken. With no row of one class every score is the share of the other.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(_fold() != 0)
    picked = union_all([known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)])
    texts = docs.where(F.col("text").isNotNull() & (F.char_length("text") <= train_chars)).select("doc_id", "text")
    # At most 2 * per_class ids are broadcast; texts are not shuffled.
    sample = sorted(texts.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).select("text", "toxic").collect())
    counts = dict(known.groupBy("toxic").count().collect())
    return Model.fit([r[0] for r in sample], [r[1] for r in sample], [max(1.0, counts[r[1]] / per_class) for r in sample])


def _fold():
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5


def _scorer(model: Broadcast, text_col: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                yield part.append_column("__score", pa.array(model.value.score(part[text_col].to_pylist()), pa.float64()))

    return score


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__score``, 0 to 1, from the text alone. Null or empty text gets the model's base score; rows may
    repeat; an empty table gives no rows; other columns pass through."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model), text_col), f"{schema}, __score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), F.col("__score").alias("score"), F.when(F.col("__score") >= 0.5, 1).otherwise(0).alias("predicted"))
