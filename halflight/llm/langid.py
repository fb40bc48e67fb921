"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Fitted by follow-the-regularised-leader with elastic-net penalties on a bounded sample, then
calibrated by one temperature on samples that the fit has not seen. Document frequencies count all
training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halflight.operators.keys import broadcast_if_small
from halflight.session import cut_lineage

#: Hashed n-grams, and their lengths.
BUCKETS, ORDERS = 1 << 15, (1, 2, 3)
#: Rows of each language that the fit sees, about; the bound of its one task.
ROWS_PER_LANGUAGE = 1500
#: More labels than this are not languages.
MAX_LANGUAGES = 500
#: Learning rate, its start, elastic net, passes over the sample, share kept for the temperature.
ALPHA, BETA, L1, L2, PASSES, CALIBRATION = 0.5, 1.0, 0.05, 0.01, 4, 0.2
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of a whole text and how often each occurs; empty without letters.

    Words are runs of letters in lower case, with a blank on either side.
    """
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[code]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.concatenate(([32], np.where(letter, code, 32), [32])).astype(np.uint64)
    code = code[np.concatenate(([True], (code[1:] != 32) | (code[:-1] != 32)))]
    found, rolling = [], np.zeros(len(code), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        rolling = rolling[:len(code) - order + 1] * np.uint64(1000003) + code[order - 1:]
        if order in ORDERS:
            mixed = (rolling + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
            found.append((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
    counts = np.bincount(np.concatenate(found), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _tfidf(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, counts = ngrams(text)
    x = (1 + np.log(counts)) * idf[at]
    size = np.sqrt((x * x).sum())
    return at, x / size if size else x


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Documents with letters, and the number of them that hold each bucket; over all rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held = 0, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch["text"]:
                at, _ = ngrams(text)
                total += len(at) > 0
                held[at] += 1
        at = np.flatnonzero(held)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(held[at], total)})

    parts = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "bucket long, n long")
    rows = parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS + 1 rows at most
    held = np.zeros(BUCKETS)
    total = 0
    for bucket, n in rows:
        if bucket < 0:
            total = n
        else:
            held[bucket] = n
    return total, held


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x buckets
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ x + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        at, x = _tfidf(text, self.idf)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(at, x) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max())
    return e / e.sum()


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: int, seed: int = 11):
    """Weights and bias from ``(buckets, values, language)`` by follow-the-regularised-leader.

    Each weight has its own learning rate; the L1 part keeps it at zero until its gradients add up.
    The last column, always 1, is the bias and has no penalty.
    """
    z, n = np.zeros((languages, BUCKETS + 1)), np.zeros((languages, BUCKETS + 1))
    l1 = np.append(np.full(BUCKETS, L1), 0.0)
    order = np.random.default_rng(seed)

    def weights(at):
        zs, ns = z[:, at], n[:, at]
        w = -(zs - np.sign(zs) * l1[at]) / ((BETA + np.sqrt(ns)) / ALPHA + L2)
        return np.where(np.abs(zs) <= l1[at], 0.0, w)

    for _ in range(PASSES):
        for i in order.permutation(len(rows)):
            at, x, language = rows[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            error = _softmax(w @ x)
            error[language] -= 1
            g = error[:, None] * x
            pull = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / ALPHA
            z[:, at] += g - pull * w
            n[:, at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:, :-1], w[:, -1]


def temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least log loss, by golden section between 1/20 and 20."""
    if not len(truth):
        return 1.0

    def loss(log_t: float) -> float:
        v = logits / np.exp(log_t)
        v = v - v.max(axis=1, keepdims=True)
        return float((np.log(np.exp(v).sum(axis=1)) - v[np.arange(len(truth)), truth]).mean())

    low, high, golden = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _parted(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Rows ``(.., .., language, hash)`` that are kept for the temperature, and those that teach.

    The hash decides, so that equal texts stay together. A language of which all texts would be kept
    is taught by them.
    """
    step = round(1 / CALIBRATION)
    kept = {r[3] for r in rows if (r[3] >> 30) % step == 0}  # the draw looks at the bits below
    taught = {r[2] for r in rows if r[3] not in kept}
    kept -= {r[3] for r in rows if r[2] not in taught}
    return [r for r in rows if r[3] in kept], [r for r in rows if r[3] not in kept]


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang",
          rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Model of the rows of ``docs`` that have a label; all rows give document frequencies.

    The fit's sample is about ``rows_per_language`` different texts of each label, drawn by a hash of
    the text, and goes through one task. Copies of a text are one text, however many they are, and are
    either taught or kept for the temperature. Rows without letters and rows with a null label teach
    nothing.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = rows.filter("label is not null and text is not null")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    counts = cut_lineage(rows.select("label", "hash").distinct().groupBy("label").agg(
        F.count(F.lit(1)).alias("n")))
    languages = sorted(r.label for r in counts.limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    total, held = document_frequencies(rows.select("text"))
    idf = np.log((1 + total) / (1 + held)) + 1
    if not languages:
        return Model([], idf, np.zeros((0, BUCKETS)), np.zeros(0))
    draw = F.pmod("hash", F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(broadcast_if_small(counts), "label").filter(
        draw < F.least(F.lit(1.0), rows_per_language / F.col("n"))).select("text", "label", "hash")
    number = {name: i for i, name in enumerate(languages)}

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = set()  # drawn texts of this partition, so that copies do not travel
        for batch in batches:
            rows = []
            for text, label, key in zip(batch["text"], batch["label"], batch["hash"], strict=True):
                if (label, key) not in done:
                    done.add((label, key))
                    at, x = _tfidf(text, idf)
                    if len(at):
                        rows.append((number[label], key, at.astype(np.int32), x.astype(np.float32)))
            yield pd.DataFrame(rows, columns=["language", "hash", "at", "x"])

    # the draw runs in every partition; only drawn vectors go to the one task
    sample = sample.mapInPandas(vectors, "language int, hash long, at array<int>, x array<float>")
    sample = sample.dropDuplicates(["language", "hash"]).repartition(1)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = []
        for batch in batches:
            seen += zip(batch["at"], batch["x"], batch["language"], batch["hash"], strict=True)
        seen.sort(key=lambda r: (r[2], r[3]))  # whatever order rows came in
        kept, taught = _parted(seen)
        w, bias = fit([r[:3] for r in taught], len(languages))
        logits = np.array([w[:, at] @ x + bias for at, x, *_ in kept]).reshape(-1, len(languages))
        t = temperature(logits, np.array([r[2] for r in kept], int))
        yield pd.DataFrame({"language": range(len(languages)), "bias": bias, "temperature": t,
                            "weights": list(w.astype(np.float32))})

    learnt = sample.mapInPandas(
        learn, "language int, bias double, temperature double, weights array<float>")
    got = sorted(learnt.collect())
    if not got:  # no drawn text has letters, and Spark runs no task for no rows
        return Model(languages, idf, np.zeros((len(languages), BUCKETS)), np.zeros(len(languages)))
    return Model(languages, idf.astype(np.float32),
                 np.array([r.weights for r in got], np.float32), np.array([r.bias for r in got]),
                 got[0].temperature)


def predict_language(text: Column, model: Model) -> Column:
    """``struct<language: string, score: double>`` of a text column.

    ``und`` with score 0 where the text is null or has no letter, and everywhere if the model has
    learnt no language. Equal texts get equal answers.
    """

    @F.pandas_udf("language string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([model.predict(t) for t in batch], columns=["language", "score"])

    return run(text)
