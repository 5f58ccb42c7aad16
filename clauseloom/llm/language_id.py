"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.shared import bound_batches, ship

#: Hashed n-grams of one to three characters.
ORDERS, BITS = 3, 14
#: Label of texts without a letter.
UNKNOWN = "und"
#: Documents that the classifier is fitted on, over all languages, as expected number; every fifth calibrates.
SAMPLE = 6000

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@cache
def _letters() -> np.ndarray:
    """For every code point its folded form, or a blank if it is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


#: Code points folded at a time.
SLICE = 1_000_000


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """(bucket, count) of the n-grams of a whole text, and whether it has a letter.

    Runs of other characters than letters are one blank, and a blank stands before and after the text. Long texts
    are folded a slice at a time; each slice goes on from the last folded characters of the one before, so every
    n-gram is counted once, wherever the cuts are.
    """
    total, any_letter = np.zeros(1 << BITS, np.int64), False
    text = text or ""
    before, counted = np.array([32], np.uint32), 0  # folded characters before the slice, and how many are counted
    for start in range(0, max(1, len(text)), SLICE):
        code = np.frombuffer(text[start : start + SLICE].encode("utf-32-le", "surrogatepass"), "<u4")
        chars = _letters()[np.minimum(code, 0x10FFFF)]
        blank = chars == 32
        any_letter = any_letter or not blank.all()
        parts = [before, chars[~(blank & np.r_[before[-1] == 32, blank[:-1]])] if len(chars) else chars]
        chars = np.concatenate(parts)
        if start + SLICE >= len(text) and chars[-1] != 32:
            chars = np.append(chars, np.uint32(32))
        name = np.zeros(len(chars), np.uint32)
        for n in range(min(ORDERS, len(chars))):
            name = (name[: len(chars) - n] ^ (chars[n:] + np.uint32(n + 1))) * _MULTIPLIERS[n]
            new = name[max(0, counted - n) :]  # those that end behind what is counted
            total += np.bincount((new ^ (new >> np.uint32(15))) >> np.uint32(32 - BITS), minlength=1 << BITS)
        before = chars[-(ORDERS - 1) :]
        counted = len(before)
    found = np.flatnonzero(total) if any_letter else np.empty(0, np.int64)
    return found, total[found], any_letter


def _weighted(found: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[found]
    return x / max(np.sqrt(x @ x), 1e-12)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and documents with each bucket, summed over a task; bucket -1 counts the documents."""
    total, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            total[counts(text.as_py())[0]] += 1
            n += 1
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, found].astype(np.int32)), pa.array(np.r_[n, total[found]])], ["bucket", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [counts(text.as_py())[:2] for text in batch.column(1)]
        buckets = pa.array([f.astype(np.int32) for f, _ in rows], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), buckets, pa.array([n.astype(np.int32) for _, n in rows], pa.list_(pa.int32()))],
                                         ["lang", "buckets", "counts"])


@dataclass
class Ftrl:
    """Follow-the-regularised-leader with an elastic-net penalty, one weight vector a language."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_labels: int, epochs: int = 3) -> np.ndarray:
        z = np.zeros((1 << BITS, n_labels))
        g2 = np.zeros_like(z)
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                at, x = rows[i]
                w, root = self.weights(z[at], g2[at]), np.sqrt(g2[at])
                logits = x @ w
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[labels[i]] -= 1
                g = x[:, None] * p
                g2[at] += g * g
                z[at] += g - (np.sqrt(g2[at]) - root) / self.alpha * w
        return self.weights(z, g2)

    def weights(self, z: np.ndarray, g2: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(g2)) / self.alpha + self.l2))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden-section search between 1/20 and 20."""

    def loss(log_t: float) -> float:
        x = logits / np.exp(log_t)
        x = x - x.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(x)), labels]))

    a, b, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    while b - a > 1e-3:
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        found, n, any_letter = counts(text)
        if not any_letter or not self.labels:
            return UNKNOWN, 0.0
        logits = _weighted(found, n, self.idf) @ self.weights[found] / self.temperature
        p = np.exp(logits - logits.max())
        best = int(np.argmax(p))
        return self.labels[best], float(p[best] / p.sum())


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the rows of ``docs`` (doc_id, text, lang) with a lang.

    The document counts of the IDF cover all those rows. The weights are fitted on a sample of about ``sample``
    documents, in equal parts from each language, chosen by a hash of the doc_id; it is all that reaches the driver.
    Whole texts count, whatever their length; repeated rows count again; null and empty texts have no n-grams and
    texts without a letter teach nothing; of equally frequent languages the first by name counts. Without a row with a
    lang, as in an empty table, the model knows no language.
    """
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    known = docs.where("lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    labels = sorted(sizes)
    if not labels:
        return Model([], np.zeros(1 << BITS), np.zeros((1 << BITS, 0)), 1.0)
    df = np.zeros(1 << BITS)
    total = known.select("text").mapInArrow(_document_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = total.column(0).to_numpy(), total.column(1).to_numpy()
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    idf = np.log((1 + n[bucket < 0].sum()) / (1 + df)) + 1
    share = {k: min(1.0, sample / len(labels) / v) for k, v in sizes.items()}
    per_lang = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("sample")), F.lit(1_000_000)) / 1e6
    chosen = known.where(draw < F.coalesce(per_lang[F.col("lang")], F.lit(0.0))).select("lang", "text")
    rows = chosen.mapInArrow(_features, "lang string, buckets array<int>, counts array<int>").toArrow().sort_by([("lang", "ascending")])
    number = {k: i for i, k in enumerate(labels)}
    features, targets = [], []
    for lang, found, n in zip(rows.column(0), rows.column(1), rows.column(2), strict=True):
        if len(found.values):
            found = found.values.to_numpy().astype(np.int64)
            features.append((found, _weighted(found, n.values.to_numpy(), idf)))
            targets.append(number[lang.as_py()])
    del rows
    pa.default_memory_pool().release_unused()  # the driver goes on to other work
    order = sorted(range(len(features)), key=lambda i: (features[i][0].tobytes(), features[i][1].tobytes(), targets[i]))
    features, y = [features[i] for i in order], np.array([targets[i] for i in order], np.int64)
    held = np.arange(len(features)) % 5 == 4
    weights = Ftrl().fit([f for f, h in zip(features, held, strict=True) if not h], y[~held], len(labels))
    scale = 1.0
    if held.any():
        scale = temperature(np.stack([x @ weights[at] for (at, x), h in zip(features, held, strict=True) if h]), y[held])
    return Model(labels, idf, weights, scale)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with lang_pred and score (columns of those names are replaced).

    ``text`` names the text, with points if it lies inside a struct; it goes to the workers once. Null and empty texts
    and texts without a letter give ``und`` and score 0, as does a model without languages. Texts of any length are
    judged as a whole; ties go to the language first by name; repeated rows give repeated results; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    bound_batches(spark)
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    own = docs.select(F.struct(*columns).alias("carried"))
    sent = spark.sparkContext.broadcast(model)  # 16,384 rows for each of the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for name in text.split("."):
                texts = texts.field(name)
            out = [sent.value.predict(x.as_py()) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())],
                ["carried", "lang_pred", "score"])

    made = own.mapInArrow(run, f"carried {own.schema['carried'].dataType.simpleString()}, lang_pred string, score double")
    return made.select("carried.*", "lang_pred", "score")
