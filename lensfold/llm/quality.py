"""Document quality by ordinal cumulative-link regression on hashed text.

Grades are ordered. One weight vector over hashed features gives a document's position on a line, and ordered thresholds
cut the line into grades: P(grade <= k) = logistic(threshold_k - position). The expected grade and the tail probabilities
follow, and documents are selected by a tail.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensfold.llm.common import Shared, blobs, column, merged_counts, text_slices, word_blocks

BITS = 18
SHAPE_WEIGHT = 4.0
_LETTERS, _DIGITS, _EDGE = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[0-9]+"), b"\"'()[]{}.,;:!?"


class Features(dict):
    """Word bytes -> (number of the word without edge punctuation, number of its shape). Letters of a shape are one ``a``."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= self.limit:
            self.clear()
        shape = _DIGITS.sub(b"0", _LETTERS.sub(b"a", word))
        mask = (1 << BITS) - 1
        self[word] = pair = xxhash.xxh64_intdigest(word.strip(_EDGE) or word, 2) & mask, xxhash.xxh64_intdigest(shape[:12], 3) & mask
        return pair

    def of(self, blob: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted feature numbers and values: 1 for each distinct word, and for each shape the root of its share of the words."""
        words, shapes, n = [], [], 0
        for block in word_blocks(blob):
            pairs = np.array([self[w] for w in block], np.int64).reshape(-1, 2)
            words.append(np.unique(pairs[:, 0]))
            shapes.append(np.unique(pairs[:, 1], return_counts=True))
            n += len(block)
        if not n:
            return np.empty(0, np.int64), np.empty(0)
        own = words[0] if len(words) == 1 else np.unique(np.concatenate(words))
        shape, count = merged_counts(shapes)
        return np.concatenate((own, shape)), np.concatenate((np.ones(len(own)), SHAPE_WEIGHT * np.sqrt(count / n)))


@dataclass
class Ordinal:
    """``weights`` shared by all grades 0..K, and K ascending ``thresholds``."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, position: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K, one row a document."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - position[:, None], -500, 500)))


def fit(number: np.ndarray, value: np.ndarray, ends: np.ndarray, grade: np.ndarray, grades: int, weight: np.ndarray | None = None, steps: int = 200, rate: float = 0.05, decay: float = 5e-4) -> Ordinal:
    """Maximise the penalised likelihood by full-batch Adam; documents are the stretches of ``number`` and ``value`` up to ``ends``."""
    n, doc = len(ends), np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    weight = np.ones(n) if weight is None else weight / weight.mean()
    share = np.array([(weight * (grade >= k)).mean() for k in range(1, grades)])
    share = np.clip(share, 1e-3, 1 - 1e-3)
    theta = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(theta), 0.1))
    x = np.concatenate((np.zeros(1 << BITS), theta[:1], gaps))
    m, v = np.zeros_like(x), np.zeros_like(x)
    rows = np.arange(n)
    for step in range(1, steps + 1):
        w, first, gaps = x[: 1 << BITS], x[1 << BITS], x[(1 << BITS) + 1 :]
        theta = first + np.r_[0.0, np.cumsum(np.exp(gaps))]
        position = np.bincount(doc, w[number] * value, n)
        below = 1 / (1 + np.exp(np.clip(position[:, None] - theta, -500, 500)))  # P(grade <= k), k = 0..K-1
        padded = np.concatenate((np.zeros((n, 1)), below, np.ones((n, 1))), axis=1)
        p = np.maximum(padded[rows, grade + 1] - padded[rows, grade], 1e-12)
        slope = padded * (1 - padded)
        up, down = weight * slope[rows, grade + 1] / p, weight * slope[rows, grade] / p
        g_position = (up - down) / n  # of the negative log-likelihood
        g_theta = np.zeros(grades - 1)
        np.add.at(g_theta, np.minimum(grade, grades - 2), np.where(grade <= grades - 2, -up, 0) / n)
        np.add.at(g_theta, np.maximum(grade - 1, 0), np.where(grade >= 1, down, 0) / n)
        g = np.concatenate((np.bincount(number, g_position[doc] * value, 1 << BITS) + decay * w, [g_theta.sum()], np.exp(gaps) * np.cumsum(g_theta[::-1])[::-1][1:]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Ordinal(x[: 1 << BITS].astype(np.float32), x[1 << BITS] + np.r_[0.0, np.cumsum(np.exp(x[(1 << BITS) + 1 :]))])


def learn(rated: DataFrame, docs: DataFrame, grades: int = 3, sample: int = 12_000) -> Ordinal:
    """Fit on ``rated(doc_id, grade)``, grades 0 to ``grades`` - 1, with the texts of ``docs(doc_id, text)``.

    About ``sample`` rated documents are used: half of them in the grades' own shares and half in equal shares, so that a
    rare grade is seen often, and in each grade those with the least hash of their id. The likelihood weighs a grade's
    rows back to its share. That many ids are sent to the scan of ``docs`` and that many feature lists reach the driver.
    Ratings that are null or outside the range, and null ids, teach nothing; of several ratings of an id the lowest counts,
    of several texts the least. Without ratings, or of an empty table, every grade is equally likely.
    """
    usable = rated.filter(F.col("grade").between(0, grades - 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    many = {r.grade: r["count"] for r in usable.groupBy("grade").count().collect()}
    total, chosen = sum(many.values()), usable.withColumn("weight", F.lit(1.0)).limit(0)
    for grade, n in sorted(many.items()):
        quota = min(n, round(sample / 2 * (n / total + 1 / len(many))))
        chosen = chosen.unionByName(usable.filter(F.col("grade") == grade).orderBy(F.xxhash64("doc_id"), "doc_id").limit(quota).withColumn("weight", F.lit(n / max(1, quota))))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade", "weight").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        for batch in text_slices(batches):
            found = [of.of(b) for b in blobs(batch, "text")]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "grade"), column(batch, "weight"), pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())), pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32()))], ["doc_id", "grade", "weight", "number", "value"])

    rows = texts.mapInArrow(features, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, grade int, weight double, number array<int>, value array<float>").toArrow().combine_chunks()
    if not rows.num_rows:
        return Ordinal(np.zeros(1 << BITS, np.float32), np.log(np.arange(1, grades) / np.arange(grades - 1, 0, -1)))
    rows = rows.sort_by("doc_id").combine_chunks()
    lists = rows["number"].combine_chunks()
    ends = np.cumsum(lists.value_lengths().to_numpy())
    return fit(lists.flatten().to_numpy().astype(np.int64), rows["value"].combine_chunks().flatten().to_numpy().astype(float), ends, rows["grade"].to_numpy().astype(np.int64), grades, rows["weight"].to_numpy())


def grade_documents(docs: DataFrame, model: Ordinal) -> DataFrame:
    """``doc_id, position, expected_grade, tails, grade`` for each row of ``docs(doc_id, text)``, from its whole text.

    ``tails`` holds P(grade >= k) for k = 1, 2, ..; ``expected_grade`` is their sum and ``grade`` the number of tails of one
    half or more. Null and empty texts have no features and stand at position 0. Repeated rows are graded each.
    """
    shared = Shared(docs.sparkSession, model)

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, of = shared.value, Features()
        for part in text_slices(batches):
            found = [of.of(b) for b in blobs(part, "text")]
            position = np.array([float(model.weights[i].astype(float) @ v) for i, v in found])
            tails = model.tails(position)
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(position), pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64())), pa.array((tails >= 0.5).sum(axis=1))], ["doc_id", "position", "expected_grade", "tails", "grade"])

    return docs.select("doc_id", "text").mapInArrow(grade, docs.select("doc_id", F.lit(0.0).alias("position"), F.lit(0.0).alias("expected_grade"), F.array().cast("array<double>").alias("tails"), F.lit(0).cast("long").alias("grade")).schema)


def rating(quality: Column, toxic: Column) -> Column:
    """The graded rating of a label: 0 toxic, 1 of low quality, 2 good."""
    return F.when(toxic == 1, 0).when(quality == 1, 2).when(quality == 0, 1)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, expected_grade, p_clean, p_good, grade, toxic, selected``: the query ``op2``.

    ``p_clean`` is P(grade >= 1), ``p_good`` P(grade >= 2). ``toxic`` marks documents graded 0, ``selected`` those graded 2.
    """
    model = learn(labels.select("doc_id", rating(F.col("quality"), F.col("toxic")).alias("grade")), docs)
    return grade_documents(docs, model).select("doc_id", "expected_grade", F.col("tails")[0].alias("p_clean"), F.col("tails")[1].alias("p_good"), "grade", (F.col("grade") == 0).alias("toxic"), (F.col("grade") == 2).alias("selected"))
