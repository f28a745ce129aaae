"""Language identification by rank-order profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lensfold.llm.common import Counter64, column, id_remainder, merged_counts, text_slices

#: Stands for a word edge inside n-grams; it is no letter.
EDGE = 1
BLOCK = 1 << 20


class Letters:
    """Which code points are letters; looked up once each."""

    def __init__(self):
        self.known = np.full(0x110000, -1, np.int8)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        is_letter = self.known[points]
        if (is_letter < 0).any():
            for p in np.unique(points[is_letter < 0]):
                self.known[p] = chr(p).isalpha()
            is_letter = self.known[points]
        return is_letter.astype(bool)


def ngrams(text: str, letters: Letters) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of letters of the lower-cased text; words are edged, and no gram spans two words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    a = np.where(letters(points), points, EDGE).astype(np.int64)
    a = np.concatenate(([EDGE], a, [EDGE]))
    a = a[np.r_[True, (a[1:] != EDGE) | (a[:-1] != EDGE)]]
    if len(a) < 3:
        return a[:0]
    pairs = a[:-1] << 21 | a[1:]
    triples = (pairs[:-1] << 21 | a[2:])[a[1:-1] != EDGE]
    return np.concatenate((a[a != EDGE], pairs, triples))


def pieces(text: str, size: int = BLOCK) -> Iterator[str]:
    """The text in pieces of ``size`` characters, and more where a word goes on, so that no word is cut."""
    start = 0
    while start < len(text):
        end = min(len(text), start + size)
        while end < len(text) and text[end - 1].isalpha() and text[end].isalpha():
            end += 1
        yield text[start:end]
        start = end


def gram_counts(text: str, letters: Letters, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of a text and their counts, taken piece by piece."""
    return merged_counts([np.unique(ngrams(piece, letters), return_counts=True) for piece in pieces(text, size)] or [(np.empty(0, np.int64),) * 2])


def top(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys, ties by smaller key, best first."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.argsort(-counts, kind="stable")][:size]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters, by_lang = Letters(), {}

    def rows(lang: str) -> pa.RecordBatch:
        keys, counts = by_lang[lang].flush()
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])

    for batch in text_slices(batches):
        for text, lang in zip(column(batch, "text").to_pylist(), column(batch, "lang").to_pylist(), strict=True):
            counter = by_lang.setdefault(lang, Counter64())
            for piece in pieces(text):
                counter.add(ngrams(piece, letters))
            if counter.full():
                yield rows(lang)
    for lang in by_lang:
        yield rows(lang)


def learn_profiles(labelled: DataFrame, size: int = 400, max_languages: int = 2000) -> dict[str, np.ndarray]:
    """Profiles from ``labelled(text, lang)``: each language's ``size`` most frequent n-grams over all rows, best first.

    Counts are summed inside each task, then by Spark; ``size`` rows a language reach the driver, and more than
    ``max_languages`` labels are an error, which bounds what is sent. Null texts or labels teach nothing.
    """
    counts = labelled.select("text", "lang").filter("text is not null and lang is not null").mapInArrow(_count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size).select("lang", "gram", "rank")
    profiles: dict[str, np.ndarray] = {}
    for lang, gram, rank in rows.limit(size * max_languages + 1).collect():
        profiles.setdefault(lang, np.full(size, -1, np.int64))[rank - 1] = gram
    if len(profiles) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    return {lang: grams[grams >= 0] for lang, grams in sorted(profiles.items())}


class Ranker:
    """Out-of-place distances of a text to all profiles."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.langs, self.size, self.letters = list(profiles), size, Letters()
        self.grams = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.int64)]))
        #: rank of each known n-gram (rows) in each profile; ``size`` where absent, as for unknown n-grams (last row)
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        for i, grams in enumerate(profiles.values()):
            self.ranks[np.searchsorted(self.grams, grams), i] = np.arange(len(grams))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 minus the least distance over the largest possible one. Ties go to the first language by name."""
        if text is None or not self.langs:
            return "und", 0.0
        own = top(*gram_counts(text, self.letters), self.size)
        if not len(own):
            return "und", 0.0
        at = np.searchsorted(self.grams, own)
        at = np.where(self.grams[np.minimum(at, len(self.grams) - 1)] == own, at, len(self.grams)) if len(self.grams) else np.zeros(len(own), int)
        known = self.ranks[at]
        far = np.where(known < 0, self.size, np.abs(known - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (len(own) * self.size))


def identify_language(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = 400) -> DataFrame:
    """Add ``lang_pred string, score double`` to ``docs`` (needs ``text``), each row from its whole text alone.

    Null texts and texts without a letter (empty ones too) give ``und`` and 0; repeated rows get the same answer; a very
    long text is counted in pieces that end between words. Columns of the names added are replaced; all others pass through unread.
    """
    docs = docs.drop("lang_pred", "score")
    schema = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = Ranker(profiles, size)
        for part in text_slices(batches):
            found = [rank(t) for t in column(part, "text").to_pylist()]
            arrays = [*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(predict, schema)


def predict_languages(docs: DataFrame, size: int = 400) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learn where crc32(doc_id) mod 4 is not 2, predict for every row."""
    held = id_remainder("doc_id", 4) == 2
    profiles = learn_profiles(docs.filter(~held), size)
    return identify_language(docs.select("doc_id", held.alias("held_out"), "text"), profiles, size).select("doc_id", "held_out", "lang_pred", "score")
