"""Licence scan by a positional rare-token index.

Notices are word sequences with mandatory key phrases. The index files, for each notice, its key phrases' words of highest
IDF (counted over all documents) with their positions. A file's words of that kind are looked up; postings of one notice
meet where their relative positions agree, which fixes the place of the whole notice. There the key phrases are verified word
by word, and the share of the notice's IDF weight that stands in place is its score. A verified notice holds all words
of its key phrases, so no place is missed, whatever words the index files.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensfold.llm.common import Shared, blobs, column, text_slices
from lensfold.llm.decontaminate import FOLD

# The phrases and labels asked for.
PHRASES = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))

# Sentences that licences prescribe for notices, and in each the phrases that must stand there.
NOTICES = (
    ("gpl", "licensed under the GNU General Public License", ("GNU General Public License",)),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("General Public License, version 2",)),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("General Public License, version 3",)),
    (
        "gpl-2.0-or-later",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version",
        ("GNU General Public License", "version 2 of the License"),
    ),
    (
        "gpl-3.0-or-later",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version",
        ("GNU General Public License", "version 3 of the License"),
    ),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ("GNU Lesser General Public License",)),
    ("agpl", "under the terms of the GNU Affero General Public License", ("GNU Affero General Public License",)),
    ("apache", "licensed under the Apache License", ("Apache License",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("Apache License, Version 2.0",)),
    ("cc-by", "licensed under CC BY", ("CC BY",)),
    ("cc-by-4.0", "licensed under CC BY 4.0", ("CC BY 4.0",)),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ("CC BY-SA 4.0",)),
    ("cc-by-nd-4.0", "licensed under CC BY-ND 4.0", ("CC BY-ND 4.0",)),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ("CC BY-NC 4.0",)),
    ("cc-by-nc-sa-4.0", "licensed under CC BY-NC-SA 4.0", ("CC BY-NC-SA 4.0",)),
    ("cc-by-nc-nd-4.0", "licensed under CC BY-NC-ND 4.0", ("CC BY-NC-ND 4.0",)),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ("Creative Commons Attribution 4.0",)),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights", ("waived all copyright and related",)),
    ("mit", "released under the MIT License", ("MIT License",)),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        ("Permission is hereby granted, free of charge", "obtaining a copy of this software"),
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ("Redistribution and use in source and binary forms",),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        ("with or without fee is hereby granted",),
    ),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ("Mozilla Public License, v. 2.0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

SCAN = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "places array<struct<label:string,phrase:boolean,first:long,end:long,share:double>>"
)


def split_words(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


@dataclass
class Template:
    """A notice, or a bare phrase: its words by number, the places of its key phrases, and the weight of each word."""

    label: str
    phrase: bool
    words: np.ndarray
    keys: np.ndarray
    weights: np.ndarray | None = None
    rare: tuple[int, ...] = ()


class LicenseIndex:
    """Templates, the numbers of their words (0: any other word), and for each template the rarest words of its key phrases."""

    def __init__(self, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str, Sequence[str]]] = NOTICES):
        self.number: dict[bytes, int] = {}
        texts = [(label, True, text, (text,)) for label, text in phrases] + [(label, False, text, keys) for label, text, keys in notices]
        self.templates = []
        for label, phrase, text, keys in texts:
            words = np.array([self.number.setdefault(w, len(self.number) + 1) for w in split_words(text)])
            places = set()
            for key in keys:
                own = [self.number.get(w, 0) for w in split_words(key)]
                at = next((k for k in range(len(words) - len(own) + 1) if own and words[k : k + len(own)].tolist() == own), None)
                if at is None:
                    raise ValueError(f"{key!r} does not stand in {text!r}")
                places.update(range(at, at + len(own)))
            if not places:
                raise ValueError(f"{text!r} needs a key phrase")
            self.templates.append(Template(label, phrase, words, np.array(sorted(places))))
        self.longest = max(len(t.words) for t in self.templates)

    def weigh(self, n: int, frequencies: dict[int, int], rare: int = 2) -> None:
        """IDF weights from the number of documents and, by word, of those that have it; files the ``rare`` rarest key words."""
        idf = np.array([0.0] + [math.log(1 + n / (1 + frequencies.get(w, 0))) for w in range(1, len(self.number) + 1)])
        for t in self.templates:
            t.weights = idf[t.words]
            t.rare = tuple(int(k) for k in t.keys[np.argsort(-t.weights[t.keys], kind="stable")[:rare]])
        self.filed = np.zeros(len(self.number) + 1, bool)
        self.filed[[t.words[k] for t in self.templates for k in t.rare]] = True

    def numbers(self, blob: bytes | None, size: int = 1 << 22) -> np.ndarray:
        """Numbers of all words of a text, which is read in blocks that end between words."""
        parts, start, blob = [], 0, blob or b""
        while start < len(blob):
            end, piece = min(len(blob), start + size), b""
            piece = blob[start:end].translate(FOLD)
            while end < len(blob) and piece[-1:] != b" ":  # a word goes on: take it whole
                more = blob[end : end + 256].translate(FOLD)
                cut = more.find(b" ") + 1 or len(more)
                piece, end = piece + more[:cut], end + cut
            words = piece.split()
            parts.append(np.fromiter((self.number.get(w, 0) for w in words), np.int16, len(words)))
            start = end
        return np.concatenate(parts) if parts else np.empty(0, np.int16)

    def places(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[Template, np.ndarray, np.ndarray, np.ndarray]]:
        """(template, document, start word, share) of all verified places in ``ids``, the words of documents side by side.

        Document d has the words from ``starts[d]`` to ``starts[d + 1]``. A notice may begin or end outside its document;
        only its words inside count.
        """
        at = np.flatnonzero(self.filed[ids])
        order = np.argsort(ids[at], kind="stable")
        words, at = ids[at][order], at[order]
        padded = np.concatenate([np.zeros(self.longest, np.int16), ids, np.zeros(self.longest, np.int16)])
        for t in self.templates:
            base = None
            for k in t.rare:  # postings that agree in their relative position
                lo, hi = np.searchsorted(words, (t.words[k], t.words[k] + 1))
                met = at[lo:hi] - k
                base = met if base is None else np.intersect1d(base, met, assume_unique=True)
            if not len(base):
                continue
            doc = np.searchsorted(starts, base + t.rare[0], side="right") - 1
            first, end = starts[doc], starts[doc + 1]
            whole = (base + t.keys[0] >= first) & (base + t.keys[-1] < end)
            base, doc, first, end = base[whole], doc[whole], first[whole], end[whole]
            for k in t.keys:
                right = padded[base + k + self.longest] == t.words[k]
                base, doc, first, end = base[right], doc[right], first[right], end[right]
            spots = base[:, None] + np.arange(len(t.words))
            met = (padded[spots + self.longest] == t.words) & (spots >= first[:, None]) & (spots < end[:, None])
            yield t, doc, base - first, np.round(met @ t.weights / max(t.weights.sum(), 1e-300), 9)


def document_frequencies(docs: DataFrame, index: LicenseIndex) -> tuple[int, dict[int, int]]:
    """The number of rows, and by template word the number of rows whose text has it: as many counts as templates have words."""
    shared, size = Shared(docs.sparkSession, index), len(index.number) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = shared.value, np.zeros(size, np.int64)
        for batch in text_slices(batches):
            counts[0] += batch.num_rows
            for blob in blobs(batch, "text"):
                seen = np.unique(own.numbers(blob))
                counts[seen[seen > 0]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(counts)], ["word", "n"])

    found = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in found}
    return counts.pop(0, 0), counts


def scan_licenses(docs: DataFrame, index: LicenseIndex | None = None, min_share: float = 0.8) -> DataFrame:
    """One row for every row of ``docs(doc_id, text)``; texts are read twice and nothing is shuffled but counts.

    ``places`` has all phrases and verified notices with start and end word (a notice that is cut off may start below 0) and
    ``share``. ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` are of phrases. ``labels`` has these and the
    labels of notices with a share of at least ``min_share``; ``score`` is the largest share of a notice. Labels are distinct
    and sorted. Null and empty texts have no words, no labels, score 0; rows of one doc_id are scanned each on its own.
    """
    index = index or LicenseIndex()
    index.weigh(*document_frequencies(docs, index))
    shared = Shared(docs.sparkSession, index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in text_slices(batches):
            texts = [own.numbers(b) for b in blobs(batch, "text")]
            starts = np.r_[0, np.cumsum([len(x) for x in texts])]
            rows: list[list[dict]] = [[] for _ in texts]
            for t, doc, first, share in own.places(np.concatenate(texts), starts):
                for d, f, s in zip(doc.tolist(), first.tolist(), share.tolist(), strict=True):
                    rows[d].append({"label": t.label, "phrase": t.phrase, "first": f, "end": f + len(t.words), "share": s})
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(np.diff(starts)), *_columns(rows, min_share)], [f.split()[0] for f in SCAN.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, SCAN)


def _columns(rows: list[list[dict]], min_share: float) -> list[pa.Array]:
    out = []
    for places in rows:
        base = [p for p in places if p["phrase"]]
        notices = [p for p in places if not p["phrase"]]
        base_labels = {p["label"] for p in base}
        labels = base_labels | {p["label"] for p in notices if p["share"] >= min_share}
        firsts = [p["first"] for p in base]
        score = max((p["share"] for p in notices), default=0.0)
        places.sort(key=lambda p: (p["first"], p["end"], p["label"]))
        out.append((len(base), min(firsts, default=None), max(firsts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, places))
    place = pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("first", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(place)]
    return [pa.array(values, kind) for values, kind in zip(zip(*out, strict=True), kinds, strict=True)]


def license_report(docs: DataFrame) -> DataFrame:
    """:func:`scan_licenses` without the places."""
    return scan_licenses(docs).drop("places")


def _template_rows() -> str:
    """(id, label, phrase, position, word, key) of every template word, as SQL values."""
    index = LicenseIndex()
    word = {k: w.decode() for w, k in index.number.items()}
    return ", ".join(
        f"({i}, '{t.label}', {t.phrase}, {k}, '{word[w]}', {k in t.keys})" for i, t in enumerate(index.templates) for k, w in enumerate(t.words.tolist())
    )


ORACLE = rf"""
WITH template AS (SELECT * FROM (VALUES {_template_rows()}) AS t (id, label, phrase, k, word, is_key)),
texts AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
),
words AS (SELECT row, unnest(words) AS word, unnest(range(len(words))) AS spot FROM texts),
weights AS (
    SELECT t.word, ln(1 + (SELECT count(*) FROM documents) / (1.0 + count(DISTINCT w.row))) AS idf
    FROM (SELECT DISTINCT word FROM template) t LEFT JOIN words w ON t.word = w.word GROUP BY t.word
),
totals AS (SELECT id, sum(idf) AS total, count(*) FILTER (is_key) AS n_keys FROM template JOIN weights USING (word) GROUP BY id),
places AS (
    SELECT row, id, label, phrase, spot - k AS first, sum(idf) AS own, count(*) FILTER (is_key) AS n_met
    FROM words JOIN template USING (word) JOIN weights USING (word) GROUP BY ALL
),
verified AS (SELECT p.*, round(own / total, 9) AS share FROM places p JOIN totals t ON p.id = t.id AND n_met = n_keys),
found AS (
    SELECT row, count(*) FILTER (phrase) AS n_base, min(first) FILTER (phrase) AS first_word, max(first) FILTER (phrase) AS last_word,
        list(DISTINCT label) FILTER (phrase) AS base_labels, list(DISTINCT label) FILTER (phrase OR share >= 0.8) AS labels,
        max(share) FILTER (NOT phrase) AS score
    FROM verified GROUP BY row
)
SELECT doc_id, coalesce(CAST(len(words) AS BIGINT), 0) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
    CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(base_labels), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(labels), ','), '') AS labels, coalesce(score, 0.0) AS score
FROM texts LEFT JOIN found USING (row)
"""
