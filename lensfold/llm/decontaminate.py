"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a block of documents. Its words are numbered by the benchmark's vocabulary; stretches that hold no adjacent
word pair of the benchmark cannot match and are left out, the rest gets a word-level suffix array. Every suffix of every
benchmark item is then binary-searched in every shard, word by word to its longest verbatim match, which gives each
document's longest match and, at the window's length, all places of windows. Rows are judged where they are read: no text is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensfold.llm.common import Shared, blobs, text_slices

#: Bytes that are parts of words: digits, a-z and all of non-ASCII; A-Z become a-z, the others spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_at long, items array<string>, spans array<struct<first:long,last:long>>"


def word_ids(blob: bytes | None, number: dict[bytes, int]) -> np.ndarray:
    """Vocabulary numbers of a text's words, -1 for others; a long text is cut in blocks at separators."""
    if not blob:
        return np.empty(0, np.int32)
    out, start, size = [], 0, 1 << 22
    while start < len(blob):
        end = min(len(blob), start + size)
        piece = blob[start:end].translate(FOLD)
        if end < len(blob) and (cut := piece.rfind(b" ")) > 0:
            piece, end = piece[:cut], start + cut
        words = piece.split()
        out.append(np.fromiter((number.get(w, -1) for w in words), np.int32, len(words)))
        start = end
    return np.concatenate(out)


@dataclass
class Benchmark:
    """All item words in one array with a stop between items; for each position the window length that starts there (0: none) and the words left in its item."""

    items: list[str]
    number: dict[bytes, int] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[str, bytes | None]], window: int) -> Benchmark:
        self = cls([r[0] for r in rows])
        words, item, length, left = [], [], [], []
        for i, (_, blob) in enumerate(rows):
            own = (blob or b"").translate(FOLD).split()
            n = min(window, len(own))
            words += [self.number.setdefault(w, len(self.number)) for w in own] + [-2]
            item += [i] * (len(own) + 1)
            length += [n if k + n <= len(own) else 0 for k in range(len(own))] + [0]
            left += [*range(len(own), -1, -1)]
        self.words, self.item, self.length, self.left = (np.array(x, np.int32) for x in (words, item, length, left))
        v = max(1, len(self.number))
        a, b = self.words[:-1].astype(np.int64), self.words[1:]
        self.pairs = np.unique((a * v + b)[(a >= 0) & (b >= 0)]) if len(words) > 1 else np.empty(0, np.int64)
        self.single = np.unique(self.words[(self.length == 1)]) if len(words) else np.empty(0, np.int32)
        return self

    def candidates(self, ids: np.ndarray) -> np.ndarray:
        """Which words lie in a pair that the benchmark has, or are an item by themselves."""
        keep = np.isin(ids, self.single) if len(self.single) else np.zeros(len(ids), bool)
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        if len(at) and len(self.pairs):
            codes = ids[at].astype(np.int64) * max(1, len(self.number)) + ids[at + 1]
            found = at[self.pairs[np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)] == codes]
            keep[found] = keep[found + 1] = True
        return keep


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` in the order of their suffixes, compared by ``depth`` words at least; by prefix doubling."""
    _, rank = np.unique(text, return_inverse=True)
    rank, done, n = rank.astype(np.int64) + 1, 1, len(text)
    while done < depth:
        after = np.zeros(n, np.int64)
        after[: max(0, n - done)] = rank[done:]
        _, rank = np.unique(rank * (n + 2) + after, return_inverse=True)
        rank, done = rank.astype(np.int64) + 1, done * 2
        if rank.max() == n:
            break
    return np.argsort(rank, kind="stable")


def search(text: np.ndarray, order: np.ndarray, tests: np.ndarray, starts: np.ndarray, lengths: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Binary-search test suffixes, word by word, each as far as it matches anywhere.

    Returns the intervals of ``order`` that match the first ``windows`` words of each suffix (empty: no match, or no
    window), the longest match of each suffix (up to ``lengths``), and for each place of ``text`` the longest match that starts there.
    """
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
    from_, to = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    matched, reach, live = np.zeros(len(starts), np.int64), np.zeros(len(text), np.int64), np.arange(len(starts))
    padded = np.concatenate((text, np.full(int(lengths.max(initial=0)) + 1, -9, text.dtype)))

    def bound(live: np.ndarray, word: np.ndarray, depth: int, right: bool) -> np.ndarray:
        a, b = lo[live].copy(), hi[live].copy()
        while (open_ := a < b).any():
            mid = (a + b) // 2
            there = padded[order[np.minimum(mid, len(order) - 1)] + depth]
            less = (there <= word) if right else (there < word)
            a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
        return a

    for depth in range(int(lengths.max(initial=0))):
        live = live[lengths[live] > depth]
        word = tests[starts[live] + depth]
        first, last = bound(live, word, depth, False), bound(live, word, depth, True)
        ok = first < last
        live, first, last = live[ok], first[ok], last[ok]
        if not len(live):
            break
        lo[live], hi[live], matched[live] = first, last, depth + 1
        whole = windows[live] == depth + 1
        from_[live[whole]], to[live[whole]] = first[whole], last[whole]
        # Intervals of one depth are equal or apart.
        first, once = np.unique(first, return_index=True)
        size = last[once] - first
        inside = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        reach[order[inside]] = depth + 1
    return from_, to, matched, reach


def judge(texts: list[bytes | None], bench: Benchmark) -> Iterator[tuple]:
    """A report for each text of one shard."""
    docs = [word_ids(t, bench.number) for t in texts]
    sizes = np.array([len(d) for d in docs], np.int64)
    ids = np.concatenate([x for d in docs for x in (d, np.array([-1], np.int32))] or [np.empty(0, np.int32)])
    base = np.cumsum(sizes + 1) - sizes - 1
    doc = np.repeat(np.arange(len(docs)), sizes + 1)
    keep = bench.candidates(ids)
    # Each stretch keeps one word after it, which no test word equals: matches cannot run over its end.
    kept = np.flatnonzero(keep | np.r_[False, keep[:-1]])
    text = np.where(keep[kept], ids[kept], -1).astype(np.int32)
    starts = np.flatnonzero(bench.words >= 0)
    hits: dict[int, set[int]] = {}
    longest, where, cover = np.zeros(len(docs), np.int64), np.full(len(docs), -1, np.int64), np.zeros(len(ids) + 1, np.int64)
    if len(kept) and len(starts):
        order = suffix_array(text, int(bench.left.max()))
        lo, hi, _, reach = search(text, order, bench.words, starts, bench.left[starts], bench.length[starts])
        for s in np.flatnonzero(hi > lo):
            at = kept[order[lo[s] : hi[s]]]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + bench.length[starts[s]], -1)
            np.maximum.at(longest, doc[at], bench.length[starts[s]])
            for d in np.unique(doc[at]):
                hits.setdefault(int(d), set()).add(int(bench.item[starts[s]]))
        pairs = reach > 1
        np.maximum.at(longest, doc[kept[pairs]], reach[pairs])
        best = np.flatnonzero((reach == longest[doc[kept]]) & (pairs | (reach > 0) & np.isin(text, bench.single)))
        own, first = np.unique(doc[kept[best]], return_index=True)
        where[own] = kept[best[first]] - base[own]
    hit = np.cumsum(cover[:-1]) > 0
    for i in range(len(docs)):
        if i not in hits:
            yield int(sizes[i]), 0, 0, hashlib.sha256(b"").hexdigest(), False, int(longest[i]), int(where[i]) if longest[i] else None, [], []
            continue
        own = hit[base[i] : base[i] + sizes[i]]
        edge = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
        items = sorted({bench.items[k] for k in hits[i]})
        spans = [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]
        yield int(sizes[i]), int(own.sum()), len(hits[i]), hashlib.sha256(",".join(items).encode()).hexdigest(), True, int(longest[i]), int(where[i]), items, spans


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_benchmark_bytes: int = 64 << 20, shard_bytes: int = 8 << 20) -> DataFrame:
    """Add a report on ``benchmark(item_id, text)`` to each row of ``docs`` (needs ``text``).

    Added: ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``n_items`` and ``items`` (items with an
    occurring window), ``items_sha256``, ``contaminated``, ``longest_match`` and ``longest_at`` (words and first place of the
    longest verbatim match with any item, of two words or more, or a one-word item; 0 and null: none) and ``spans`` (the
    runs of hit words, as first and last word). A window is ``window`` consecutive item words; an item of fewer, but
    not none, is one window. Words end at ASCII characters other than letters and digits. Null or empty texts have no
    words and are clean; a null item id counts as empty text, items without words match nothing, repeated items count
    each. Columns of the added names are replaced. The benchmark goes to every task; if it has more than
    ``max_benchmark_bytes``, the call fails: split the items and join the reports. Memory follows ``shard_bytes`` or
    the longest text.
    """
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if total > max_benchmark_bytes:
        raise ValueError(f"the benchmark has {total} bytes of text; {max_benchmark_bytes} are allowed in one pass")
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("binary")).collect()
    bench = Benchmark.of([(r[0], None if r[1] is None else bytes(r[1])) for r in rows], window)
    shared = Shared(docs.sparkSession, bench)
    names = [part.split()[0] for part in REPORT.split(", ")]
    docs = docs.drop(*names)
    schema = docs.withColumns({n: F.lit(None).cast(part.split(maxsplit=1)[1]) for n, part in zip(names, REPORT.split(", "), strict=True)}).schema
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))]

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for part in text_slices(batches, size=shard_bytes):
            found = list(zip(*judge(blobs(part, "text"), bench), strict=True))
            arrays = [pa.array(f, k) for f, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, *names])

    return docs.mapInArrow(report, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with their own columns."""
    return contamination(docs, benchmark, window).filter("not contaminated").select(*docs.columns)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document of the contract of ``op1``; the longest verbatim match comes after its columns."""
    return contamination(docs.select("doc_id", "text"), benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_at")


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM t, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
h AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.k = iw.k),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS pos FROM h),
hit AS (SELECT doc_id, count(*)::BIGINT AS n_hit FROM p GROUP BY doc_id),
dp AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM t)),
ip AS (SELECT item_id, j, w[j] AS a, w[j + 1] AS b FROM (SELECT item_id, w, unnest(range(1, len(w))) AS j FROM b)),
diag AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run, item_id, i - j AS off FROM dp JOIN ip USING (a, b)),
ml AS (SELECT doc_id, min(i) AS i, count(*) + 1 AS n FROM diag GROUP BY doc_id, item_id, off, run
  UNION ALL SELECT doc_id, i, k FROM h WHERE k = 1),
lm AS (SELECT doc_id, n AS longest_match, min(i) - 1 AS longest_at FROM ml JOIN (SELECT doc_id, max(n) AS n FROM ml GROUP BY doc_id) USING (doc_id, n) GROUP BY ALL),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(longest_match, 0) AS longest_match, longest_at
FROM t LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN lm USING (doc_id)
"""
