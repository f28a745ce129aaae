"""Repeated passages, found as near-duplicate paragraphs by MinHash banding and removed but for their first occurrence.

Paragraphs are of two kinds. A line of ``min_words`` words or more is one; its five-word shingles are min-hashed, bands are
tuned for recall at the similarity asked for, lines that collide are joined and verified by exact Jaccard, and verified
links form classes by components. A passage inside longer lines is met by anchored windows: the least shingle hash of every ``anchor``
consecutive shingles starts a window of 25 words, so equal passages of 25 + anchor - 1 words or more have a window in
common wherever they stand. A window's only band is its whole text, verified by a second, independent hash of its words; it
is extended word by word in both directions to the ends of what the texts have in common.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lensfold.llm.common import Words, blobs, column, free_shuffles, grouped, mixed, save, shingle_hashes, text_slices
from lensfold.llm.components import connected_components, local_labels

SHINGLE, WINDOW = 5, 25
DOC, LINE, BAND, SPAN, AGAIN = 0, 1, 2, 3, 4
BLOOM_BITS = 24
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_PLACE = np.uint64((1 << 26) - 1)


def choose_bands(similarity: float, recall: float = 0.995, most: int = 48) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most ``most`` hashes that meets a pair of that similarity with that probability."""
    best = None
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows)))) if similarity < 1 else 1
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding of so few hashes reaches that recall")
    return best


def anchors(shingles: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least (leftmost) of every ``width`` consecutive shingles of one document."""
    if len(shingles) < width:
        return np.empty(0, np.int64)
    low = (shingles & ~_PLACE) | np.arange(len(shingles), dtype=np.uint64)
    done = 1
    while done < width:
        step = min(done, width - done)
        low = np.minimum(low[: len(low) - step], low[step:])
        done += step
    low = low[doc[: len(low)] == doc[width - 1 :]]
    return np.unique(low & _PLACE).astype(np.int64)


class Chunk:
    """Words, lines and shingles of some documents, side by side in arrays."""

    def __init__(self, texts: pa.Array, min_words: int):
        read = Words(texts)
        self.n_words = read.counts
        self.base = np.cumsum(self.n_words) - self.n_words
        self.words = words = read.hashes
        self.doc = np.repeat(np.arange(len(texts)), self.n_words)
        self.shingles = shingle_hashes(words, SHINGLE) if len(words) >= SHINGLE else np.empty(0, np.uint64)
        self.within = self.doc[: len(self.shingles)] == self.doc[SHINGLE - 1 :] if len(words) >= SHINGLE else np.empty(0, bool)
        line = read.lines()
        first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.empty(0, np.int64)
        size = np.diff(np.r_[first, len(line)])
        long = size >= min_words
        self.line_at, self.line_size = first[long], size[long]
        if len(self.line_at):
            inside = np.arange(self.line_size.sum()) - np.repeat(np.cumsum(self.line_size) - self.line_size, self.line_size)
            place = np.repeat(self.line_at, self.line_size) + inside
            each = mixed(words.view(np.uint64)[place] + mixed(inside.astype(np.uint64)))
            starts = np.cumsum(self.line_size) - self.line_size
            self.line_hash = mixed(np.add.reduceat(each, starts) ^ self.line_size.astype(np.uint64)).view(np.int64)
        else:
            self.line_hash = np.empty(0, np.int64)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start positions of anchored windows, and two independent hashes of their words: a key, and a check of it."""
        usable = np.where(self.within, self.shingles, ~np.uint64(0))
        at = anchors(usable, self.doc[: len(usable)], width)
        at = at[at + WINDOW <= len(self.doc)]
        at = at[self.doc[at] == self.doc[at + WINDOW - 1]]
        key, check, words = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64), self.words.view(np.uint64)
        for k in range(0, WINDOW, SHINGLE):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ self.shingles[at + k])
        for k in range(WINDOW):
            check = check * np.uint64(0xD6E8FEB86659FD93) + words[at + k]
        return at, key.view(np.int64), mixed(check).view(np.int64)

    def bands(self, bands: int, rows: int, sums: np.ndarray, factors: np.ndarray) -> np.ndarray:
        """Band keys of each long line, one column a band."""
        n = self.line_size - SHINGLE + 1
        starts = np.cumsum(n) - n
        mine = self.shingles[np.repeat(self.line_at - starts, n) + np.arange(n.sum())]
        keys = np.empty((len(n), bands), np.uint64)
        for b in range(bands):
            key = np.full(len(n), b, np.uint64)
            for k in range(b * rows, (b + 1) * rows):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ np.minimum.reduceat((mine ^ sums[k]) * factors[k], starts))
            keys[:, b] = key
        return keys.view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], min_words: int, size: int = 1 << 20) -> Iterator[tuple[pa.Array, pa.Array, Chunk]]:
    for part in text_slices(batches, size=size):
        yield column(part, "doc_id"), column(part, "tag"), Chunk(column(part, "text"), min_words)


def paragraphs(docs: DataFrame, min_words: int, similarity: float, anchor: int) -> DataFrame:
    """All units of ``docs(doc_id, tag, text)``: documents, long lines, bands of these lines, anchored windows."""
    n_bands, rows = choose_bands(similarity)
    rng = np.random.default_rng(20)
    sums, factors = rng.integers(0, 1 << 63, n_bands * rows, dtype=np.uint64), rng.integers(0, 1 << 63, n_bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tags, c in _chunks(batches, min_words):
            doc_id, tag = ids, tags

            def rows_of(kind: int, key: np.ndarray, doc: np.ndarray | None, at: np.ndarray | None, size: np.ndarray | int, other: np.ndarray | None = None) -> pa.RecordBatch:
                n = len(key)
                own = [doc_id.take(pa.array(doc)), tag.take(pa.array(doc))] if doc is not None else [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())]
                return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.array(key), *own, pa.array(at.astype(np.int32)) if at is not None else pa.nulls(n, pa.int32()), pa.array(np.broadcast_to(np.asarray(size, np.int32), n)), pa.array(other) if other is not None else pa.nulls(n, pa.int64())], ["kind", "key", "doc_id", "tag", "at", "size", "line"])

            yield rows_of(DOC, np.zeros(len(ids), np.int64), np.arange(len(ids)), None, c.n_words)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            if len(c.line_at):
                doc = c.doc[c.line_at]
                ok = known[doc]
                yield rows_of(LINE, c.line_hash[ok], doc[ok], (c.line_at - c.base[doc])[ok], c.line_size[ok])
                keys = c.bands(n_bands, rows, sums, factors)
                own = np.flatnonzero(ok)
                _, once = np.unique(c.line_hash[own], return_index=True)
                once = own[once]
                yield rows_of(BAND, keys[once].ravel(), None, None, 0, np.repeat(c.line_hash[once], n_bands))
            at, key, check = c.windows(anchor)
            ok = known[c.doc[at]]
            at, key, check = at[ok], key[ok], check[ok]
            doc = c.doc[at]
            # A window that its own document has had before: only what reaches beyond the first one is repeated text.
            order = np.lexsort((at, key, doc))
            new = np.r_[True, (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])] if len(order) else np.empty(0, bool)
            first = np.empty(len(at), np.int64)
            first[order] = at[order][np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else 0
            again = first < at
            yield rows_of(SPAN, key[~again], doc[~again], (at - c.base[doc])[~again], WINDOW, check[~again])
            start = np.maximum(at, first + WINDOW)
            again &= start < at + WINDOW
            yield rows_of(AGAIN, key[again], doc[again], (start - c.base[doc])[again], (at + WINDOW - start)[again], check[again])

    return docs.mapInArrow(units, "kind byte, key long, doc_id long, tag int, at int, size int, line long")


def key_bits(wanted: DataFrame, name: str) -> np.ndarray:
    """A bit for the low bits of every key in a column."""
    bit = F.col(name).bitwiseAND(F.lit((1 << BLOOM_BITS) - 1))
    rows = wanted.groupBy(F.shiftright(bit, 15).alias("bucket")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    bloom = np.zeros((1 << BLOOM_BITS) // 8, np.uint8)
    for bucket, bits in rows:
        bloom[bucket * 4096 : (bucket + 1) * 4096] = np.frombuffer(bytes(bits), np.uint8)
    return bloom


def marked(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys whose bit is set."""
    low = keys & ((1 << BLOOM_BITS) - 1)
    return np.flatnonzero(bloom[low >> 3] >> (low & 7).astype(np.uint8) & 1)


def extensions(docs: DataFrame, wanted: DataFrame, anchor: int) -> DataFrame:
    """``doc_id, tag, first, end, kept_in``: what repeats left and right of the windows in ``wanted(key)``.

    Every maximal repeat with a window in common has one at most ``anchor`` - 1 words from either end, so as many words
    around each place of a window are compared. A place is extended as far as any place before it (by doc_id, tag,
    position) goes on alike; of a repeat inside one document only what lies beyond the earlier place is taken.
    """
    most = anchor - 1
    shared = docs.sparkSession.sparkContext.broadcast(key_bits(wanted, "key"))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = shared.value
        for ids, tags, c in _chunks(batches, 1 << 62):  # no line is long: only windows are read
            at, key, check = c.windows(anchor)
            maybe = marked(bloom, key)
            at, key, check = at[maybe], key[maybe], check[maybe]
            known = ids.is_valid().to_numpy(zero_copy_only=False)[c.doc[at]]
            at, key, check = at[known], key[known], check[known]
            doc = c.doc[at]
            words, place = c.words.astype(np.uint32), at - c.base[doc]
            backward = words[::-1]
            lefts, rights = np.minimum(place, most), np.minimum(c.n_words[doc] - place - WINDOW, most)
            left = [backward[len(words) - a : len(words) - a + n].tobytes() for a, n in zip(at.tolist(), lefts.tolist(), strict=True)]
            right = [words[a + WINDOW : a + WINDOW + n].tobytes() for a, n in zip(at.tolist(), rights.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(check), ids.take(pa.array(doc)), tags.take(pa.array(doc)), pa.array(place.astype(np.int32)), pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["key", "line", "doc_id", "tag", "at", "left", "right"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, ({}, {})
        for batch in batches:
            out = []
            for key, check, doc, tag, at, *sides in zip(*(column(batch, n).to_pylist() for n in ("key", "line", "doc_id", "tag", "at", "left", "right")), strict=True):
                if (key, check) != now:
                    now, seen = (key, check), ({}, {})
                for side, (text, had) in enumerate(zip(sides, seen, strict=True)):
                    n, found = 0, None
                    while 4 * n < len(text) and (place := had.get(text[: 4 * n + 4])):
                        n, found = n + 1, place
                    for k in range(4 * n + 4, len(text) + 1, 4):
                        had[text[:k]] = doc, tag, at
                    if found is None:
                        continue
                    first, end = (at + WINDOW, at + WINDOW + n) if side else (at - n, at)
                    if found[:2] == (doc, tag):
                        first = max(first, found[2] + WINDOW + n * side)
                    if first < end:
                        out.append((doc, tag, first, end, found[0]))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "tag", "first", "end", "kept_in"])

    found = save(docs.mapInArrow(around, "key long, line long, doc_id long, tag int, at int, left binary, right binary"))
    free_shuffles(docs.sparkSession)
    dealt = found.join(wanted, "key", "left_semi").repartition("key").sortWithinPartitions("key", "line", "doc_id", "tag", "at")
    return dealt.mapInArrow(extend, "doc_id long, tag int, first int, end int, kept_in long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """``line, shingles``: the distinct shingle hashes of the lines in ``wanted(line)``, taken from ``docs`` once more.

    A Bloom filter of fixed size keeps most other lines from leaving the scan; a join removes its false positives.
    """
    shared = docs.sparkSession.sparkContext.broadcast(key_bits(wanted, "line"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = shared.value
        for _, _, c in _chunks(batches, min_words):
            maybe = marked(bloom, c.line_hash)
            _, once = np.unique(c.line_hash[maybe], return_index=True)
            lines = maybe[once]
            own = [np.unique(c.shingles[c.line_at[i] : c.line_at[i] + c.line_size[i] - SHINGLE + 1]).view(np.int64) for i in lines]
            yield pa.RecordBatch.from_arrays([pa.array(c.line_hash[lines]), pa.array(own, pa.list_(pa.int64()))], ["line", "shingles"])

    found = docs.mapInArrow(sets, "line long, shingles array<long>")
    return found.join(wanted, "line", "left_semi").groupBy("line").agg(F.first("shingles").alias("shingles"))


def _near(similarity: float):
    """From rows sorted by task: for each task, an edge from each linked line to the first of its local class."""

    def near_pairs(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(s) for s in sets])
        _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        line, met = np.repeat(np.arange(len(sets)), sizes), times[place] > 1
        line, place = line[met], (np.cumsum(times > 1) - 1)[place[met]]
        common = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(place, kind="stable")
        line, place = line[order], place[order]
        for low in range(0, int(place[-1]) + 1 if len(place) else 0, 2048):  # shingles at a time
            lo, hi = np.searchsorted(place, (low, low + 2048))
            has = np.zeros((len(sets), 2048), np.float32)
            has[line[lo:hi], place[lo:hi] - low] = 1
            common += has @ has.T
        a, b = np.nonzero(common >= similarity * (sizes[:, None] + sizes[None, :] - common))
        return a[a < b], b[a < b]

    def few(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        own, a, b = [set(s.tolist()) for s in sets], [], []
        for j in range(len(own)):
            for i in range(j):
                common = len(own[i] & own[j])
                if common >= similarity * (len(own[i]) + len(own[j]) - common):
                    a.append(i)
                    b.append(j)
        return np.array(a, int), np.array(b, int)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in grouped(batches, "task"):
            lines, side = column(task, "line").to_numpy(), column(task, "side").to_numpy()
            if len(lines) > 1:
                sets = [s.values.to_numpy() for s in column(task, "shingles")]
                a, b = few(sets) if len(lines) < 5 else near_pairs(sets)
                if side.any():  # two blocks of a large bucket: pairs inside a block belong to its own task
                    a, b = a[side[a] != side[b]], b[side[a] != side[b]]
                if len(a):
                    label = local_labels(len(lines), a, b)
                    own = np.flatnonzero(label != np.arange(len(lines)))
                    yield pa.RecordBatch.from_arrays([pa.array(lines[own]), pa.array(lines[label[own]])], ["u", "v"])

    return links


def line_classes(units: DataFrame, docs: DataFrame, min_words: int, similarity: float, block: int = 512) -> DataFrame:
    """``node, component`` for lines that are near duplicates of other lines.

    Different lines with a band in common are compared where they meet; only edges that span their classes leave the
    task. A bucket with more than ``block`` lines is cut into blocks, and each pair of blocks is a task of its own.
    """
    bands = units.filter(F.col("kind") == BAND).select("key", "line")
    shared = bands.groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b")).filter("a <> b").select("key")
    shared = save(shared)  # here and below: a join of plain scans can be split where many rows share a key
    members = save(bands.join(shared, "key", "left_semi").distinct())
    sizes = save(members.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    sets = shingle_sets(docs, members.select("line").distinct(), min_words)
    filed = members.join(sizes, "key").withColumn("i", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("i", "j"), F.greatest("i", "j")
    tasks = filed.select("line", F.xxhash64("key", low, high).alias("task"), F.when(F.col("i") <= F.col("j"), 0).otherwise(1).alias("side"))
    dealt = tasks.join(sets, "line").repartition("task").sortWithinPartitions("task", "line")
    return connected_components(dealt.mapInArrow(_near(similarity), "u long, v long"))


def repeated_spans(docs: DataFrame, min_words: int = 25, similarity: float = 0.8, anchor: int = 20) -> tuple[DataFrame, DataFrame]:
    """(documents, spans) of ``docs(doc_id, tag, text)``.

    Spans are ``doc_id, tag, first, end, kept_in``: word positions of every occurrence but the first of each class of lines
    (by doc_id, tag, position) and of each window (by doc_id, tag, position), extended to what is alike around it, and the
    document that holds the first.
    """
    units = save(paragraphs(docs, min_words, similarity, anchor))
    classes = line_classes(units, docs, min_words, similarity)
    free_shuffles(docs.sparkSession)
    lines = units.filter(F.col("kind") == LINE).join(classes.withColumnRenamed("node", "key"), "key", "left")
    lines = lines.select(F.coalesce("component", "key").alias("key"), "doc_id", "tag", "at", "size")
    lines = save(lines)
    firsts = save(lines.groupBy("key").agg(F.min(F.struct("doc_id", "tag", "at")).alias("f"), F.count("*").alias("n")).filter("n > 1").select("key", "f"))
    end = F.col("at") + F.col("size")
    of_lines = lines.join(firsts, "key").filter("struct(doc_id, tag, at) <> f").select("doc_id", "tag", F.col("at").alias("first"), end.alias("end"), F.col("f.doc_id").alias("kept_in"))
    windows = units.filter(F.col("kind") == SPAN).select("key", "line", "doc_id", "tag", "at", "size")
    document = F.struct("doc_id", "tag")
    shared = windows.groupBy("key", "line").agg(F.min(document).alias("f"), F.max(document).alias("last")).filter("f <> last").select("key", "line", "f")
    shared = save(shared)
    of_windows = windows.join(shared, ["key", "line"]).filter("struct(doc_id, tag) <> f").select("doc_id", "tag", F.col("at").alias("first"), end.alias("end"), F.col("f.doc_id").alias("kept_in"))
    again = units.filter(F.col("kind") == AGAIN).select("doc_id", "tag", F.col("at").alias("first"), end.alias("end"), F.col("doc_id").alias("kept_in"))
    free_shuffles(docs.sparkSession)
    met = save(shared.select("key").union(units.filter(F.col("kind") == AGAIN).select("key")).distinct())
    spans = of_lines.unionByName(of_windows).unionByName(again).unionByName(extensions(docs, met, anchor))
    return units.filter(F.col("kind") == DOC).select("doc_id", "tag", F.col("size").cast("long").alias("n_words")), spans


def merged_spans(spans: DataFrame) -> DataFrame:
    """Per document the disjoint ``spans`` in order, the words in them, and the documents that keep the text."""
    before = Window.partitionBy("doc_id", "tag").orderBy("first", "end").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("doc_id", "tag").orderBy("first", "end").rowsBetween(Window.unboundedPreceding, 0)
    islands = spans.withColumn("reach", F.max("end").over(before)).withColumn("new", F.when(F.col("first") <= F.col("reach"), 0).otherwise(1)).withColumn("island", F.sum("new").over(so_far))
    runs = islands.groupBy("doc_id", "tag", "island").agg(F.min("first").alias("first"), F.max("end").alias("end"), F.collect_set("kept_in").alias("kept_in"))
    return runs.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans"), F.sum(F.col("end") - F.col("first")).alias("n_removed"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kept_in")))).alias("kept_in"))


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("tag"), "text")


def substring_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, repeats, spans, kept_in`` for every row of ``docs(doc_id, text)``.

    ``spans`` are the word positions [first, end) that repeat text of the documents in ``kept_in``, where its first
    occurrence stays; a document without ``repeats`` has empty arrays. Null and empty texts have no words. Rows with a null
    doc_id take no part and have no spans. Rows that repeat both doc_id and text count as one document; rows that
    repeat the doc_id only are told apart by a hash of the text. Memory follows the longest text.
    """
    each, spans = repeated_spans(_tagged(docs))
    found = merged_spans(spans)
    out = each.join(found, ["doc_id", "tag"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.col("n_removed").isNotNull().alias("repeats"), F.coalesce("spans", F.expr("array()").cast("array<struct<first:int,end:int>>")).alias("spans"), F.coalesce("kept_in", F.expr("array()").cast("array<bigint>")).alias("kept_in"))


def cut_words(blob: bytes, spans: list[dict]) -> bytes:
    """The text without the words of the spans; the gap becomes one line end if there was one on either side, else one space."""
    places = [m.span() for m in _WORD.finditer(blob)]
    edges = [0, *(e for s in spans for e in (places[s["first"]][0], places[s["end"] - 1][1])), len(blob)]
    white, out, gap = b" \t\n\r\x0b\x0c", [], b""
    for k in range(0, len(edges), 2):
        piece = blob[edges[k] : edges[k + 1]]
        left = piece.lstrip(white) if k else piece
        core = left.rstrip(white) if k + 2 < len(edges) else left
        lead, trail = piece[: len(piece) - len(left)], left[len(core) :]
        gap = b"\n" if b"\n" in gap + lead else b" "
        if core:
            out += [gap, core] if out else [core]
            gap = trail
        else:
            gap += trail
    return b"".join(out)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with every repeated passage removed but for its first occurrence; documents of which no word is left go.

    ``n_chars``, if there is such a column, follows the text. Cases as in :func:`substring_report`; documents without
    repeats come back unchanged, whatever their text.
    """
    _, spans = repeated_spans(_tagged(docs))
    found = merged_spans(spans).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.col("spans").alias("_spans"))
    joined = docs.join(found, (docs.doc_id.cast("long") == found["_id"]) & (F.hash(docs.text) == found["_tag"]), "left").drop(found["_id"], found["_tag"])
    schema = joined.drop("_spans").schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            spans = column(batch, "_spans").to_pylist()
            own = batch.select([c for c in batch.schema.names if c != "_spans"])
            at = own.schema.get_field_index("text")
            texts = [cut_words(b, s) if s else b for b, s in zip(blobs(batch, "text"), spans, strict=True)]
            keep = pa.array([not s or bool(t) for t, s in zip(texts, spans, strict=True)], pa.bool_())
            arrays = own.columns
            arrays[at] = pa.array(texts, pa.binary()).cast(own.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, own.schema.names).filter(keep)

    out = joined.mapInArrow(cut, schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
