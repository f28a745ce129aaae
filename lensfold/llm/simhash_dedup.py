"""SimHash near-duplicate groups, linked by a self-join of binary tries.

Fingerprints that differ in at most two of 64 bits agree in one of three blocks of bits. Each fingerprint is therefore
filed three times, rotated so that one block leads; the leading bits select a subtree of that trie, and subtrees are dealt
over tasks. Inside a task the trie is walked level by level over pairs of nodes, from (root, root), adding up differing bits
and dropping a pair as soon as it exceeds the budget. A subtree with too many members is first cut into pairs of deeper
nodes, again with the budget, until every pair of nodes is small; bits run out at 64, so this ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensfold.llm.common import blobs, column, save, text_slices, word_blocks
from lensfold.llm.components import connected_components, local_labels

BUDGET = 2
#: First bits of the three rotations: the leading block is bits 0-21, 22-42 or 43-63 from the top.
ROTATIONS = ((0, 22), (22, 21), (43, 21))


def fingerprint(blob: bytes | None, size: int = 3) -> int:
    """64-bit SimHash of the text's word shingles, repeats included, as an unsigned number."""
    ones, total = np.zeros(64, np.int64), 0
    tail: list[bytes] = []
    blocks, carried = word_blocks(blob), False
    for words in blocks:
        words = tail + words
        if len(words) >= size:
            hashes = [xxhash.xxh64_intdigest(s, 42) for s in map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))]
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones, total, carried = ones + bits.sum(axis=0, dtype=np.int64), total + len(hashes), True
        tail = words[-(size - 1) :]
    if not carried and tail:
        ones, total = np.array([xxhash.xxh64_intdigest(b" ".join(tail), 42) >> k & 1 for k in range(64)]), 1
    return sum(1 << k for k in np.flatnonzero(ones * 2 > total).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, fp``: a hash of the text and the fingerprint, as a signed bigint, of each row of ``docs(doc_id, text)``."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            fps = np.array([fingerprint(b) for b in blobs(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "tag"), pa.array(fps)], ["doc_id", "tag", "fp"])

    docs = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    return docs.mapInArrow(prints, docs.select("doc_id", "tag", F.lit(0).cast("long").alias("fp")).schema)


def trie_pairs(keys: np.ndarray, groups: np.ndarray, side: np.ndarray, depth: np.ndarray, spent: np.ndarray, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of keys within ``budget`` bits, inside each group.

    ``keys`` are uint64 and sorted by (group, side, key). A group stands for a pair of nodes whose ``depth`` leading bits
    are settled and differ in ``spent`` places: side 0 against side 1, or side 0 with itself where there is no side 1.
    """
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    ends = np.r_[starts[1:], len(keys)]
    cut = np.array([s + int(np.count_nonzero(side[s:e] == 0)) for s, e in zip(starts, ends, strict=True)]) if side.any() else ends
    alone = cut == ends
    keep = (ends - starts) > 1
    keep &= alone | (cut > starts)
    starts, ends, cut, alone = starts[keep], ends[keep], cut[keep], alone[keep]
    frontier = [np.stack([starts, cut, np.where(alone, starts, cut), ends, depth[starts], spent[starts]])]
    small = 64
    while frontier:
        now = frontier.pop()
        if now.shape[1] > 4096:
            frontier += [now[:, 4096:]]
            now = now[:, :4096]
        a0, a1, b0, b1, level, used = now
        leaf = ((a1 - a0) * (b1 - b0) <= small) | (level >= 64)
        if leaf.any():
            x0, nx, y0, ny = a0[leaf], (a1 - a0)[leaf], b0[leaf], (b1 - b0)[leaf]
            n = nx * ny
            which = np.repeat(np.arange(len(n)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = x0[which] + k // ny[which], y0[which] + k % ny[which]
            ok = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            if ok.any():
                yield i[ok], j[ok]
        inner = now[:, ~leaf]
        if inner.shape[1]:
            a0, a1, b0, b1, level, used = inner
            mid = [_split(keys, lo, hi, level) for lo, hi in ((a0, a1), (b0, b1))]
            same = (a0 == b0) & (a1 == b1)
            born = []
            for x, y in ((0, 0), (1, 1), (0, 1), (1, 0)):
                p = np.stack([mid[0] if x else a0, a1 if x else mid[0], mid[1] if y else b0, b1 if y else mid[1], level + 1, used + (x != y)])
                ok = (p[1] > p[0]) & (p[3] > p[2]) & (p[5] <= budget)
                if (x, y) == (1, 0):
                    ok &= ~same
                ok &= ~((p[0] == p[2]) & (p[1] == p[3]) & (p[1] - p[0] < 2))
                born.append(p[:, ok])
            frontier.append(np.concatenate(born, axis=1))


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: np.ndarray) -> np.ndarray:
    """First position in each sorted node [lo, hi) whose key has the bit of that level set."""
    a, b, shift = lo.copy(), hi.copy(), (63 - level).astype(np.uint64)
    while (open_ := a < b).any():
        mid = (a + b) // 2
        one = (keys[np.minimum(mid, len(keys) - 1)] >> shift & np.uint64(1)).astype(bool)
        a, b = np.where(open_ & ~one, mid + 1, a), np.where(open_ & one, mid, b)
    return a


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by group, side and key: for each group, an edge from each linked member to the first of its class."""
    held: dict[str, np.ndarray] = {}

    def forest(x: dict[str, np.ndarray]) -> pa.RecordBatch:
        keys, n = x["key"].view(np.uint64) ^ np.uint64(1 << 63), len(x["key"])
        a, b, label = [], [], np.arange(n)
        for i, j in trie_pairs(keys, x["grp"], x["side"], x["depth"], x["spent"]):
            a.append(i)
            b.append(j)
            if sum(map(len, a)) > 1 << 20:
                label = local_labels(n, np.concatenate([np.arange(n), *a]), np.concatenate([label, *b]))
                a, b = [], []
        label = local_labels(n, np.concatenate([np.arange(n), *a]), np.concatenate([label, *b]))
        own = np.flatnonzero(label != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(x["fp"][own]), pa.array(x["fp"][label[own]])], ["u", "v"])

    for batch in batches:
        new = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
        held = {c: np.concatenate((held[c], v)) for c, v in new.items()} if held else new
        last = int(np.searchsorted(held["grp"] == held["grp"][-1], True)) if len(held["grp"]) else 0
        if last >= 1 << 15:
            yield forest({c: v[:last] for c, v in held.items()})
            held = {c: v[last:] for c, v in held.items()}
    if held:
        yield forest(held)


def near_links(fps: DataFrame, max_node: int = 1024, step: int = 6) -> DataFrame:
    """Edges ``u, v`` whose components are those of all pairs of distinct fingerprints ``fps(fp)`` within two bits.

    Subtrees with more than ``max_node`` members are cut ``step`` bits deeper, in pairs of nodes within the budget; a row
    is copied to as many pairs as there are near prefixes, and the cut is repeated while a pair of nodes is too large.
    """
    rotated = []
    for first, bits in ROTATIONS:
        key = F.col("fp") if first == 0 else F.shiftleft("fp", first).bitwiseOR(F.shiftrightunsigned("fp", 64 - first))
        block = F.shiftrightunsigned(key, 64 - bits)
        rotated.append(F.struct(F.xxhash64(F.lit(first), block).alias("grp"), F.lit(0).alias("side"), key.alias("key"), F.lit(bits).alias("depth"), F.lit(0).alias("spent"), F.lit(False).alias("pair")))
    rows = fps.select("fp", F.explode(F.array(*rotated)).alias("r")).select("fp", "r.*")
    ready = None
    while True:
        rows = save(rows)
        big = rows.groupBy("grp").agg(F.count("*").alias("n"), F.max("depth").alias("at")).filter((F.col("n") > max_node) & (F.col("at") < 64)).select("grp")
        big = save(big)
        if big.isEmpty():
            done, rows = rows, None
        else:
            done = rows.join(big, "grp", "left_anti")
            rows = _deeper(rows.join(big, "grp"), step)
        ready = done if ready is None else ready.unionByName(done)
        if rows is None:
            break
    # Signed order of (key xor top bit) is unsigned order of the key.
    cols = ["grp", "side", F.col("key").bitwiseXOR(F.lit(-(1 << 63))).alias("key"), "depth", "spent", "fp"]
    dealt = ready.select(*cols).repartition("grp").sortWithinPartitions("grp", "side", "key")
    return dealt.mapInArrow(_links, "u long, v long")


def _deeper(rows: DataFrame, step: int) -> DataFrame:
    """Cut pairs of nodes into pairs of nodes ``step`` bits deeper, keeping those within the budget."""
    take = F.least(F.lit(step), 64 - F.col("depth"))
    prefix = F.expr(f"shiftrightunsigned(shiftleft(key, depth), 64 - least({step}, 64 - depth))")
    masks = [m for m in range(1 << step) if m.bit_count() <= BUDGET]
    rows = rows.withColumn("take", take).withColumn("p", prefix)
    near = rows.withColumn("m", F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))).filter((F.col("m") < F.expr("shiftleft(1L, take)")) & (F.bit_count("m") + F.col("spent") <= BUDGET))
    other = F.col("p").bitwiseXOR(F.col("m"))
    # A pair of different nodes keeps its sides. A node with itself gives the pairs (p, q) with p <= q: the lower prefix is side 0.
    low = F.when(F.col("pair"), F.when(F.col("side") == 0, F.col("p")).otherwise(other)).otherwise(F.least("p", other))
    high = F.when(F.col("pair"), F.when(F.col("side") == 0, other).otherwise(F.col("p"))).otherwise(F.greatest("p", other))
    side = F.when(F.col("pair"), F.col("side")).otherwise(F.when(F.col("p") <= other, 0).otherwise(1))
    return near.select("fp", F.xxhash64("grp", low, high).alias("grp"), side.alias("side"), "key", (F.col("depth") + F.col("take")).alias("depth"), (F.col("spent") + F.bit_count("m")).alias("spent"), (F.col("pair") | (F.col("m") != 0)).alias("pair"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, fp, component_id`` for every row of ``docs(doc_id, text)``; ``tag`` is a hash of the text.

    Fingerprints that differ in at most two bits are linked; ``component_id`` is the smallest doc_id of all documents
    reachable by links. Copies share one fingerprint and enter the join once. Null and empty texts have fingerprint zero
    and are linked like any other; null ids do not count as smallest, and a group of null ids only has a null component.
    Repeated rows are kept, each with the same answer. Texts are hashed in blocks, so their length is not limited.
    """
    prints = save(fingerprints(docs))
    each = save(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    classes = connected_components(near_links(each.select("fp")))
    classes = save(classes.join(each, classes.node == each.fp).select("node", "component", "first_id"))
    named = classes.join(classes.groupBy("component").agg(F.min("first_id").alias("component_id")), "component").select(F.col("node").alias("fp"), "component_id", F.lit(True).alias("linked"))
    each = each.join(named, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id"))
    each = save(each)  # a join of plain scans, whose partitions can be split where many copies share a fingerprint
    return prints.join(each, "fp").select("doc_id", "tag", "fp", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id.

    Rows are told apart by doc_id and text: of rows that share an id only those whose text is in a group with a smaller id
    go, and rows that repeat id and text stay or go together. Rows with a null doc_id are all kept. Nulls and empty texts
    are one group; an empty table gives no rows; other columns pass through, whatever their names.
    """
    gone = simhash_components(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone_id"), F.col("tag").alias("_gone_tag")).distinct()
    return docs.join(gone, (docs.doc_id == gone["_gone_id"]) & (F.xxhash64(docs.text) == gone["_gone_tag"]), "left_anti")


def simhash_report(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id``: the contract of ``op6``."""
    return simhash_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
