"""Language-model scores from a probabilistic suffix tree over words.

A tree node is a context of up to ``depth`` words that occurs twice in the training texts; it is retained if the divergence
of its next-word distribution from its suffix's (its parent's) reaches a threshold. Distributions are smoothed by absolute
discounting: a context keeps the counts of the next words that follow it twice, less a discount, and passes the rest of its
mass to its parent, down to the add-0.1 unigram distribution. A word is scored in the state of the longest retained suffix
of what precedes it.

The tree is never in one place. Documents are read into chunks of about a million tokens, one row each. In each step a
chunk asks for what it needs of the corpus, as sorted lists of 64-bit codes, one list for each range of codes: the counts of
its grams, then the sums over its contexts. A task has all lists of a range, adds up the chunks' parts and answers each list
in its order. A gram is asked for only where its context and its suffix occur twice, so a deeper level asks less. Lists
hold a code once, so however frequent a word is, no task gets more than one entry a chunk for it.

Chunks and answers are bucketed by chunk and joined without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensfold.llm.common import Words, column, discard, free_shuffles, grouped, id_remainder, mixed, save, save_bucketed, text_slices

ADD = 0.1
DISCOUNT = 0.5
DIVERGENCE = 0.02
#: Code of the end of a text; words have other codes but for a chance of 2 ** -64.
END = np.uint64(xxhash.xxh64_intdigest(b" ", 42))
CHUNK_TOKENS = 3 << 18
GRAM, CONTEXT = 0, 1


def packed(x: np.ndarray) -> bytes:
    """Unsigned integers in a width of half bytes that suits most of them, two side by side, as planes of bytes.

    A value that its width can't hold is preceded by as many full values as it takes.
    """
    x = x.astype(np.uint64, copy=False)
    if not len(x):
        return b""
    near, best = (int(2 * x.mean()).bit_length() + 3) // 4, (16 * len(x), 16, None)
    for half in range(max(1, near - 1), min(8, near + 1) + 1):
        full = x // np.uint64((1 << 4 * half) - 1)
        best = min(best, ((len(x) + int(full.sum())) * half, half, full), key=lambda b: b[0])
    _, half, full = best
    if half == 16:
        return bytes([16]) + x.astype("<u8").tobytes()
    top = np.uint64((1 << 4 * half) - 1)
    if full.any():
        out = np.full(len(x) + int(full.sum()), top, np.uint64)
        out[np.arange(len(x)) + np.cumsum(full).astype(np.int64)] = x % top
        x = out
    odd = len(x) % 2
    if odd:
        x = np.append(x, np.uint64(0))
    both = x[::2] | x[1::2] << np.uint64(4 * half)
    return bytes([half | odd << 5]) + both.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :half].T.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    half, odd = blob[0] & 31, blob[0] >> 5
    if half == 16:
        return np.frombuffer(blob, "<u8", offset=1)
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(half, -1)
    both = np.zeros((planes.shape[1], 8), np.uint8)
    both[:, :half] = planes.T
    both, top = both.view("<u8").ravel(), np.uint64((1 << 4 * half) - 1)
    out = np.empty(2 * len(both), np.uint64)
    out[::2], out[1::2] = both & top, both >> np.uint64(4 * half)
    out = out[: len(out) - odd]
    whole = out != top
    return out if whole.all() else np.diff(np.cumsum(out, dtype=np.uint64)[whole], prepend=np.uint64(0))


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted codes, as the first and the gaps."""
    return keys[:1].astype("<u8").tobytes() + packed(np.diff(keys)) if len(keys) else b""


def unpacked_keys(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    return np.frombuffer(blob, "<u8", 1)[0] + np.cumsum(np.append(np.uint64(0), unpacked(blob[8:])), dtype=np.uint64)


def ranked(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the place of each key among them. Keys have ``bits`` bits; if a key and its position fit
    in 64 bits they are sorted as one number, which is several times faster than an indirect sort."""
    n = len(keys)
    low = max(1, (n - 1).bit_length()) if n else 1
    if bits + low <= 64:
        both = np.sort((keys << np.uint64(low)) | np.arange(n, dtype=np.uint64))
        order, keys = (both & np.uint64((1 << low) - 1)).astype(np.int64), both >> np.uint64(low)
    else:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    new = np.ones(n, bool)
    new[1:] = keys[1:] != keys[:-1]
    place = np.empty(n, np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], place


CHUNKS = "chunk long, n_tokens long, n_train long, doc_id {id}, held_out array<boolean>, sizes array<int>, words binary, codes binary"


def chunks(docs: DataFrame) -> DataFrame:
    """A row for about ``CHUNK_TOKENS`` tokens of whole texts of ``docs(doc_id, held_out, text)``: their ids and sizes, the
    distinct words' hashes in order, and each token as a place among them. Each text ends in an end."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, total = TaskContext.get().partitionId() << 32, [], 0

        def row() -> pa.RecordBatch:
            ids, out, sizes, tokens = (list(x) for x in zip(*held, strict=True))
            ids, out, sizes = pa.concat_arrays(ids), pa.concat_arrays(out), np.concatenate(sizes)
            words, codes = ranked(np.concatenate(tokens), 64)
            learnt = int(sizes[~out.to_numpy(zero_copy_only=False)].sum())
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, out, pa.array(sizes, pa.int32()))]
            values = [pa.array([x], t) for x, t in ((number, pa.int64()), (int(sizes.sum()), pa.int64()), (learnt, pa.int64()))]
            return pa.RecordBatch.from_arrays([*values, *lists, pa.array([packed_keys(words)], pa.binary()), pa.array([packed(codes)], pa.binary())], ["chunk", "n_tokens", "n_train", "doc_id", "held_out", "sizes", "words", "codes"])

        for part in text_slices(batches):
            read = Words(column(part, "text"))
            sizes = read.counts + 1
            tokens, ends = np.empty(int(sizes.sum()), np.uint64), np.zeros(int(sizes.sum()), bool)
            ends[np.cumsum(sizes) - 1] = True
            tokens[ends], tokens[~ends] = END, read.hashes.view(np.uint64)
            held.append((column(part, "doc_id"), column(part, "held_out"), sizes, tokens))
            total += len(tokens)
            if total >= CHUNK_TOKENS:
                yield row()
                number, held, total = number + 1, [], 0
        if held:
            yield row()

    return docs.mapInArrow(cut, CHUNKS.format(id=f"array<{docs.schema['doc_id'].dataType.simpleString()}>"))


@dataclass(frozen=True)
class Model:
    """What all chunks know: learnt tokens, distinct learnt tokens (after the first step), bits of gram codes, parts, settings."""

    total: int
    vocabulary: int
    bits: int
    parts: int
    depth: int
    divergence: float


Ask = tuple[int, int, np.ndarray, np.ndarray, np.ndarray]


def walk(row: dict, answers: dict[tuple[int, int], np.ndarray], model: Model) -> tuple[list[Ask], np.ndarray | None, np.ndarray | None, np.ndarray]:
    """Go through the levels of a chunk as far as ``answers`` reach.

    Returns what it asks next, (level, kind, distinct codes, counts, sums), and, if the words' counts are known, the tokens'
    counts and unigram probabilities, and their probabilities in the states reached.
    """
    words, codes, sizes = unpacked_keys(row["words"]), unpacked(row["codes"]).astype(np.int32), np.asarray(row["sizes"], np.int64)
    place = (np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    train = np.repeat(~np.asarray(row["held_out"], bool), sizes)
    none, asks = np.empty(0), []
    known = (0, GRAM) in answers
    if known:
        n = first = answers[0, GRAM][codes].astype(np.int64)
        p = base = (n + ADD) / (model.total + ADD * (model.vocabulary + 1))
    else:
        asks.append((0, GRAM, words, np.bincount(codes, train, len(words)), none))
        n = first = p = base = None
    full, distinct, at = words[codes], words, codes
    for level in range(1, model.depth + 1):
        inside = place >= level
        longer = np.zeros(len(full), np.uint64)
        longer[1:] = mixed(mixed(full[:-1]) * np.uint64(0x9E3779B97F4A7C15) ^ full[1:])
        full = longer
        if level > 1 or known:
            before = np.zeros(len(n), np.int64)
            before[1:] = n[:-1]
            open_ = inside & (before > 1)
        # All parts of a gram that occurs twice do; pairs are asked for together with their words.
        asking = np.flatnonzero(open_ & (n > 1)) if level > 1 else np.flatnonzero(inside)
        grams, own = ranked(full[asking] >> np.uint64(64 - model.bits), model.bits)
        if (level, GRAM) not in answers:
            asks.append((level, GRAM, grams, np.bincount(own, train[asking], len(grams)), none))
            return asks, first, base, p
        seen = answers[level, GRAM][own].astype(np.int64)
        now = np.zeros(len(codes), np.int64)
        now[asking] = np.where(seen > 1, seen, 0)
        # The context of a token is the gram of the level below that ends just before it.
        there = np.flatnonzero(open_)
        context = at[there - 1]
        used = np.zeros(len(distinct), bool)
        used[context] = True
        context = (np.cumsum(used, dtype=np.int32) - 1)[context]
        total, kept = before[there], now[there]
        if (level, CONTEXT) in answers:
            passed = answers[level, CONTEXT][context]
            p = p.copy()
            p[there] = np.where(passed > 0, np.where(kept > 0, (kept - DISCOUNT) / total, 0) + passed * p[there], p[there])
        else:
            asks.append((level, CONTEXT, distinct[used], *_context_sums(context, int(used.sum()), total, kept, train[there], p[there])))
        n, distinct = now, grams
        at = np.full(len(codes), -1, np.int32)
        at[asking] = own
    return asks, first, base, p


def _context_sums(context: np.ndarray, n: int, total: np.ndarray, kept: np.ndarray, train: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's part of sums over each context's next words, taken over places: a word that occurs k times counts 1 / k each time.

    Counts: the context's own, and of places whose next word is kept. Sums over the kept words: one (a whole number in the
    end), the divergence's terms, and the parent's probabilities; the last two only decide what is retained, and are sent
    in half precision.
    """
    own_total = np.zeros(n, np.int64)
    own_total[context] = total
    keep = train & (kept > 0)
    context, total, kept, parent = context[keep], total[keep], kept[keep], parent[keep]
    own = (kept - DISCOUNT) / total
    sums = [np.bincount(context, x, n) for x in (1 / kept, own * np.log(own / parent) / kept, parent / kept)]
    return np.concatenate((own_total, np.bincount(context, minlength=n))), np.concatenate(sums)


def passed_mass(total: np.ndarray, places: np.ndarray, words: np.ndarray, terms: np.ndarray, parent: np.ndarray, divergence: float) -> np.ndarray:
    """The mass that contexts pass to their parents; 0 for contexts that are not retained.

    The divergence is that of the kept words, and of all others as one, under the context and under its parent.
    """
    passed = (total - places + DISCOUNT * np.rint(words)) / total
    gain = terms + passed * np.log(passed / np.maximum(1 - parent, 1e-12))
    return np.where((places > 0) & (gain >= divergence), passed, 0.0)


ASKS, ANSWERS = "part int, chunk long, kind int, codes binary, counts binary, sums binary", "chunk long, kind int, part int, data binary, seen long"


def _row(batch: pa.RecordBatch, i: int, names: tuple[str, ...]) -> dict:
    return {c: column(batch, c)[i].values.to_numpy(zero_copy_only=False) if c in ("sizes", "held_out") else column(batch, c)[i].as_py() for c in names}


def _answered(batch: pa.RecordBatch, i: int, steps: int) -> dict[tuple[int, int], np.ndarray]:
    """The answers to a chunk, one array in the order of its codes for each level and kind."""
    out: dict[tuple[int, int], np.ndarray] = {}
    for step in range(1, steps + 1):
        found = sorted(((a["kind"], a["part"], a["data"]) for a in column(batch, f"answers{step}")[i].as_py() or []), key=lambda a: a[:2])
        for kind in {a[0] for a in found}:
            lists = [a[2] for a in found if a[0] == kind]
            out[divmod(kind, 2)] = np.concatenate([unpacked(x) if kind % 2 == GRAM else np.frombuffer(x, "<f4").astype(float) for x in lists])
        # A chunk without such codes asks nothing.
        for level, kind in ((0, GRAM), (1, GRAM)) if step == 1 else ((step - 1, CONTEXT), (step, GRAM)):
            out.setdefault((level, kind), np.empty(0, np.uint64 if kind == GRAM else np.float64))
    return out


def _unpacked_lists(blob: bytes) -> Iterator[np.ndarray]:
    at = 0
    while at < len(blob):
        end = at + 4 + int.from_bytes(blob[at : at + 4], "little")
        yield unpacked(blob[at + 4 : end])
        at = end


CHUNK_COLUMNS = ("chunk", "held_out", "sizes", "words", "codes")


def _step(state: DataFrame, step: int, model: Model) -> DataFrame:
    """The answers to what the chunks of ``state``, which has ``step`` - 1 answers, ask next."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = _row(batch, i, CHUNK_COLUMNS)
                for level, kind, keys, counts, sums in walk(row, _answered(batch, i, step - 1), model)[0]:
                    if not len(keys):
                        continue
                    # Code ranges of equal width; pairs of words and longer grams have fewer bits than words.
                    bits = 64 if level - kind == 0 else model.bits
                    edges = np.searchsorted(keys, np.arange(1, model.parts, dtype=np.uint64) << np.uint64(bits - (model.parts - 1).bit_length()))
                    edges, n = np.r_[0, edges, len(keys)], len(keys)
                    parts = np.flatnonzero(np.diff(edges))
                    counts, sums = counts.reshape(-1, n).astype(np.uint64), sums.reshape(-1, n)
                    ones, rest = sums[:1].astype("<f4"), sums[1:].astype("<f2")
                    lists = [(packed_keys(keys[a:b]), b"".join(len(x).to_bytes(4, "little") + x for x in map(packed, counts[:, a:b])), ones[:, a:b].tobytes() + rest[:, a:b].tobytes()) for a, b in zip(edges[parts].tolist(), edges[parts + 1].tolist(), strict=True)]
                    for at in range(0, len(lists), 256):
                        codes, packs, floats = zip(*lists[at : at + 256], strict=True)
                        part = pa.array(parts[at : at + 256], pa.int32())
                        yield pa.RecordBatch.from_arrays([part, pa.array([row["chunk"]] * len(part), pa.int64()), pa.array([2 * level + kind] * len(part), pa.int32()), *(pa.array(x, pa.binary()) for x in (codes, packs, floats))], ["part", "chunk", "kind", "codes", "counts", "sums"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "part"):
            kinds = column(group, "kind").to_numpy()
            for kind in np.unique(kinds).tolist():
                part = group.take(pa.array(np.flatnonzero(kinds == kind)))
                lists = [unpacked_keys(x) for x in column(part, "codes").to_pylist()]
                sizes, seen = np.array([len(x) for x in lists]), 0
                counts = [np.stack(list(_unpacked_lists(x))) for x in column(part, "counts").to_pylist()]
                distinct, at = ranked(np.concatenate(lists), 64 if kind // 2 - kind % 2 == 0 else model.bits)
                if kind % 2 == GRAM:
                    total = np.bincount(at, np.concatenate(counts, axis=1)[0], len(distinct)).astype(np.uint64)
                    seen = int((total > 0).sum()) if kind == 0 else 0
                    data = [packed(x) for x in np.split(total[at], np.cumsum(sizes)[:-1])]
                else:
                    own, places = np.concatenate(counts, axis=1)
                    total = np.zeros(len(distinct))
                    total[at] = own
                    floats = list(zip(column(part, "sums").to_pylist(), sizes.tolist(), strict=True))
                    sums = [np.concatenate([np.frombuffer(x, "<f4", n) for x, n in floats]), *np.concatenate([np.frombuffer(x, "<f2", 2 * n, 4 * n).reshape(2, n) for x, n in floats], axis=1)]
                    passed = passed_mass(total, np.bincount(at, places, len(distinct)), *(np.bincount(at, x, len(distinct)) for x in sums), model.divergence)
                    data = [x.tobytes() for x in np.split(passed.astype("<f4")[at], np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays([column(part, "chunk"), column(part, "kind"), column(part, "part"), pa.array(data, pa.binary()), pa.array([seen] + [0] * (len(data) - 1), pa.int64())], ["chunk", "kind", "part", "data", "seen"])

    asked = state.mapInArrow(ask, ASKS)
    return asked.repartition("part").sortWithinPartitions("part").mapInArrow(answer, ANSWERS)


def score_documents(docs: DataFrame, depth: int = 3, divergence: float = DIVERGENCE) -> DataFrame:
    """Scores of every row of ``docs(doc_id, held_out, text)`` by a tree learned from the rows where ``held_out`` is false.

    Tokens are the words outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased, and one end; null and empty texts have the end
    only. ``base_score`` sums log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens, ``score`` is the tree's log10
    probability of the text, ``n_known`` counts tokens seen in training, ``train_tokens`` is N. Words are told apart by
    64-bit hashes, longer grams by codes of 16 bits more than their number has, so one in 65,000 may share another's
    counts. Rows with a null ``held_out`` are scored and not learnt from. Repeated rows are scored each; null ids pass
    through; an empty table gives no rows; without training rows every token is unknown, and both scores are those of
    add-0.1 over nothing, one symbol (0). Other columns are ignored. Memory follows the longest text, or a chunk.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(F.col("held_out"), F.lit(True)).alias("held_out")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(4 * tasks, 100_000)
    state = save_bucketed(chunks(docs.select("doc_id", held_out, "text")), "chunk", buckets)
    tables = [state]
    tokens, total = state.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    parts = 1 << max(4 * tasks, tokens // CHUNK_TOKENS).bit_length()
    model = Model(int(total), 0, min(64, max(32, int(tokens).bit_length() + 16)), parts, depth, divergence)
    for step in range(1, depth + 2):
        answers = _step(state, step, model).repartition(buckets, "chunk").groupBy("chunk")
        answers = save_bucketed(answers.agg(F.collect_list(F.struct("kind", "part", "data")).alias(f"answers{step}"), F.sum("seen").alias("seen")), "chunk", buckets)
        free_shuffles(spark)
        tables.append(answers)
        if step == 1:
            model = replace(model, vocabulary=answers.agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0])
        state = state.join(answers.drop("seen").hint("merge"), "chunk", "left")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = _row(batch, i, CHUNK_COLUMNS)
                _, n, base, p = walk(row, _answered(batch, i, depth + 1), model)
                sizes = np.asarray(row["sizes"], np.int64)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                sums = [np.bincount(owner, x, len(sizes)) for x in (n > 0, np.log10(base), np.log10(p))]
                values = [pa.array(sizes), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(sizes), model.total)), pa.array(sums[1]), pa.array(sums[2])]
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id")[i].values, column(batch, "held_out")[i].values, *values], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = state.mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = save(out)
    for table in tables:
        discard(table)
    return out


def lm_scores(docs: DataFrame) -> DataFrame:
    """The contract of ``op3``: learn where crc32(doc_id) mod 10 is not 0, score every row."""
    return score_documents(docs.select("doc_id", (id_remainder("doc_id", 10) == 0).alias("held_out"), "text"))
