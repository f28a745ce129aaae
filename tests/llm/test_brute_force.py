"""Each corpus operator against a plain version of its contract, over the smallest tables or planted rows."""

import collections
import itertools
import math
import os
import random
import re
import zlib

import __spark_entry__
import corpus_pipeline
import duckdb
import numpy as np
import oracle
import pytest
import xxhash
from pyspark.sql import functions as F

from lensfold.llm import components, embedding_dedup, html_text, language_id, packing, quality, simhash_dedup, substring_dedup, suffix_tree_lm
from lensfold.llm.common import save

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def words(text):
    return (text or "").encode().lower().split()


def reach(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("name", ["op1_decontamination", "op4_embedding_dedup", "op8_url_filter"])
def test_sql(spark, name):
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    assert oracle.difference(got, oracle.connect(SF).sql(__spark_entry__.oracle_sql()[name]).df()) == ""


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 900)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = reach({x for p in links for x in p}, links)
    assert {k: got.get(k, k) for k in want} == want
    a, b = np.array(links).T
    assert {int(k): int(v) for k, v in enumerate(components.local_labels(900, a, b)) if k in want} == want


def test_simhash(docs, texts):
    def fingerprint(text):
        w = words(text)
        shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    want = {i: fingerprint(t) for i, t in texts.items()}
    linked = [(a, b) for a, b in itertools.combinations(sorted(texts), 2) if (want[a] ^ want[b]).bit_count() <= 2]
    classes = reach(texts, linked)
    got = simhash_dedup.simhash_report(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", classes[i]) for i, f in want.items()}


@pytest.mark.parametrize("max_node", [4, 1024])
def test_trie_join(spark, max_node):
    """Dense clusters: subtrees that must be cut, and those that need not be, give the same components."""
    rng = random.Random(max_node)
    fps = set()
    for _ in range(8):
        base = rng.getrandbits(64)
        for _ in range(60):
            x = base
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    links = [(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    got = {r.node: r.component for r in components.connected_components(simhash_dedup.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), max_node=max_node)).collect()}
    want = reach(fps, links)
    assert {f: got.get(f, f) for f in fps} == want


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98


def test_language_distance():
    profiles = {"a": np.array([5, 3, 9]), "b": np.array([9, 5, 7])}
    rank = language_id.Ranker(profiles, 3)
    own = np.array([9, 5, 8])
    known = rank.ranks[np.where(np.isin(own, rank.grams), np.searchsorted(rank.grams, own) % len(rank.grams), -1)]
    far = np.where(known < 0, 3, np.abs(known - np.arange(3)[:, None])).sum(axis=0)
    assert far.tolist() == [2 + 1 + 3, 0 + 0 + 3]


def test_lm_base_and_model(docs, texts):
    def tokens(t):
        return [*words(t), b" "]

    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter(x for i, t in texts.items() if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    rows = suffix_tree_lm.lm_scores(docs).collect()
    for r in rows:
        own = tokens(texts[r.doc_id])
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(x in c for x in own), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


class PlainTree:
    """The suffix tree of some token lists, in dictionaries."""

    def __init__(self, texts, depth, divergence):
        self.depth, self.words = depth, collections.Counter(x for t in texts for x in t)
        self.n, self.next = sum(self.words.values()), collections.defaultdict(collections.Counter)
        for t in texts:
            for k in range(1, depth + 1):
                for i in range(k, len(t)):
                    self.next[t[i - k : i]][t[i]] += 1
        self.passed = {}
        for s in sorted(self.next, key=len):
            total, kept = sum(self.next[s].values()), {w: n for w, n in self.next[s].items() if n > 1}
            if total < 2 or not kept:
                continue
            own = {w: (n - 0.5) / total for w, n in kept.items()}
            parent = {w: self.p(s[1:], w) for w in kept}
            passed = 1 - sum(own.values())
            gain = sum(own[w] * math.log(own[w] / parent[w]) for w in kept) + passed * math.log(passed / max(1 - sum(parent.values()), 1e-12))
            if gain >= divergence:
                self.passed[s] = passed

    def p(self, s, w):
        if not s:
            return (self.words[w] + 0.1) / (self.n + 0.1 * (len(self.words) + 1))
        below = self.p(s[1:], w)
        if s not in self.passed:
            return below
        n = self.next[s][w]
        return (n > 1) * (n - 0.5) / sum(self.next[s].values()) + self.passed[s] * below

    def score(self, t):
        return sum(math.log10(self.p(t[max(0, i - self.depth) : i], w)) for i, w in enumerate(t))


@pytest.mark.parametrize(("depth", "chunk"), [(0, 1 << 20), (3, 1 << 20), (2, 5000)])
def test_lm_equals_plain_tree(docs, texts, depth, chunk, monkeypatch):
    """All contexts and words that occur twice count, whatever the chunks."""
    monkeypatch.setattr(suffix_tree_lm, "CHUNK_TOKENS", chunk)
    tokens = {i: (*words(t), b" ") for i, t in texts.items()}
    tree = PlainTree([t for i, t in tokens.items() if i % 10], depth, suffix_tree_lm.DIVERGENCE)
    assert depth < 2 or 0 < len(tree.passed) < sum(sum(n.values()) > 1 for n in tree.next.values())
    split = docs.select("doc_id", (F.col("doc_id") % 10 == 0).alias("held_out"), "text")
    rows = suffix_tree_lm.score_documents(split, depth=depth).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.score == pytest.approx(tree.score(tokens[r.doc_id]), rel=1e-5)
    seen = [s for s in tree.passed if len(s) == depth][:5]
    for s in seen:
        assert sum(tree.p(s, w) for w in tree.words) + 0.1 / (tree.n + 0.1 * (len(tree.words) + 1)) * math.prod(tree.passed.get(s[k:], 1) for k in range(depth)) == pytest.approx(1)


def test_lm_packing():
    rng = np.random.default_rng(1)
    for n, top in ((1, 5), (1000, 1 << 20), (1000, 1 << 62), (3, 1 << 63)):
        x = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        assert (suffix_tree_lm.unpacked_keys(suffix_tree_lm.packed_keys(x)) == x).all()
        assert (suffix_tree_lm.unpacked(suffix_tree_lm.packed(x)) == x).all()
        for bits in (63, 64):
            distinct, at = suffix_tree_lm.ranked(np.r_[x, x[::-1]], bits)
            assert (distinct == x).all() and (distinct[at] == np.r_[x, x[::-1]]).all()
    x = np.array([0, 1, 2, 3, 1 << 40, (1 << 40) + 1], np.uint64)
    assert (suffix_tree_lm.unpacked_keys(suffix_tree_lm.packed_keys(x)) == x).all()


def test_lm_tree_grows(spark):
    """What occurs twice counts in a small corpus and in a large one, in contexts of three words too."""
    rng = random.Random(6)
    filler = [" ".join(f"w{rng.randrange(50)}" for _ in range(5000)) for _ in range(200)]
    rows = [(k, False, t) for k, t in enumerate([*filler, "w1 w2 w3 alpha", "w1 w2 w3 alpha"])] + [(900, True, "w1 w2 w3 alpha"), (901, True, "w1 w2 w4 alpha")]
    got = {r.doc_id: r for r in suffix_tree_lm.score_documents(spark.createDataFrame(rows, "doc_id long, held_out boolean, text string")).collect()}
    assert got[900].score - got[900].base_score > got[901].score - got[901].base_score + 1


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 24))
    x = np.concatenate([c + s * rng.standard_normal((60, 24)) for c, s in zip(centres, (0.02, 0.1, 0.2, 0.25, 0.3, 1), strict=True)])
    x[10] = x[11] = x[12]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argwhere(np.triu(unit @ unit.T >= 0.95, 1))
    rows = embedding_dedup.embedding_components(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), max_group=32).collect()
    n = np.bincount(near.ravel(), minlength=len(x))
    got = {r.vec_id: r for r in rows}
    assert all(got[i].n_links <= n[i] for i in got)
    assert sum(r.n_links for r in rows) >= 0.99 * n.sum()
    want = reach(range(len(x)), near.tolist())
    assert sum(got[i].component_id == want[i] and got[i].kept == (want[i] == i) for i in got) >= 0.99 * len(x)


def test_product_code_recall():
    rng = np.random.default_rng(1)
    x, g = rng.standard_normal((2, 1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g -= (g * x).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    for size in (9, 30):
        code = embedding_dedup.ProductCode(64, size, 2, 14)
        assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(code.decode(x), code.decode(y), strict=True)]) > 0.98


def test_product_code_lists_best_filters():
    code = embedding_dedup.ProductCode(8, 3, 1, 5)
    v = np.random.default_rng(0).standard_normal((4, 8))
    z, books = v @ code.turns[0], code.books[0]
    for row, found in zip(z, code.decode(v), strict=True):
        sums = [sum(row[p] @ b[k] for p, b, k in zip(code.parts, books, ks, strict=True)) for ks in itertools.product(range(3), repeat=4)]
        assert sorted(np.argsort(sums)[-5:].tolist()) == found.tolist()


PAGES = [
    ('<body><nav><a href="/">Home</a></nav><article><h1>Title</h1><p>First, a long paragraph of the text, with commas.</p><p>Second &lt;one&gt;&nbsp; here</p></article><aside>Aside text, long, very long</aside></body>', "Title\nFirst, a long paragraph of the text, with commas.\nSecond <one> here"),
    ('<div id="header"><h1>Site</h1></div><div class="cookie-notice"><p>We use cookies, all of them, always, and forever.</p></div><div id="content"><p>The text of the article, which is long enough.</p><form><p>Your mail, please, for letters</p></form><p>And its end, also long enough to count.</p></div><div class="comments"><p>I read this, all of it, and I disagree, strongly.</p></div>', "The text of the article, which is long enough.\nAnd its end, also long enough to count."),
    ("<p>Only<br>one <b>bold</b> block<script>var a='<p>no</p>'</script>", "Only one bold block"),
    ("<table><tr><td>Cell one of the table, long enough to be text</td><td>two</td></tr></table>", "Cell one of the table, long enough to be text\ntwo"),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("notice", ["", "<div><p>A short note without a class, for all readers.</p></div>"])
@pytest.mark.parametrize("size", [20, 60, 300])
@pytest.mark.parametrize("box", ["article", "div"])
def test_names_round_the_page(box, size, notice):
    """A name does not drop the article in a wrapper, whatever its length and what else is there; boxes inside go."""
    prose = " ".join(["Some words,"] * size + ["end"])
    comments = '<div class="comments"><article class="comment-body"><p>I disagree, strongly.</p></article></div>'
    side = '<div class="sidebar"><p>Other things, to read</p></div>'
    assert html_text.main_text(f'<div class="page has-sidebar"><{box}><p>{prose}</p></{box}>{side}{comments}</div>{notice}') == prose


@pytest.mark.parametrize("tag", ["article", "main"])
def test_whole_article(tag):
    """Headings, short sections and lists of sources of an article stay beside its longest part; furniture in it goes."""
    long = [f"Paragraph {k}, " + "of some length, with commas, " * 8 + "ends" for k in range(10)]
    sources = [f"Source {k}" for k in range(4)]
    html = f"<{tag}><h1>T</h1><section>{''.join(f'<p>{x}</p>' for x in long)}</section><section><p>Short.</p></section><p>So.</p><div class=share><p>Share</p></div><ul>{''.join(f'<li><a href=x>{x}</a></li>' for x in sources)}</ul></{tag}><footer>Foot</footer>"
    assert html_text.main_text(html).split("\n") == ["T", *long, "Short.", "So.", *sources]


def test_pages(spark):
    for r in html_text.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        assert r.n_chars == len(r.text) > 0


def test_packing(docs, texts):
    rows = packing.pack(docs, max_len=300, buckets=5, token_budget=4000, group_rows=50).collect()
    total = collections.Counter()
    for r in rows:
        total[r.doc_id] += r.n_tokens
    assert total == {i: len(words(t)) + 1 for i, t in texts.items()}
    assert len({(r.bucket, r.batch, r.slot) for r in rows}) == len(rows)
    for (_, _), group in itertools.groupby(sorted(rows, key=lambda r: (r.bucket, r.batch)), key=lambda r: (r.bucket, r.batch)):
        group = list(group)
        assert len(group) * group[0].bucket_len <= 4000 and max(r.n_tokens for r in group) <= group[0].bucket_len
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.bucket, r.batch)), key=lambda r: r.bucket):
        sizes = [len(list(g)) for _, g in itertools.groupby(group, key=lambda r: r.batch)]
        assert len(set(sizes[:-1])) <= 1


def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(40):
        lengths = rng.sample(range(1, 40), rng.randrange(1, 8))
        counts = [rng.randrange(1, 9) for _ in lengths]
        k = rng.randrange(1, 5)

        def padding(bounds, lengths=lengths, counts=counts):
            return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))

        best = min(padding([*p, max(lengths)]) for n in range(min(k, len(lengths))) for p in itertools.combinations(sorted(lengths)[:-1], n))
        assert padding(packing.best_boundaries(lengths, counts, k)) == best


def planted_passages(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(60), prose(50)
    near = line.split()
    near[10] = "changed"
    rows = [(i, "\n".join(prose(rng.randrange(20, 90)) for _ in range(4))) for i in range(40)]
    for i in (3, 8, 20, 33):
        rows[i] = (i, f"{prose(30)} {passage} {prose(25)}\n{prose(40)}")
    rows[5], rows[11] = (5, f"{prose(30)}\n{line}\n{prose(30)}"), (11, f"{prose(35)}\n{' '.join(near)}\n{prose(30)}")
    return spark.createDataFrame(rows, "doc_id long, text string"), passage


def test_substrings(spark):
    docs, passage = planted_passages(spark)
    got = {r.doc_id: r for r in substring_dedup.substring_report(docs).collect()}
    assert {i for i, r in got.items() if r.repeats} == {8, 20, 33, 11}
    assert all(got[i].kept_in == [3] for i in (8, 20, 33)) and got[11].kept_in == [5]
    assert got[11].n_removed == 50
    cleaned = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs).collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    assert [i for i in cleaned if passage in cleaned[i]] == [3]
    assert {i for i in before if cleaned[i] != before[i]} == {8, 20, 33, 11}
    for i in (8, 20, 33):
        assert before[i].split("\n")[1] == cleaned[i].split("\n")[1]


def test_substrings_go_to_their_ends(spark):
    """Passages inside longer lines are removed from their first word to their last, across documents and inside one."""
    rng = random.Random(12)
    prose = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], {}
    for k in range(40):
        n = rng.randrange(44, 150)
        passage, a, b = prose(n), rng.randrange(5, 60), rng.randrange(5, 60)
        rows += [(3 * k, " ".join(prose(a) + passage + prose(b))), (3 * k + 1, " ".join(prose(b) + passage + prose(a)))]
        inside = prose(n)
        rows.append((3 * k + 2, " ".join(prose(a) + inside + prose(b) + inside + prose(9))))
        want |= {3 * k: [], 3 * k + 1: [(b, b + n)], 3 * k + 2: [(a + n + b, a + 2 * n + b)]}
    got = substring_dedup.substring_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: [tuple(x) for x in r.spans] for r in got} == want
    assert all(r.kept_in == ([] if r.doc_id % 3 == 0 else [r.doc_id - (r.doc_id % 3 == 1)]) for r in got)


def test_bands_of_lines_that_a_row_without_id_has_first(spark):
    line = [f"w{k}" for k in range(60)]
    near = [*line[:30], "changed", *line[31:]]
    docs = spark.createDataFrame([(None, " ".join(line)), (1, " ".join(line)), (2, " ".join(near))], "doc_id long, text string").coalesce(1)
    tagged = docs.select("doc_id", F.hash("text").alias("tag"), "text")
    units = save(substring_dedup.paragraphs(tagged, 25, 0.8, 20))
    n_bands = substring_dedup.choose_bands(0.8)[0]
    assert units.filter(F.col("kind") == substring_dedup.BAND).count() == 2 * n_bands


def test_substrings_touch_every_repeat(docs, texts):
    spans = {r.doc_id: r.spans for r in substring_dedup.substring_report(docs).collect()}
    seen, repeats = {}, 0
    for i in sorted(texts):
        w = words(texts[i])
        removed = np.zeros(len(w) + 1, int)
        for s in spans[i]:
            removed[s["first"] : s["end"]] = 1
        for j in range(len(w) - 43):
            first = seen.setdefault(tuple(w[j : j + 44]), i)
            if first != i:
                repeats += 1
                assert removed[j : j + 44].any()
    assert repeats > 1000


def test_line_pairs(spark):
    """Verified links are those of exact Jaccard, up to what banding misses."""
    rng = random.Random(4)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(30)]
    lines = [list(b) for b in base]
    for b in base:
        for edits in (1, 1, 2, 3, 6):
            x = list(b)
            for _ in range(edits):
                x[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
            lines.append(x)
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    tagged = docs.select("doc_id", F.hash("text").alias("tag"), "text")
    units = save(substring_dedup.paragraphs(tagged, 25, 0.8, 20))
    names = {r.doc_id: r.key for r in units.filter(F.col("kind") == substring_dedup.LINE).collect()}
    for block in (8, 512):
        found = {r.node: r.component for r in substring_dedup.line_classes(units, tagged, 25, 0.8, block=block).collect()}
        shingles = [{tuple(x[k : k + 5]) for k in range(56)} for x in lines]
        links = [(names[a], names[b]) for a, b in itertools.combinations(range(len(lines)), 2) if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
        want = reach(names.values(), links)
        assert sum(found.get(n, n) == want[n] for n in names.values()) >= 0.97 * len(names)


def test_quality_held_out(spark):
    d = "/root/testdata/check_s"
    if not os.path.isdir(d):
        pytest.skip("the larger tables are not here")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", quality.rating(F.col("quality"), F.col("toxic")).alias("grade"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    model = quality.learn(labels.filter(~held), docs, sample=4000)
    assert (np.diff(model.thresholds) > 0).all()
    rated = labels.filter(held).withColumnRenamed("grade", "given")
    rows = quality.grade_documents(docs.join(rated.select("doc_id"), "doc_id", "left_semi"), model).join(rated, "doc_id").select("given", "grade", "expected_grade").collect()
    good = [r for r in rows if r.given == 2]
    assert sum(r.grade == 2 for r in good) / len(good) > 0.96
    bad = [r for r in rows if r.given == 0]
    assert sum(r.grade < 2 for r in bad) / len(bad) > 0.6


def test_pipeline(spark):
    plain = {r.doc_id for r in simhash_dedup.simhash_report(spark.read.parquet(f"{SF}/documents.parquet")).collect() if r.doc_id == r.component_id}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = save(stage(spark, docs, SF))
    left = {r.doc_id: r.text for r in docs.collect()}
    assert set(left) <= plain and len(left) > 0.8 * len(plain)
    bench = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()
    find = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    windows = {tuple(w[i : i + 10]) for (t,) in bench for w in [find(t)] for i in range(len(w) - 9)}
    for text in left.values():
        w = find(text)
        assert not any(tuple(w[j : j + 10]) in windows for j in range(len(w) - 9))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(left)
    total = collections.Counter()
    for r in rows:
        total[r.doc_id] += r.n_tokens
    assert total == {i: len(words(t)) + 1 for i, t in left.items()}
