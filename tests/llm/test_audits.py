"""Filter audit, licence scan and spelling variants: against SQL on the smallest tables and plain versions on odd rows."""

import collections
import itertools
import math
import random
import re
import zlib

import __spark_entry__
import oracle
import pytest
from pyspark.sql import functions as F

from lensfold.llm import filter_audit, license_scan, spelling_groups

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_license_scan", "op13_spelling_groups"])
def test_sql(spark, name):
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    assert oracle.difference(got, oracle.connect(SF).sql(__spark_entry__.oracle_sql()[name]).df()) == ""


# -- op11 --


def plain_failures(rows):
    """(part, failed filters) of (doc_id, text, source) rows."""
    out = []
    for i, text, source in rows:
        text, words = text or "", re.findall("[^\x20\x09-\x0d]+", text or "")
        smaller = any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in rows)
        capitals = len(re.findall("[A-Z]", text))
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * capitals > 2 * len(text)}
        fails |= {"D": bool(re.search("[#$%&*|]", text)), "E": smaller}
        out.append((source or "", {k for k, v in fails.items() if v}))
    return out


def plain_audit(failed, good, toxic):
    rows, removed_by = {}, collections.Counter()
    for part in {p for p, _ in failed}:
        own = [(f, g, t) for (p, f), g, t in zip(failed, good, toxic, strict=True) if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, name in enumerate(order, 1):
                left = [x for x in own if not x[0] & set(order[: step - 1])]
                gone = [x for x in left if name in x[0]]
                removed_by[part, name] += len(gone)
                rows[part, order, step] = [
                    len(left) - len(gone), len(gone), sum(name in x[0] for x in own) - len(gone),
                    sum(x[1] for x in gone), sum(x[2] for x in gone), sum(x[0] == {name} for x in own),
                ]
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def collected_audit(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.good_lost, r.toxic_lost, r.unique_fails, r.shapley) for r in df.collect()}


def test_audit_of_odd_rows(spark, odd_docs):
    """Null and repeated ids, null texts and sources, several labels of an id, null labels; E looks at smaller ids alone."""
    more = [(20, "Same # TEXT", "x"), (21, "Same # TEXT", None), (21, "Same # TEXT", "x"), (None, "Same # TEXT", "x"), (22, "a b " * 150, "x"), (23, None, "")]
    extra = spark.createDataFrame(more, "doc_id long, text string, source string")
    docs = odd_docs.unionByName(extra, allowMissingColumns=True).withColumns({"part": F.lit("?"), "fails": F.lit(31), "first": F.lit(0)})
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (21, 1, None), (None, 1, 1), (20, None, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    good, toxic = [r[0] in (1, 21) for r in rows], [r[0] in (1, 20) for r in rows]
    got = collected_audit(filter_audit.filter_audit(docs, labels))
    assert got == plain_audit(plain_failures(rows), good, toxic)
    assert got["x", "EABCD", 1][1] == 1  # of two rows of id 21 one is in x, and the null id never fails
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0
    assert filter_audit.filter_audit(docs, labels.limit(0)).count() == len(got)


def test_audit_of_many_parts(spark):
    """More parts than words of a bitmap, packed a few rows at a time."""
    rng = random.Random(3)
    rows = [(f"p{rng.randrange(60) ** 2 // 60}", rng.randrange(32), rng.random() < 0.3, rng.random() < 0.2) for _ in range(1500)]
    df = spark.createDataFrame(rows, "part string, fails int, good boolean, toxic boolean").repartition(3)
    counts = filter_audit.prefix_counts(df, hold=100).filter("before = 5 and next = 1").collect()
    for r in counts:
        own = [x for x in rows if x[0] == r.part]
        gone = [x for x in own if x[1] & 2 and not x[1] & 5]
        assert (r.removed, r.kept) == (len(gone), len([x for x in own if not x[1] & 7])) and r.toxic_lost == sum(x[3] for x in gone)
    assert len(counts) == len({x[0] for x in rows})


def test_words_of_long_texts():
    text = b"aa bb\x0bcc\taa" * 50 + b"x" * 40 + b" end"
    assert filter_audit.word_counts(text, size=7) == (len(text.split()), len(set(text.split())))
    assert filter_audit.word_counts(b"") == (0, 0)


# -- op12 --


def plain_scan(texts, min_share=0.8):
    """Every place of every template in every text, word by word."""
    words = [license_scan.split_words(t or "") for t in texts]
    templates = [(label, True, license_scan.split_words(p), [license_scan.split_words(p)]) for label, p in license_scan.PHRASES]
    templates += [(label, False, license_scan.split_words(t), [license_scan.split_words(k) for k in keys]) for label, t, keys in license_scan.NOTICES]
    weight = {w: math.log(1 + len(texts) / (1 + sum(w in own for own in words))) for _, _, t, _ in templates for w in t}
    out = []
    for own in words:
        base, labels, score = [], set(), 0.0
        for label, phrase, t, keys in templates:
            starts = [next(k for k in range(len(t)) if t[k : k + len(key)] == key) for key in keys]
            for at in range(-len(t), len(own)):
                if any(at + s < 0 or own[at + s : at + s + len(key)] != key for s, key in zip(starts, keys, strict=True)):
                    continue
                share = sum(weight[w] for k, w in enumerate(t) if 0 <= at + k < len(own) and own[at + k] == w) / sum(weight[w] for w in t)
                if phrase:
                    base.append((at, label))
                else:
                    score = max(score, share)
                if phrase or round(share, 9) >= min_share:
                    labels.add(label)
        at = [a for a, _ in base]
        out.append((len(own), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(score, 6)))
    return out


def scanned(df):
    return {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 6)) for r in df.collect()}


def test_scan_against_plain(spark):
    """Whole notices, notices cut off at either end, with changed words or wrong versions, phrases alone, repeats and other texts."""
    rng = random.Random(5)
    texts = [None, "", "  ", "-- ,,", "MIT License", "mit licenses", "the GNU\nGeneral, Public; LICENSE v2", "cc-by cc by CC BY-NC-SA 4.0 by", "Apache License apache license"]
    texts += [t for _, t, _ in license_scan.NOTICES] + [t for _, t, _ in license_scan.NOTICES if "version" in t for _ in range(3)]
    vocabulary = sorted({w for _, t, _ in license_scan.NOTICES for w in t.split()}) + ["é", "ünder", "2", "3", "4.0"]
    for _ in range(150):
        words = rng.choice(license_scan.NOTICES)[1].split()
        words = words[rng.randrange(3) :][: len(words) - rng.randrange(3)]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(rng.choices(vocabulary, k=rng.randrange(6)) + words + rng.choices(vocabulary, k=rng.randrange(6))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = scanned(license_scan.license_report(df))
    want = plain_scan(texts)
    assert [got[k] for k in range(len(texts))] == want
    assert len({w[5] for w in want}) > 15


def test_scan_cases(spark, odd_docs, no_docs):
    docs = odd_docs.withColumns({"labels": F.lit("?"), "word": F.lit(1), "n_words": F.lit(0)})
    got = license_scan.license_report(docs)
    assert got.count() == docs.count() and got.filter("labels <> '' or score > 0 or first_word is not null").count() == 0
    assert {r.n_words for r in got.filter("doc_id in (3, 4, 5)").collect()} == {0}
    assert license_scan.license_report(no_docs).count() == 0
    places = license_scan.scan_licenses(spark.createDataFrame([(1, "x Released under the MIT License. y released under the apache license")], "doc_id long, text string")).first()
    assert [(p.label, p.phrase, p.first, p.end) for p in places.places if p.share == 1] == [("mit", False, 1, 6), ("mit", True, 4, 6), ("apache", True, 10, 12)]
    assert places.labels == "apache,mit" and places.score == 1


def test_licence_words_across_blocks():
    index = license_scan.LicenseIndex()
    text = "é MIT license, gnu" * 9 + "  " * 30 + "w" * 700 + " General public"
    for size in (1, 2, 3, 7, 64, 1 << 22):
        assert index.numbers(text.encode(), size).tolist() == [index.number.get(w, 0) for w in license_scan.split_words(text)]
    with pytest.raises(ValueError):
        license_scan.LicenseIndex(notices=[("x", "one two", ("three",))])


# -- op13 --


def plain_vocabulary(rows):
    counts = collections.Counter()
    for i, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    return sum(x != y for x, y in zip(a, b, strict=True)) == 1 if len(a) == len(b) else any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(counts):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        out[w] = [form, None, n, len(near), counts[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return {w: tuple(v) for w, v in out.items()}


def grouped_words(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling_of_odd_rows(spark, odd_docs, no_docs):
    """Null ids and texts, letters beyond ASCII kept as they are, runs with a letter deleted, repeated rows counted each."""
    more = [(k, "Àrbre arbre ARBRE àrbre arbres tarbre, arbe zebra9zebra zébra") for k in range(100, 1300)] + [(None, "Coeur coeur cœur coeurs")] * 3
    docs = odd_docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True).withColumns({"word": F.lit("?"), "n": F.lit(0), "run": F.lit("x")})
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    words = plain_vocabulary(rows)
    assert "Àrbre" in words and "àrbre" in words and {"rbres", "abres", "arres", "arbes", "arbrs"} & set(words)  # a letter was deleted
    assert grouped_words(spelling_groups.spelling_report(docs)) == plain_groups(words)
    assert spelling_groups.spelling_report(no_docs).count() == 0


def test_near_words_find_all(spark):
    """Few letters in many words: every kind of edit at every place, ties and chains of forms."""
    rng = random.Random(11)
    counts = {}
    for alphabet in ("ab", "abcdé", "abcdefghijklmnopqrstuvwxyzÿ"):
        while len(counts) < 400 * len(alphabet) ** 0.3:
            word = "".join(rng.choices(alphabet, k=rng.choice((5, 5, 6, 7, 8))))
            for _ in range(4):
                k = rng.randrange(len(word) + 1)
                counts[word] = 1 << rng.randrange(7)
                word = rng.choice((word[:k] + rng.choice(alphabet) + word[k:], word[:k] + word[k + 1 :], word[:k] + rng.choice(alphabet) + word[k + 1 :]))
                word = word if len(word) >= 5 else word + alphabet[0] * 5
    counts["日本語文字列"], counts["日本語文字"] = 4, 9  # letters beyond the 180 of the mask share bits
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = {(r.a, r.b) for r in spelling_groups.near_words(words).collect()}
    assert {frozenset(p) for p in pairs} == {frozenset(p) for p in itertools.combinations(counts, 2) if one_edit(*p)}
    assert len(pairs) == spelling_groups.near_words(words).count()
    assert grouped_words(spelling_groups.spelling_groups(words)) == plain_groups(counts)


def test_letters_share_bits(spark):
    """More letters than the masks have bits."""
    letters = [chr(0x4E00 + k) for k in range(400)]
    rng = random.Random(2)
    words = {"".join(rng.choices(letters, k=6)) for _ in range(300)}
    words |= {w[:3] + rng.choice(letters) + w[4:] for w in sorted(words)[:80]} | {w[:2] + w[3:] for w in sorted(words)[80:160]}
    df = spark.createDataFrame([(w, 3) for w in sorted(words)], "word string, n long")
    got = {frozenset((r.a, r.b)) for r in spelling_groups.near_words(df).collect()}
    assert got == {frozenset(p) for p in itertools.combinations(words, 2) if one_edit(*p)} and len(got) > 100
