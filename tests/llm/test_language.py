"""Rank-order profiles against a plain version, word by word."""

import collections
import zlib

import numpy as np
import pytest

from lensfold.llm import language_id

SF = "/root/testdata/sf0.001"


def plain_grams(text):
    """Codes of the 1-, 2- and 3-grams of edged words, with their counts."""
    counts, word = collections.Counter(), []
    for c in [*(text or "").lower(), " "]:
        if c.isalpha():
            word.append(ord(c))
        elif word:
            edged = [language_id.EDGE, *word, language_id.EDGE]
            counts.update(word)
            counts.update(a << 21 | b for a, b in zip(edged, edged[1:], strict=False))
            counts.update((a << 21 | b) << 21 | c for a, b, c in zip(edged, edged[1:], edged[2:], strict=False))
            word = []
    return counts


def plain_top(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]


def plain_language(text, profiles, size):
    own = plain_top(plain_grams(text), size)
    if not own:
        return "und", 0.0
    far = {lang: sum(abs(ranks[g] - k) if g in ranks else size for k, g in enumerate(own)) for lang, ranks in profiles.items()}
    best = min(sorted(far), key=lambda lang: far[lang])
    return best, 1 - far[best] / (len(own) * size)


def test_predictions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    size, learned = 60, collections.defaultdict(collections.Counter)
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None:
            learned[r.lang].update(plain_grams(r.text))
    profiles = {lang: {g: k for k, g in enumerate(plain_top(counts, size))} for lang, counts in learned.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict_languages(docs, size).collect()}
    for r in rows:
        lang, score = plain_language(r.text, profiles, size)
        assert got[r.doc_id] == (lang, pytest.approx(score))


def test_ties_go_to_the_first_language():
    own = language_id.top(*language_id.gram_counts("aab abb", language_id.Letters()), 4)
    rank = language_id.Ranker({"b": own, "a": own}, 4)
    assert rank("aab abb") == ("b", 1.0)  # profiles come in the order of their names from learn_profiles
    assert rank("") == rank(None) == rank("12 !?") == ("und", 0.0) and language_id.Ranker({}, 4)("text") == ("und", 0.0)


def test_no_word_is_cut():
    text = "один zwei trois-quatre, " * 30 + "x" * 50 + " été"
    want = plain_grams(text)
    for size in (1, 2, 3, 7, 64, 1 << 20):
        assert "".join(language_id.pieces(text, size)) == text
        keys, counts = language_id.gram_counts(text, language_id.Letters(), size)
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want and (np.diff(keys) > 0).all()
