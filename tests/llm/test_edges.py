"""Nulls, empty and long texts, repeats, empty tables and clashing columns: nothing crashes, and each case has its result."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from lensfold.llm import decontaminate, embedding_dedup, html_text, language_id, packing, quality, simhash_dedup, substring_dedup, suffix_tree_lm, url_filter


@pytest.fixture
def benchmark_rows(spark):
    return spark.createDataFrame([(1, "jumps over the lazy dog again and again until the evening comes and"), (2, None), (3, ""), (None, "quick brown fox")], "item_id long, text string")


def by_text(rows, name):
    return [r[name] for r in rows]


def test_language(odd_docs, no_docs):
    got = language_id.predict_languages(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5, 8)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    assert language_id.predict_languages(no_docs).count() == 0


def test_decontamination(odd_docs, no_docs, benchmark_rows):
    got = decontaminate.contamination_report(odd_docs, benchmark_rows).collect()
    assert len(got) == odd_docs.count()
    hit = [r for r in got if r.contaminated]
    assert [r.doc_id for r in hit] == [1, 2] and hit[0].n_items == 2
    assert {r.n_words for r in got if r.doc_id in (3, 4, 5)} == {0}
    kept = decontaminate.decontaminate(odd_docs, benchmark_rows)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 2
    assert decontaminate.contamination_report(no_docs, benchmark_rows).count() == 0
    assert decontaminate.contamination_report(odd_docs, benchmark_rows.limit(0)).filter("contaminated").count() == 0


def test_simhash(odd_docs, no_docs):
    got = simhash_dedup.simhash_report(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r.fingerprint for r in got if r.doc_id in (3, 4, 5)} == {"0" * 16}
    assert {r.component_id for r in got if r.doc_id in (3, 4, 5)} == {3}
    assert {r.component_id for r in got if r.doc_id == 2} == {1}
    kept = simhash_dedup.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 2 not in ids and 4 not in ids and None in ids and ids.count(1) == 2
    assert simhash_dedup.simhash_report(no_docs).count() == 0


def test_substrings(odd_docs, no_docs):
    got = substring_dedup.substring_report(odd_docs).collect()
    assert len(got) == odd_docs.count()
    cleaned = substring_dedup.remove_repeats(odd_docs)
    assert cleaned.columns == odd_docs.columns
    assert substring_dedup.substring_report(no_docs).count() == 0 and substring_dedup.remove_repeats(no_docs).count() == 0


def test_packing(odd_docs, no_docs):
    got = packing.pack(odd_docs).collect()
    assert sum(r.n_tokens for r in got if r.doc_id == 7) == 30001
    assert [r.n_tokens for r in got if r.doc_id in (3, 4, 5)] == [1, 1, 1]
    assert packing.pack(no_docs).count() == 0


def test_lm(odd_docs, no_docs):
    got = suffix_tree_lm.lm_scores(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert suffix_tree_lm.lm_scores(no_docs).count() == 0


def test_quality(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (7, 0, 0), (9, 1, 1), (None, 1, 1), (8, None, None), (77, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_report(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.p_good <= r.p_clean <= 1 for r in got)
    assert quality.quality_report(no_docs, labels).count() == 0
    assert quality.quality_report(odd_docs, labels.limit(0)).count() == odd_docs.count()


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0, 0.0, 0.0]), (3, None), (4, [0.0] * 5), (5, [1.0, None, 0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 0.0, 0.0, 0.0]), (7, []), (None, [1.0, 0.0, 0.0, 0.0, 0.0]), (8, [1.0, 0.0, 0.0, 0.0, 0.0]), (9, [1.0, 0.0]), (10, [0.0, 1.0, 0.0, 0.0, 0.0]), (11, [1e300, 1e300, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_components(df).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[8] == (2, 1, False)
    for k in (3, 4, 5, 6, 7, 9, 10, 11):
        assert got[k] == (0, k, True)
    assert got[None] == (0, None, False)
    assert embedding_dedup.embedding_components(df.limit(0)).count() == 0


def test_pages(spark):
    df = spark.createDataFrame([(1, None, None), (2, "x", ""), (None, "http://a.net/b", "<p>One, two, three words in a paragraph &amp; more."), (3, "y", "<div" * 2000)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got[1] == got[2] == "" and got[None] == "One, two, three words in a paragraph & more."
    assert html_text.extract(df.limit(0)).count() == 0
    rules = url_filter.rules_table(df.sparkSession)
    judged = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df.withColumn("key", F.lit(1)), rules).collect()}
    assert judged[1] == ("", "", None, "allow") and judged[None] == ("a.net", "/b", "net/", "block")
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0 and url_filter.judge_urls(df, rules.limit(0)).count() == 4


def test_pipeline_keeps_columns(spark, odd_docs, no_docs, tmp_path, benchmark_rows):
    benchmark_rows.write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (odd_docs.select("doc_id", "text", "lang", "source", "n_chars"), no_docs):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.dtypes == start.dtypes
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()


def test_near_copies_of_one_id(spark):
    """A text that shares its id with a copy stays; repeated rows stay or go together; null ids stay."""
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa "
    rows = [(1, long), (2, long), (2, "another text of its own with other words"), (1, long), (None, long)]
    got = simhash_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[0], rows[2], rows[3], rows[4]], key=str)


def test_longest_match(spark):
    """The longest verbatim match may be longer than a window or shorter, and runs of different items are not one match."""
    item = " ".join(f"w{k}" for k in range(15))
    docs = [(1, f"x {item} y"), (2, "a b " + " ".join(f"w{k}" for k in range(9)) + " c"), (3, "no such words"), (4, "w3 w4 w5 v0 v1 v2 v3 v4"), (5, "q one"), (6, None)]
    bench = [("i", item), ("j", " ".join(f"v{k}" for k in range(12))), ("k", "one")]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id string, text string")).collect()
    assert {r.doc_id: (r.longest_match, r.longest_at, r.n_hit) for r in got} == {1: (15, 1, 15), 2: (9, 2, 0), 3: (0, None, 0), 4: (5, 3, 0), 5: (1, 1, 1), 6: (0, None, 0)}


def test_passage_in_texts_of_one_id(spark):
    """Rows that share an id and differ in text are different documents."""
    shared = " ".join(f"p{k}" for k in range(60))
    own = lambda x: " ".join(f"{x}{k}" for k in range(40))
    docs = spark.createDataFrame([(5, f"{own('a')} {shared} {own('b')}"), (5, f"{own('c')} {shared} {own('d')}"), (None, f"third {shared}")], "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed, r.repeats) for r in substring_dedup.substring_report(docs).collect())
    assert got == [(61, 0, False), (140, 0, False), (140, 60, True)]


def test_quality_of_repeated_ids(spark):
    """Several texts of an id teach once, whatever the order and number of rows."""
    rows = [(k, f"good{k % 5} words here {k}" if k % 2 else f"bad{k % 5} junk there {k}") for k in range(60)]
    rated = spark.createDataFrame([(k, 2 * (k % 2)) for k in range(60)], "doc_id long, grade int")
    one = quality.learn(rated, spark.createDataFrame(rows, "doc_id long, text string"))
    many = quality.learn(rated, spark.createDataFrame(rows[::-1] + [(k, t + " zzz") for k, t in rows] * 3, "doc_id long, text string"))
    assert np.allclose(one.weights, many.weights, atol=1e-5) and np.allclose(one.thresholds, many.thresholds, atol=1e-5)
