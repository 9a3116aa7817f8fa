"""Cases of single operators: words beside others, odd class names, deep pages, a store that lives on."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiergraph.llm import dedup_exact, html_text, language, packing, simhash, token_store
from tiergraph.llm.common import work_path
from tiergraph.llm.tokens import tokenizer_path

SCHEMA = "doc_id bigint, text string"


@pytest.mark.parametrize("others", [[b"b"], [b"long", b"x"], [b"\xc3\xa9t\xc3\xa9"] * 3])
def test_features_of_a_word_are_its_own(others):
    for word in (b"a", b"ab", b"abc", b"\xc3\xa9"):
        alone, _ = language.feature_rows([word])
        rows, begin = language.feature_rows([*others, word, *others])
        k = len(others)
        assert rows[begin[k] : begin[k + 1]].tolist() == alone.tolist()


def test_language_scores_do_not_depend_on_batches(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["a", "y", "le", "the", "und", "x"]) for _ in range(rng.randint(1, 9)))) for k in range(60)]
    field = language.fit(["a the", "le y", "und x a"] * 5, ["en", "fr", "de"] * 5)
    docs = spark.createDataFrame(rows, SCHEMA)
    one = {r.doc_id: r.score for r in language.identify(docs.coalesce(1), field).collect()}
    many = {r.doc_id: r.score for r in language.identify(docs.orderBy(F.rand(3)).repartition(20), field).collect()}
    assert all(abs(one[k] - many[k]) < 1e-6 for k in one)


TEXT = " ".join("A sentence of some words stands here." for _ in range(50))


@pytest.mark.parametrize("name", ["main-content search-results", "banner-story", "note warning"])
def test_one_bad_word_in_a_class_takes_nothing(name):
    page = f"<html><body><nav><a>home</a></nav><div class='{name}'><p>{TEXT}</p><p>{TEXT}</p></div><footer>all rights</footer></body></html>"
    assert html_text.extract(page) == f"{TEXT}\n{TEXT}"


@pytest.mark.parametrize("name", ["discussion", "responses", "teaser", "more-stories", "paywall", "infobox", "toc"])
def test_what_is_no_article_text_goes(name):
    page = f"<html><body><article><h1>Title</h1><p>{TEXT}</p><div class='{name}'><p>not of the article</p></div><p>{TEXT}</p></article></body></html>"
    assert html_text.extract(page) == f"Title\n{TEXT}\n{TEXT}"


@pytest.mark.parametrize("piece", ["<span>a ", "<div>a ", "<p><b>a <hr>", "<li>a ", "<td>a ", "</p>a "])
def test_long_pages_take_time_in_proportion(piece):
    began = time.time()
    html_text.extract(piece * 20_000)
    assert time.time() - began < 10


def test_store_outlives_a_run(spark):
    store = work_path(spark, "dedup-lasting")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], SCHEMA)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in dedup_exact.exact_dedup(first, store=store).collect()} == {(1, 1, 1, True), (2, 3, 2, False), (3, 3, 2, True)}
    second = spark.createDataFrame([(0, "a"), (9, "b"), (10, "c")], SCHEMA)
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in dedup_exact.exact_dedup(second, store=store).collect()}
    assert got == {(0, 1, 2, False), (9, 9, 3, True), (10, 10, 1, True)}


def test_store_compares_bytes_of_an_earlier_run(spark):
    store = work_path(spark, "dedup-collide")
    digest = lambda t: F.unhex(F.lpad(F.hex(F.length(t)), 2, "0"))
    dedup_exact.exact_dedup(spark.createDataFrame([(5, "aa")], SCHEMA), digest=digest, store=store).collect()
    got = dedup_exact.exact_dedup(spark.createDataFrame([(6, "bb"), (7, "aa")], SCHEMA), digest=digest, store=store).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(6, 6, 1), (7, 7, 2)}


def test_sums_are_found_under_counts():
    rng = np.random.default_rng(4)
    for _ in range(200):
        count = np.zeros(41, np.int64)
        for x in rng.integers(1, 40, 8):
            count[x] += 1
        sums = packing.Complements(count)
        for gap in rng.integers(2, 40, 12).tolist():
            found = sums.fill(gap)
            have = [x for x in range(1, 41) for _ in range(int(count[x]))]
            exact = any(gap == a for a in have) or any(gap == a + b for i, a in enumerate(have) for b in have[i + 1 :])
            exact = exact or any(gap == a + b + c for i, a in enumerate(have) for j, b in enumerate(have[i + 1 :], i + 1) for c in have[j + 1 :])
            assert bool(found) == exact
            for x in found or ():
                count[x] -= 1
            assert count.min() >= 0 and (not found or sum(found) == gap)


def test_shards_roll_over_and_are_passed_over(spark, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_DOCS", 10)
    path = work_path(spark, "rolling")
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(100)], SCHEMA).coalesce(1)
    table = token_store.write_store(docs, path, tokenizer_path()).collect()
    assert max(r.docs for r in table) <= 10 and sum(r.docs for r in table) == 100 and all(r.low <= r.high for r in table)
    got = token_store.read_digests(spark, path).orderBy("doc_id").collect()
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert sorted(r.doc_id for r in token_store.read_ids(spark, path, [3, 77, 500]).collect()) == [3, 77]


def test_keep_one_of_each_with_odd_tables(spark):
    rows = [(None, "a b c"), (None, None), (1, ""), (1, "a b c"), (2, "a b c")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("component_id", F.lit(1)).withColumn("_drop_id", F.lit(2)).withColumn("fp", F.lit(3))
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, ""), (1, "a b c")]
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0
