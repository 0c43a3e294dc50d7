"""Scans of stated queries against all pages, against brute force; blocks, ties, nulls and folded text."""

import re
import unicodedata

import pytest
from conftest import CHECK, SMALL

from tracelode.functions import text as X
from tracelode.operators import ranking as R
from tracelode.operators import scan
from tracelode.plans import registry

PAGES = [("a", 1, "alpha beta"), ("a", 2, "gamma"), ("b", 1, "delta"), (None, None, None), ("c", 1, ""), ("c", 2, "\uff21\uff4cpha \u4e2d\u6587\u5b57 x"), ("c", 3, "alpha beta")]


def _frames(spark, queries):
    return spark.createDataFrame(PAGES, "source_id string, page_number long, text string").repartition(3), spark.createDataFrame(queries, "item_id long, text string")


def test_absence_check(spark):
    def compact(t):
        return re.sub(r"\s+", "", t.lower())

    texts = [compact(x.text or "") for x in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = {x.item_id for x in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if any(compact(x.text) in t for t in texts)}
    got = [x.case_id for x in registry.QUERIES["absence_check"](spark, SMALL).collect()]
    assert sorted(got) == sorted(want) and max(want) >= 10


def test_quota_bundle_uses_every_item(spark, tmp_path):
    (tmp_path / "events.parquet").symlink_to(f"{CHECK}/events.parquet")
    (tmp_path / "documents.parquet").symlink_to(f"{SMALL}/documents.parquet")
    spark.createDataFrame([(k, f"word{k}") for k in range(60)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    episodes = {x.user_id for x in spark.read.parquet(f"{CHECK}/events.parquet").select("user_id").distinct().collect()}
    got = {x.item_id for x in registry.QUERIES["quota_bundle"](spark, str(tmp_path)).where("domain = 'robot'").collect()}
    assert got == {e - 1 for e in episodes} & set(range(60)) and max(got) >= 40


def test_zeros_fill_a_list(spark):
    pages, queries = _frames(spark, [(0, "alpha"), (1, "omega"), (2, None)])
    got = {(x.item_id, x.rank): (x.source_id, x.page_number, x.score > 0) for x in R.bm25_search(pages, queries, 9, with_zeros=True).collect()}
    assert len(got) == 3 * len(PAGES)
    assert [got[0, k][:2] for k in (1, 2, 3)] == [("c", 2), ("a", 1), ("c", 3)] or [got[0, k][:2] for k in (1, 2, 3)] == [("a", 1), ("c", 3), ("c", 2)]
    assert got[1, 1] == (None, None, False) and got[2, 2] == ("a", 1, False)
    assert R.bm25_search(pages, queries.where("false"), 3).count() == 0 and R.bm25_search(pages.where("false"), queries, 3).count() == 0


def test_blocks_give_the_same_rows(spark):
    pages, queries = _frames(spark, [(k, w) for k, w in enumerate(["alpha", "beta gamma", "\u4e2d\u6587", "delta delta", "", "x alpha x"])])
    for shares in (False, True):
        one = scan.best_pages(pages, queries, 3, shares=shares, with_zeros=True)
        many = scan.best_pages(pages, queries, 3, shares=shares, with_zeros=True, bound=4)
        assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    assert sorted(map(str, scan.ties(pages, queries).collect())) == sorted(map(str, scan.ties(pages, queries, bound=4).collect()))
    assert sorted(map(str, scan.containing(pages, queries).collect())) == sorted(map(str, scan.containing(pages, queries, bound=4).collect()))


def test_ties_count_past_any_list(spark):
    pages = spark.createDataFrame([("s", k, "same words" if k % 2 else "other") for k in range(60)], "source_id string, page_number long, text string")
    queries = spark.createDataFrame([(1, "same words"), (2, "nothing")], "item_id long, text string")
    got = {x.item_id: (x.top_score, x.n_exact, x.n_near) for x in scan.ties(pages, queries).collect()}
    assert got == {1: (1.0, 30, 30), 2: (0.0, 60, 60)}


def test_containing(spark):
    pages, queries = _frames(spark, [(1, "alpha"), (2, "alpha"), (3, "eta"), (4, ""), (5, None), (6, "absent")])
    got = {(x.item_id, x.source_id, x.page_number) for x in scan.containing(pages, queries).collect()}
    want = {(i, s, p) for i, q in [(1, "alpha"), (2, "alpha"), (3, "eta"), (4, "")] for s, p, t in PAGES if t is not None and q in t}
    assert got == want
    assert {x.item_id for x in scan.containing(pages, queries, scan.compact, any_page=True).collect()} == {1, 2, 3, 4}


@pytest.mark.parametrize("text", ["\uff21\uff22c \ufb01ne", "\u4e2d\u6587\u5b57 a.b-c d_e", "x\u3000y\u00a0z", "K\u212a", "", "a..b 1/2"])
def test_tokens_agree_on_both_sides(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(X.tokenize_mixed(X.F.col("t")).alias("x"), X.compact_text(X.F.col("t")).alias("c")).first()
    assert got.x == scan.tokens_of(text) and got.c == scan.compact(text)
    assert scan.tokens_of(text) == scan.tokens_of(unicodedata.normalize("NFKC", text))
