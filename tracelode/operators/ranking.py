"""Ranking: BM25, dense and late-interaction search, fusion, candidate union, quotas, retrieval metrics.

Every ranking has a total order. Sums that decide an order are left folds in
query order, so equal scores are equal to the bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import numeric as N
from ..functions.text import tokenize_mixed
from . import scan
from .vectors import Block, searcher

K1, B, PAGE = scan.K1, scan.B, scan.PAGE
#: Numbers in query vectors that are broadcast at once; more are taken in blocks, one pass over the corpus for each.
QUERY_NUMBERS = 1 << 20
#: The same for ``dense_search``, where a task holds a block in matrices, and blocks that the driver fetches at once.
VECTOR_NUMBERS, FETCHED = 1 << 22, 4


def check_top_k(top_k: int) -> int:
    if isinstance(top_k, bool) or not isinstance(top_k, int) or top_k < 1:
        raise ValueError("top_k must be a whole number of at least 1")
    return top_k


def check_query(query: str) -> str:
    if not isinstance(query, str) or not query.strip():
        raise ValueError("the query must not be blank")
    return query.strip()


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], top_k: int, name: str = "rank") -> DataFrame:
    """The first ``top_k`` rows of each group in the given order, numbered from 1. Spark limits groups before its shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= top_k)


# --- BM25 ---


def corpus_stats(pages: DataFrame) -> DataFrame:
    """One row: n_docs and avg_len over the pages' tokens."""
    return pages.select(F.size(tokenize_mixed(F.col("text"))).alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_len"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(item_id, pos, term): every token of every query in order; repeated tokens are kept."""
    return queries.select("item_id", F.posexplode(tokenize_mixed(F.col("text"))).alias("pos", "term"))


def term_weights(pages: DataFrame, terms: DataFrame, k1: float = K1, b: float = B, among: DataFrame | None = None) -> DataFrame:
    """(source_id, page_number, term, tf, df, dl, idf, weight) for those terms of the pages that queries use.

    Corpus statistics are over all pages; rows are made for the pages of
    ``among`` (source_id, page_number) only, where it is given. Token counts are
    cut down to the queries' terms before anything is shuffled.
    """
    tokens = pages.select(*PAGE, tokenize_mixed(F.col("text")).alias("tokens")).withColumn("dl", F.size("tokens"))
    stats = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg_len"))
    wanted = terms.select("term").distinct()
    df = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    own = tokens if among is None else tokens.join(among.select(*PAGE).distinct(), PAGE, "left_semi")
    tf = (
        own.select(*PAGE, "dl", F.explode("tokens").alias("term")).join(wanted, "term", "left_semi")
        .groupBy(*PAGE, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    )
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = (F.col("tf") * F.lit(k1 + 1)) / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avg_len")))
    return tf.join(df, "term").crossJoin(F.broadcast(stats)).withColumn("idf", idf).withColumn("weight", F.col("idf") * part).drop("n", "avg_len")


def bm25_search(pages: DataFrame, queries: DataFrame, top_k: int = 5, k1: float = K1, b: float = B, with_zeros: bool = False) -> DataFrame:
    """The best pages of each query by (-score, source_id, page_number).

    With ``with_zeros`` pages without any query term fill a short list. Scores
    are rounded to 6 places after ranking.
    """
    check_top_k(top_k)
    best = scan.best_pages(pages, queries, top_k, with_zeros=with_zeros, k1=k1, b=b)
    return best.withColumn("score", F.round("score", 6))


def bm25_hits(pages: DataFrame, queries: DataFrame, top_k: int = 5) -> DataFrame:
    """``bm25_search`` with a preview of 240 characters."""
    best = bm25_search(pages, queries, top_k)
    return best.join(pages.select(*PAGE, F.substring("text", 1, 240).alias("text_preview")), PAGE)


def bm25_contributions(pages: DataFrame, queries: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(item_id, page, term, query_frequency, df, tf, idf, contribution) with position by (-contribution, term).

    ``among`` (item_id, source_id, page_number) names the pairs that are wanted;
    without it all pairs that share a term are listed.
    """
    terms = query_terms(queries)
    qf = terms.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("query_frequency"))
    weights = term_weights(pages, terms, among=among)
    if among is not None:
        weights = weights.join(among.select("item_id", *PAGE).distinct(), PAGE)
    rows = qf.join(weights, "term" if among is None else ["item_id", "term"]).withColumn("contribution", F.col("weight") * F.col("query_frequency"))
    w = Window.partitionBy("item_id", *PAGE).orderBy(F.desc("contribution"), "term")
    return rows.withColumn("position", F.row_number().over(w))


def tie_summary(pages: DataFrame, queries: DataFrame, near: float = 1e-12, shares: bool = True) -> DataFrame:
    """For each item over all pages: the top score, how many rows tie with it exactly, and how many lie within ``near``."""
    return scan.ties(pages, queries, near, shares)


# --- vectors ---


def query_blocks(queries: DataFrame, vectors: str, bound: int = QUERY_NUMBERS, least: int = 0) -> list[DataFrame]:
    """The queries as they are up to ``bound`` numbers in their vectors (``least`` for each query at least), else dealt into blocks by a hash of item_id."""
    nested = dict(queries.dtypes)[vectors].startswith("array<array")
    size = F.aggregate(F.transform(vectors, F.size), F.lit(0), lambda a, x: a + x) if nested else F.size(vectors)
    total = queries.agg(F.sum(F.greatest(size, F.lit(least)))).first()[0] or 0
    if total <= bound:
        return [queries]
    n = -(-2 * total // bound)  # at half load, so that an uneven deal stays in the bound
    return [queries.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)]


def against_all(rows: DataFrame, queries: DataFrame, vectors: str, search: Callable[[DataFrame], DataFrame], bound: int = QUERY_NUMBERS) -> DataFrame:
    """Stated queries against all rows: ``search`` ranks the pairs of all rows with one broadcast block of queries."""
    return reduce(DataFrame.unionByName, [search(rows.crossJoin(F.broadcast(block))) for block in query_blocks(queries, vectors, bound)])


def vector_blocks(queries: DataFrame, bound: int, least: int) -> Iterator[tuple[int, Block]]:
    """(number of blocks, block) for each block of the queries, a few fetched by each job.

    Work is dealt by queries and by rows: a block costs a pass over the rows, a
    part of the rows costs every query a search for its first bar. Four blocks
    balance the two, so queries of over a quarter of the bound make as many.
    """
    total = queries.agg(F.sum(F.greatest(F.size("embedding"), F.lit(least)))).first()[0] or 0
    n = max(1, -(-5 * total // (4 * bound)), min(4, -(-4 * total // bound)))  # a little room, because a deal by hash is uneven
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n)))
    for at in range(0, n, FETCHED):
        some = dealt.where(F.col("block").between(at, at + FETCHED - 1)).toArrow().combine_chunks()
        for k in range(at, min(at + FETCHED, n)):
            one = some.filter(pc.equal(some["block"], k)).combine_chunks()
            items, vs = (one[c].chunk(0) if one[c].num_chunks else pa.array([], one[c].type) for c in ("item_id", "embedding"))
            yield n, Block(items, vs)


def dense_search(vectors: DataFrame, queries: DataFrame, top_k: int = 10, bound: int = VECTOR_NUMBERS) -> DataFrame:
    """Exact cosine search: (item_id, vec_id, score, rank) by (-score, vec_id), scores rounded to 6 places.

    A stated set of queries is held against all vectors: blocks of queries of
    bounded size go to the tasks, the vectors are dealt evenly once, and a task
    keeps the top_k of each query that it has seen. See ``vectors.py``.
    """
    check_top_k(top_k)
    context = vectors.sparkSession.sparkContext
    n, sent = 1, []
    for n, block in vector_blocks(queries.select("item_id", "embedding"), bound, top_k):  # noqa: B007
        sent.append(context.broadcast(block))
    rows = vectors.select("vec_id", "embedding").repartition(max(2, -(-4 * context.defaultParallelism // n)))
    kind = T.StructType([T.StructField("item_id", queries.schema["item_id"].dataType), T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("score", T.DoubleType())])
    found = [rows.mapInArrow(searcher(x, top_k), kind) for x in sent]
    out = reduce(DataFrame.unionByName, found).withColumn("score", F.round("score", 6))
    return ranked(out, ["item_id"], [F.desc("score"), F.col("vec_id")], top_k)


def maxsim_search(documents: DataFrame, queries: DataFrame, top_k: int = 5) -> DataFrame:
    """Late interaction over (doc_id, vectors) and (item_id, vectors): by (-score, doc_id), scores rounded to 6 places."""
    check_top_k(top_k)
    d = documents.select(F.col("doc_id"), F.col("vectors").alias("dv"))
    q = queries.select("item_id", F.col("vectors").alias("qv"))
    score = F.round(N.max_sim(F.col("qv"), F.col("dv")), 6).alias("score")
    return against_all(d, q, "qv", lambda x: ranked(x.select("item_id", "doc_id", score), ["item_id"], [F.desc("score"), F.col("doc_id")], top_k))


def rerank(pool: DataFrame, score: Column, top_k: int = 5) -> DataFrame:
    """The pool in the order of another scorer; scores that are not finite are an error. Branch columns stay."""
    check_top_k(top_k)
    fine = ~F.isnan(score) & (F.abs(score) < float("inf"))
    checked = F.when(fine, score).otherwise(F.raise_error(F.lit("a score is not finite")).cast("double"))
    return ranked(pool.withColumn("reranker_score", checked), ["item_id"], [F.desc("reranker_score"), *PAGE], top_k)


# --- fusion ---


def candidate_union(bm25: DataFrame, dense: DataFrame) -> DataFrame:
    """Full outer join of two ranked lists with where each row came from; pool_index follows the key, not relevance."""
    a = bm25.select("item_id", *PAGE, F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    b = dense.select("item_id", *PAGE, F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    w = Window.partitionBy("item_id").orderBy(*PAGE)
    return (
        a.join(b, ["item_id", *PAGE], "full_outer")
        .withColumn("from_bm25", F.col("bm25_rank").isNotNull()).withColumn("from_dense", F.col("dense_rank").isNotNull())
        .withColumn("pool_index", F.row_number().over(w) - 1)
    )


def fuse_rrf(text: DataFrame, vision: DataFrame, top_k: int = 5, k: float = 60.0, text_weight: float = 1.0, vision_weight: float = 1.0) -> DataFrame:
    """Weighted reciprocal rank fusion of two lists; ties go by text rank, vision rank, then key, missing ranks last."""
    check_top_k(top_k)
    a = text.select("item_id", *PAGE, F.col("rank").alias("text_rank"))
    b = vision.select("item_id", *PAGE, F.col("rank").alias("vision_rank"))
    both = (
        a.join(b, ["item_id", *PAGE], "full_outer")
        .withColumn("text_contribution", N.rrf(F.col("text_rank"), k, text_weight))
        .withColumn("vision_contribution", N.rrf(F.col("vision_rank"), k, vision_weight))
        .withColumn("rrf_score", F.col("text_contribution") + F.col("vision_contribution"))
    )
    order = [F.desc("rrf_score"), F.asc_nulls_last("text_rank"), F.asc_nulls_last("vision_rank"), *[F.col(c) for c in PAGE]]
    return ranked(both, ["item_id"], order, top_k)


def fuse_nway(lists: Sequence[DataFrame], k: float = 60.0) -> DataFrame:
    """Unweighted fusion of any number of lists of (item_id, id, rank); ties go by id alone. Terms are added in list order."""
    rows = None
    for i, x in enumerate(lists):
        one = x.select("item_id", "id", F.lit(i).alias("i"), N.rrf(F.col("rank"), k).alias("term"))
        rows = one if rows is None else rows.unionByName(one)
    ordered = F.array_sort(F.collect_list(F.struct("i", "term")))
    fused = rows.groupBy("item_id", "id").agg(N.fold_sum(F.transform(ordered, lambda x: x["term"])).alias("rrf_score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("rrf_score"), "id")))


def compose_quota(documents: DataFrame, samples: DataFrame, document_quota: int = 3, sample_quota: int = 2) -> DataFrame:
    """A prefix of each domain's list, documents first; short lists are not filled up from the other."""
    if document_quota < 1 or sample_quota < 1:
        raise ValueError("both quotas must be at least 1")
    a = documents.where(F.col("rank") <= document_quota).select("item_id", F.lit(0).alias("block"), F.lit("document").alias("domain"), "rank", "evidence_id")
    b = samples.where(F.col("rank") <= sample_quota).select("item_id", F.lit(1).alias("block"), F.lit("robot").alias("domain"), "rank", "evidence_id")
    w = Window.partitionBy("item_id").orderBy("block", "rank")
    return a.unionByName(b).withColumn("position", F.row_number().over(w)).drop("block")


# --- metrics ---


def first_gold_rank(ranking: DataFrame, gold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(item_id, gold_rank): the least rank of a gold row for each item that has gold; null if none is in the list."""
    marked = ranking.join(gold.select("item_id", *keys).distinct(), ["item_id", *keys], "left_semi")
    best = marked.groupBy("item_id").agg(F.min("rank").alias("gold_rank"))
    return gold.select("item_id").distinct().join(best, "item_id", "left")


def rank_metrics(first: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """One row: n_cases, the share of cases with a gold row in the first k, and the mean reciprocal rank."""
    hits = [F.avg(F.coalesce((F.col("gold_rank") <= k).cast("double"), F.lit(0.0))).alias(f"recall_at_{k}") for k in ks]
    mrr = F.avg(F.coalesce(1.0 / F.col("gold_rank"), F.lit(0.0))).alias("mrr")
    return first.agg(F.count(F.lit(1)).alias("n_cases"), *hits, mrr)


def ndcg(ranking: DataFrame, gold: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """(item_id, ndcg) with binary gains; the ideal list has min(gold, k) hits, and 0 stands for no ideal."""
    distinct = gold.select("item_id", *keys).distinct()
    found = ranking.where(F.col("rank") <= k).join(distinct, ["item_id", *keys], "left_semi")
    ranks = found.groupBy("item_id").agg(F.array_sort(F.collect_set("rank")).alias("ranks"))
    n = distinct.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_gold"))
    gain = lambda r: F.lit(1.0) / F.log2(r + F.lit(1.0))
    dcg = N.fold_sum(F.transform(F.coalesce("ranks", F.array().cast("array<int>")), gain))
    ideal = N.fold_sum(F.transform(F.sequence(F.lit(1), F.least(F.col("n_gold").cast("int"), F.lit(k))), gain))
    return n.join(ranks, "item_id", "left").select("item_id", F.round(F.when(ideal > 0, dcg / ideal).otherwise(0.0), 9).alias("ndcg"))


def union_coverage(pool: DataFrame, gold: DataFrame) -> DataFrame:
    """One row over the cases with gold: candidate recall, mean pool and overlap sizes, and the gain over the first list alone."""
    hit = gold.select("item_id", *PAGE, F.lit(1).alias("is_gold")).distinct()
    rows = pool.join(hit, ["item_id", *PAGE], "left")
    per = rows.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("pool"), F.sum((F.col("from_bm25") & F.col("from_dense")).cast("int")).alias("overlap"),
        F.max(F.coalesce("is_gold", F.lit(0))).alias("any"), F.max(F.when(F.col("from_bm25"), F.coalesce("is_gold", F.lit(0))).otherwise(0)).alias("first"),
    )
    cases = gold.select("item_id").distinct().join(per, "item_id", "left").na.fill(0)
    return cases.agg(
        F.count(F.lit(1)).alias("n_cases"), F.avg("any").alias("candidate_recall"), F.avg("pool").alias("avg_pool_size"),
        F.avg("overlap").alias("avg_overlap"), (F.avg("any") - F.avg("first")).alias("coverage_gain"),
    )
