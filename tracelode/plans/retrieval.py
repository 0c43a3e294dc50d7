"""Retrieval queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import inference
from ..functions import text as X
from ..operators import ranking as R
from ..operators import timeseries as TS
from . import views as V

K = ["source_id", "page_number"]


def bm25_topk(s, d):
    return R.bm25_search(V.pages(s, d), V.queries(s, d))


def bm25_with_zeros(s, d):
    return R.bm25_search(V.pages(s, d), V.queries(s, d), 20, with_zeros=True)


def bm25_term_contributions(s, d):
    best = bm25_topk(s, d).where("rank = 1").select("item_id", *K)
    rows = R.bm25_contributions(V.pages(s, d), V.queries(s, d), best)
    return rows.select("item_id", *K, "term", "query_frequency", "df", "tf", F.round("idf", 6).alias("idf"), F.round("contribution", 6).alias("contribution"), "position")


def bm25_corpus_stats(s, d):
    return R.corpus_stats(V.pages(s, d)).select("n_docs", F.round("avg_len", 6).alias("avg_len"))


def tokenize_pages(s, d):
    t = X.tokenize_mixed(F.col("text"))
    return V.pages(s, d).select(*K, F.size(t).cast("long").alias("n_tokens"), F.sha2(F.array_join(t, " "), 256).alias("tokens_sha256"))


def page_corpus_hash(s, d):
    c = X.page_columns(F.col("text"))
    return V.pages(s, d).select(*K, c["text_sha256"].alias("text_sha256"), c["char_count"].alias("char_count"))


def corpus_summary(s, d):
    return V.pages(s, d).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.length("text") > 0).alias("n_nonempty"), F.sum(F.length("text")).alias("n_chars"))


def substring_snippets(s, d):
    return V.pages(s, d).select(*K, X.snippet(F.col("text"), "License", 20).alias("snippet")).where("snippet is not null")


def _vectors(s, d):
    return V.table(s, d, "embeddings").select("vec_id", "embedding", "label")


def dense_topk(s, d):
    v = _vectors(s, d)
    return R.dense_search(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("item_id"), "embedding"), 10)


def dense_first_relevant_rank(s, d):
    """Labels are joined to the ranked rows, never rows of a label to each other; an item whose label no other vector has has no gold."""
    v = _vectors(s, d)
    labels = v.select("vec_id", "label")
    wanted = labels.select(F.col("vec_id").alias("item_id"), F.col("label").alias("want"))
    hits = dense_topk(s, d).where("item_id <> vec_id").join(wanted, "item_id").join(labels, "vec_id").where("want = label")
    first = hits.groupBy("item_id").agg(F.min("rank").alias("gold_rank"))
    shared = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cases = wanted.where("item_id % 20 = 0").join(shared, F.col("want") == F.col("label"), "left_semi").select("item_id")
    return cases.join(first, "item_id", "left")


def maxsim_topk(s, d):
    g = _vectors(s, d).groupBy(F.expr("vec_id div 5").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("xs")).select("doc_id", F.col("xs.embedding").alias("vectors"))
    return R.maxsim_search(g, g.where("doc_id % 20 = 0").select(F.col("doc_id").alias("item_id"), "vectors"), 5)


def _union(s, d):
    return R.candidate_union(bm25_topk(s, d), V.lexical_hits(s, d))


def candidate_union(s, d):
    return _union(s, d).select("item_id", *K, "bm25_rank", "dense_rank", "from_bm25", "from_dense", "pool_index")


def rrf_weighted(s, d):
    return R.fuse_rrf(bm25_topk(s, d), V.lexical_hits(s, d), 5).select("item_id", *K, "text_rank", "vision_rank", F.round("rrf_score", 9).alias("rrf_score"), "rank")


def rrf_nway(s, d):
    def ids(x):
        return x.select("item_id", F.concat_ws(":", "source_id", F.col("page_number").cast("string")).alias("id"), "rank")

    out = R.fuse_nway([ids(bm25_topk(s, d)), ids(V.lexical_hits(s, d))])
    return out.select("item_id", "id", F.round("rrf_score", 9).alias("rrf_score"), "rank")


def rerank_lexical(s, d):
    pool = _union(s, d).join(V.queries(s, d).select("item_id", F.col("text").alias("q")), "item_id").join(V.pages(s, d).select(*K, "text"), K)
    return R.rerank(pool, inference.lexical_score(F.col("q"), F.col("text")), 3).select("item_id", *K, F.round("reranker_score", 9).alias("reranker_score"), "rank")


def retrieval_metrics(s, d):
    m = R.rank_metrics(R.first_gold_rank(bm25_topk(s, d), V.gold(s, d), K))
    return m.select("n_cases", *[F.round(c, 9).alias(c) for c in ("recall_at_1", "recall_at_3", "recall_at_5", "mrr")])


def metric_deltas(s, d):
    g = V.gold(s, d)
    a, b = (R.rank_metrics(R.first_gold_rank(x, g, K)) for x in (V.lexical_hits(s, d), bm25_topk(s, d)))
    names = ("recall_at_1", "recall_at_3", "recall_at_5", "mrr")
    return a.select(*[F.col(c).alias(f"a_{c}") for c in names]).crossJoin(F.broadcast(b)).select(*[F.round(F.col(f"a_{c}") - F.col(c), 9).alias(c) for c in names])


def ndcg_at_k(s, d):
    return R.ndcg(bm25_topk(s, d), V.gold(s, d), K)


def union_coverage(s, d):
    out = R.union_coverage(_union(s, d), V.gold(s, d))
    return out.select("n_cases", *[F.round(c, 9).alias(c) for c in ("candidate_recall", "avg_pool_size", "avg_overlap", "coverage_gain")])


def tie_summary(s, d):
    return R.tie_summary(V.pages(s, d), V.queries(s, d)).select("item_id", F.round("top_score", 9).alias("top_score"), "n_exact", "n_near")


def quota_bundle(s, d):
    docs = bm25_topk(s, d).select("item_id", "rank", F.concat_ws(":", F.lit("doc"), "source_id", F.col("page_number").cast("string")).alias("evidence_id"))
    scores = TS.change_scores(V.samples(s, d)).withColumn("item_id", F.col("episode_id") - 1).join(V.queries(s, d).select("item_id"), "item_id", "left_semi")
    robot = R.ranked(scores, ["item_id"], [F.desc("fused_state_action_score"), F.col("frame_index")], 5)
    return R.compose_quota(docs, robot.select("item_id", "rank", F.concat_ws(":", F.lit("robot"), F.col("event_id").cast("string")).alias("evidence_id")))


W, TOP = f"WITH {V.BM25}", "SELECT item_id, source_id, page_number, score, rank FROM bm"
BOTH = f"{W}, {V.LEX}, {V.GOLD}"
UNI = """un AS (SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.source_id, b.source_id) AS source_id, coalesce(a.page_number, b.page_number) AS page_number,
  a.rank AS bm25_rank, b.rank AS dense_rank, a.rank IS NOT NULL AS from_bm25, b.rank IS NOT NULL AS from_dense
  FROM bm a FULL JOIN ln_ b ON a.item_id = b.item_id AND a.source_id = b.source_id AND a.page_number = b.page_number)"""
VEC = """un_ AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_reduce(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE), lambda a, b: a + b))) AS v FROM embeddings),
dn AS (SELECT item_id, vec_id, score, rank FROM (SELECT q.vec_id AS item_id, e.vec_id, round(list_reduce(list_transform(range(1, 65), lambda i: q.v[i] * e.v[i]), lambda a, b: a + b), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_reduce(list_transform(range(1, 65), lambda i: q.v[i] * e.v[i]), lambda a, b: a + b), 6) DESC, e.vec_id) AS rank
  FROM un_ q, un_ e WHERE q.vec_id % 20 = 0) WHERE rank <= 10)"""


def _metrics(ranks: str, digits: bool = True) -> str:
    one = "round({}, 9)" if digits else "{}"
    return ", ".join(f"{one.format(e)} AS {n}" for e, n in [*[(f"avg(coalesce(({ranks} <= {k})::INT, 0))", f"recall_at_{k}") for k in (1, 3, 5)], (f"avg(coalesce(1.0::DOUBLE / {ranks}, 0))", "mrr")])


def _first(ranking: str, name: str) -> str:
    return f"""{name} AS (SELECT g.item_id, min(r.rank) AS gold_rank FROM (SELECT DISTINCT * FROM gold) g LEFT JOIN {ranking} r
  ON g.item_id = r.item_id AND g.source_id = r.source_id AND g.page_number = r.page_number GROUP BY g.item_id)"""


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_with_zeros, bm25_term_contributions, bm25_corpus_stats, tokenize_pages, page_corpus_hash, corpus_summary, substring_snippets, dense_topk, dense_first_relevant_rank, maxsim_topk, candidate_union, rrf_weighted, rrf_nway, rerank_lexical, retrieval_metrics, metric_deltas, ndcg_at_k, union_coverage, tie_summary, quota_bundle)}
ORACLE_SQL = {
    "bm25_topk": f"{W} {TOP}",
    "bm25_with_zeros": f"""{W},
z AS (SELECT b.item_id, t.source_id, t.page_number, coalesce(score, 0) AS score FROM benchmark b CROSS JOIN tok t LEFT JOIN sco USING (item_id, source_id, page_number))
SELECT item_id, source_id, page_number, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source_id, page_number) AS rank FROM z) WHERE rank <= 20""",
    "bm25_term_contributions": f"""{W}, qf AS (SELECT item_id, term, count(*) AS query_frequency FROM q GROUP BY item_id, term)
SELECT qf.item_id, wt.source_id, wt.page_number, wt.term, query_frequency, df, tf, round(idf, 6) AS idf, round(weight * query_frequency, 6) AS contribution,
  row_number() OVER (PARTITION BY qf.item_id, wt.source_id, wt.page_number ORDER BY weight * query_frequency DESC, wt.term) AS position
FROM qf JOIN wt ON qf.term = wt.term JOIN bm ON bm.item_id = qf.item_id AND bm.source_id = wt.source_id AND bm.page_number = wt.page_number AND bm.rank = 1""",
    "bm25_corpus_stats": f"WITH {V.PAGES} SELECT count(*) AS n_docs, round(avg(len({V.TOKEN})), 6) AS avg_len FROM pg",
    "tokenize_pages": f"WITH {V.PAGES} SELECT source_id, page_number, len({V.TOKEN}) AS n_tokens, sha256(array_to_string({V.TOKEN}, ' ')) AS tokens_sha256 FROM pg",
    "page_corpus_hash": rf"WITH {V.PAGES}, c AS (SELECT *, trim(regexp_replace(text, '[\x09-\x0D\x1C-\x20]+', ' ', 'g')) AS t FROM pg) SELECT source_id, page_number, sha256(t) AS text_sha256, length(t) AS char_count FROM c",
    "corpus_summary": "SELECT source AS source_id, count(*) AS n_pages, count(*) FILTER (length(text) > 0) AS n_nonempty, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY source",
    "substring_snippets": f"""WITH {V.PAGES}, f AS (SELECT *, instr(lower(text), 'license') AS hit FROM pg)
SELECT source_id, page_number, substring(text, greatest(hit - 20, 1), hit - greatest(hit - 20, 1) + 27) AS snippet FROM f WHERE hit > 0""",
    "dense_topk": f"WITH {VEC} SELECT * FROM dn",
    "dense_first_relevant_rank": f"""WITH {VEC} SELECT q.vec_id AS item_id, min(dn.rank) AS gold_rank FROM un_ q JOIN un_ e ON q.label = e.label AND q.vec_id <> e.vec_id
LEFT JOIN dn ON dn.item_id = q.vec_id AND dn.vec_id = e.vec_id WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id""",
    "maxsim_topk": """WITH v AS (SELECT vec_id, vec_id // 5 AS doc_id, embedding AS e FROM embeddings),
p AS (SELECT q.doc_id AS item_id, q.vec_id AS qv, d.doc_id, max(list_reduce(list_transform(range(1, 65), lambda i: q.e[i]::DOUBLE * d.e[i]::DOUBLE), lambda a, b: a + b)) AS m
  FROM v q, v d WHERE q.doc_id % 20 = 0 GROUP BY ALL),
t AS (SELECT item_id, doc_id, round(list_reduce(list(m ORDER BY qv), lambda a, b: a + b), 6) AS score FROM p GROUP BY item_id, doc_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM t) WHERE rank <= 5""",
    "candidate_union": f"{BOTH}, {UNI} SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY source_id, page_number) - 1 AS pool_index FROM un",
    "rrf_weighted": f"""{BOTH}, {UNI}, f AS (SELECT *, coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) + coalesce(1.0::DOUBLE / (60 + dense_rank), 0) AS sc FROM un)
SELECT item_id, source_id, page_number, bm25_rank AS text_rank, dense_rank AS vision_rank, round(sc, 9) AS rrf_score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sc DESC, bm25_rank NULLS LAST, dense_rank NULLS LAST, source_id, page_number) AS rank FROM f) WHERE rank <= 5""",
    "rrf_nway": f"""{BOTH}, {UNI}, f AS (SELECT item_id, source_id || ':' || page_number AS id, coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) + coalesce(1.0::DOUBLE / (60 + dense_rank), 0) AS sc FROM un)
SELECT item_id, id, round(sc, 9) AS rrf_score, row_number() OVER (PARTITION BY item_id ORDER BY sc DESC, id) AS rank FROM f""",
    "rerank_lexical": f"""{BOTH}, {UNI}, r AS (SELECT un.*, lex.score AS s FROM un JOIN lex USING (item_id, source_id, page_number))
SELECT item_id, source_id, page_number, round(s, 9) AS reranker_score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, source_id, page_number) AS rank FROM r) WHERE rank <= 3""",
    "retrieval_metrics": f"{BOTH}, {_first('bm', 'f')} SELECT count(*) AS n_cases, {_metrics('gold_rank')} FROM f",
    "metric_deltas": f"""{BOTH}, {_first('bm', 'f')}, {_first('ln_', 'h')}, a AS (SELECT {_metrics('gold_rank', False)} FROM h), b AS (SELECT {_metrics('gold_rank', False)} FROM f)
SELECT {", ".join(f"round(a.{c} - b.{c}, 9) AS {c}" for c in ("recall_at_1", "recall_at_3", "recall_at_5", "mrr"))} FROM a, b""",
    "ndcg_at_k": f"""{BOTH}, g AS (SELECT item_id, count(*) AS ng FROM (SELECT DISTINCT * FROM gold) GROUP BY item_id),
h AS (SELECT g.item_id, list(bm.rank ORDER BY bm.rank) AS ranks FROM (SELECT DISTINCT * FROM gold) g JOIN bm USING (item_id, source_id, page_number) GROUP BY g.item_id)
SELECT g.item_id, round(coalesce(list_sum(list_transform(ranks, lambda r: 1.0::DOUBLE / log2(r + 1))), 0) / list_sum(list_transform(range(1, least(ng, 5) + 1), lambda r: 1.0::DOUBLE / log2(r + 1))), 9) AS ndcg
FROM g LEFT JOIN h ON g.item_id = h.item_id""",
    "union_coverage": f"""{BOTH}, {UNI}, m AS (SELECT un.*, g.item_id IS NOT NULL AS is_gold FROM un LEFT JOIN (SELECT DISTINCT * FROM gold) g USING (item_id, source_id, page_number)),
p AS (SELECT item_id, count(*) AS pool, sum((from_bm25 AND from_dense)::INT) AS overlap, max(is_gold::INT) AS any_, max((is_gold AND from_bm25)::INT) AS first_ FROM m GROUP BY item_id),
c AS (SELECT g.item_id, coalesce(pool, 0) AS pool, coalesce(overlap, 0) AS overlap, coalesce(any_, 0) AS any_, coalesce(first_, 0) AS first_ FROM (SELECT DISTINCT item_id FROM gold) g LEFT JOIN p USING (item_id))
SELECT count(*) AS n_cases, round(avg(any_), 9) AS candidate_recall, round(avg(pool), 9) AS avg_pool_size, round(avg(overlap), 9) AS avg_overlap, round(avg(any_) - avg(first_), 9) AS coverage_gain FROM c""",
    "tie_summary": f"""{BOTH}, t AS (SELECT *, max(score) OVER (PARTITION BY item_id) AS top FROM lex)
SELECT item_id, round(max(top), 9) AS top_score, sum((score = top)::INT)::BIGINT AS n_exact, sum((top - score <= 1e-12)::INT)::BIGINT AS n_near FROM t GROUP BY item_id""",
    "quota_bundle": f"""{W}, {V.SAMPLES}, r AS (SELECT episode_id - 1 AS item_id, row_number() OVER (PARTITION BY episode_id ORDER BY fused DESC, frame_index) AS rank, 'robot:' || event_id AS evidence_id FROM sc
  WHERE episode_id - 1 IN (SELECT item_id FROM benchmark)),
u AS (SELECT item_id, 0 AS b, 'document' AS domain, rank, 'doc:' || source_id || ':' || page_number AS evidence_id FROM bm WHERE rank <= 3 UNION ALL SELECT item_id, 1, 'robot', rank, evidence_id FROM r WHERE rank <= 2)
SELECT item_id, domain, rank, evidence_id, row_number() OVER (PARTITION BY item_id ORDER BY b, rank) AS position FROM u""",
}
