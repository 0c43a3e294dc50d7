"""The canonical retrieval path: a document mode, robot evidence, fixed quotas, and a trace of where each item came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import inference
from ..operators import ranking as R
from ..operators import timeseries as TS

MODES = ("bm25", "hybrid")


def check_mode(mode: str) -> str:
    """The document mode in lower case without white space around it; others than ``MODES`` are an error."""
    found = mode.strip().lower() if isinstance(mode, str) else ""
    if found not in MODES:
        raise ValueError(f"document mode must be one of {', '.join(MODES)}")
    return found


def documents_of(mode: str, pages: DataFrame, queries: DataFrame, lists: tuple[DataFrame, DataFrame] | None = None, score=inference.lexical_score, top_k: int = 3) -> DataFrame:
    """(item_id, source_id, page_number, rank): BM25 alone, or the union of both branches (``lists``) in the order of a reranker."""
    if check_mode(mode) == "bm25":
        return R.bm25_search(pages, queries, top_k).select("item_id", *R.PAGE, "rank")
    if lists is None:
        raise ValueError("the hybrid mode needs the ranked lists of both branches")
    pool = R.candidate_union(*lists).join(queries.select("item_id", F.col("text").alias("q")), "item_id").join(pages.select(*R.PAGE, "text"), R.PAGE)
    return R.rerank(pool, score(F.col("q"), F.col("text")), top_k).select("item_id", *R.PAGE, "rank")


def samples_of(samples: DataFrame, cases: DataFrame, top_k: int = 5) -> DataFrame:
    """(item_id, rank, evidence_id): the frames that change most of each case's episode; cases are (item_id, episode_id)."""
    scores = TS.change_scores(samples).join(cases, "episode_id")
    best = R.ranked(scores, ["item_id"], [F.desc("fused_state_action_score"), F.col("episode_id"), F.col("frame_index")], top_k)
    return best.select("item_id", "rank", F.concat(F.lit("robot:"), F.col("episode_id").cast("string"), F.lit(":f"), F.col("frame_index").cast("string")).alias("evidence_id"))


def canonical_retrieval(
    mode: str, pages: DataFrame, queries: DataFrame, samples: DataFrame, cases: DataFrame, lists: tuple[DataFrame, DataFrame] | None = None, document_quota: int = 3, sample_quota: int = 2
) -> DataFrame:
    """(item_id, mode, domain, rank, evidence_id, position): the composed evidence of each query, documents first."""
    docs = documents_of(mode, pages, queries, lists, top_k=document_quota)
    named = docs.select("item_id", "rank", F.concat_ws(":", F.lit("doc"), "source_id", F.concat(F.lit("p"), F.col("page_number"))).alias("evidence_id"))
    out = R.compose_quota(named, samples_of(samples, cases), document_quota, sample_quota)
    return out.withColumn("mode", F.lit(check_mode(mode)))
