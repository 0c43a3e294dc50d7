"""Evidence: nested items and bundles, locator keys, citation aliases and policies, findings, answer metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import required_fact_coverage

#: The locator's fields and stages in order.
REF = "struct<source_id:string,source_type:string,page_number:bigint,time_start_sec:double,time_end_sec:double,frame_index:bigint,camera:string,bbox:struct<x1:double,y1:double,x2:double,y2:double>>"
STAGES = ("retrieval", "evidence", "generation")


def ref(source_id: Column, source_type: str, page: Column | None = None, frame: Column | None = None, camera: str | None = None, time: Column | None = None) -> Column:
    """A locator; fields that are not given are null."""
    none = F.lit(None)
    t = time if time is not None else none
    return F.struct(
        source_id.cast("string").alias("source_id"), F.lit(source_type).alias("source_type"), (page if page is not None else none).alias("page_number"), t.alias("time_start_sec"),
        t.alias("time_end_sec"), (frame if frame is not None else none).alias("frame_index"), F.lit(camera).alias("camera"), none.alias("bbox"),
    ).cast(REF)


def ref_key(r: Column) -> Column:
    """The locator's identity as text: equal for equal fields, nulls included."""
    return F.to_json(r, {"ignoreNullFields": "false"})


def page_items(pages: DataFrame) -> DataFrame:
    """(source_id, page_number, item): one evidence item a page."""
    payload = F.struct("page_number", "text_sha256", "char_count", F.substring("text", 1, 240).alias("text_excerpt"))
    item = F.struct(
        F.concat_ws(":", F.lit("doc"), "source_id", F.concat(F.lit("p"), F.col("page_number"))).alias("evidence_id"), F.lit("document_page").alias("kind"),
        F.array(ref(F.col("source_id"), "pdf", page=F.col("page_number"))).alias("refs"), payload.alias("document"), F.lit(None).cast("struct<episode_id:string,frame_index:bigint,timestamp_sec:double>").alias("robot"),
    )
    return pages.select("source_id", "page_number", item.alias("item"))


def sample_items(samples: DataFrame) -> DataFrame:
    """(episode_id, frame_index, item): one evidence item a sample, with a locator for each camera."""
    refs = F.array(*[ref(F.col("episode_id"), "robot_sequence", frame=F.col("frame_index"), camera=c, time=F.col("timestamp_sec")) for c in ("front", "wrist")])
    item = F.struct(
        F.concat_ws(":", F.lit("robot"), F.col("episode_id").cast("string"), F.concat(F.lit("f"), F.col("frame_index"))).alias("evidence_id"), F.lit("robot_sample").alias("kind"), refs.alias("refs"),
        F.lit(None).cast("struct<page_number:bigint,text_sha256:string,char_count:bigint,text_excerpt:string>").alias("document"),
        F.struct(F.col("episode_id").cast("string").alias("episode_id"), F.col("frame_index").cast("bigint").alias("frame_index"), "timestamp_sec").alias("robot"),
    )
    return samples.select("episode_id", "frame_index", item.alias("item"))


def alias_of(r: Column) -> Column:
    """The short citation id of a locator."""
    return F.when(r["page_number"].isNotNull(), F.concat(F.lit("DOC_P"), r["page_number"])).otherwise(F.concat(F.lit("ROBOT_F"), r["frame_index"], F.lit("_"), F.upper(r["camera"])))


def alias_map(items: Column) -> Column:
    """Citation id to locator over all items; a repeated id is an error."""
    refs = F.flatten(F.transform(items, lambda i: i["refs"]))
    return F.map_from_entries(F.transform(refs, lambda r: F.struct(alias_of(r), r)))


def citation_errors(citations: Column, allowed: Column, abstain: Column) -> Column:
    """Error codes in order: duplicates, citations outside the evidence, abstaining with and answering without citations."""
    outside = F.array_except(citations, allowed)
    return F.array_compact(
        F.array(
            F.when(F.size(F.array_distinct(citations)) < F.size(citations), "duplicate_citations"),
            F.when(F.size(outside) > 0, F.concat(F.lit("citation_outside_supplied_evidence="), F.array_join(F.array_sort(outside), ","))),
            F.when(abstain & (F.size(citations) > 0), "abstain_requires_no_citation"),
            F.when(~abstain & (F.size(citations) == 0), "answerable_response_requires_citation"),
        )
    )


def missing_required(citations: Column, required: Column) -> Column:
    return F.array_sort(F.array_except(required, citations))


def resolve_citations(ids: Column, aliases: Column, abstain: Column) -> Column:
    """Locators of citation ids; repeated or unknown ids, and abstaining with or answering without ids, are errors."""
    unknown = F.array_except(ids, F.map_keys(aliases))
    bad = (
        F.when(F.size(F.array_distinct(ids)) < F.size(ids), "a citation id repeats").when(F.size(unknown) > 0, "an unknown citation id")
        .when(abstain & (F.size(ids) > 0), "abstained with citations").when(~abstain & (F.size(ids) == 0), "answered without citations")
    )
    return F.when(bad.isNotNull(), F.raise_error(bad).cast(f"array<{REF}>")).otherwise(F.transform(ids, lambda i: F.element_at(aliases, i)))


#: How an answer may name a frame.
FRAME_FORMS = ("frame %s", "frame_index %s", "frame_index=%s", "frame_index 是 %s", "frame_index是%s", "frame_index 为 %s", "frame_index为%s", "帧%s", "帧 %s")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _time_forms(times: pd.Series) -> pd.Series:
    """A time at three precisions, rounded from its exact binary value; Java's formatter rounds from the shortest decimal and differs at halves."""
    return times.map(lambda t: [f"{t:.{n}f}" for n in (7, 4, 3)])


def frame_fact_groups(frame: Column, time: Column) -> Column:
    """Surface forms of a frame number, and of a time at three precisions."""
    n = frame.cast("string")
    return F.array(F.array(*[F.format_string(f, n) for f in FRAME_FORMS]), _time_forms(time))


# --- diagnosis ---


def retrieval_codes(ranked: Column, gold: Column, top_k: int) -> Column:
    return F.array_compact(F.array(F.when(~F.arrays_overlap(F.slice(ranked, 1, top_k), gold), "retrieval_miss")))


def bundle_codes(kinds: Column, refs: Column, required: Column, cross_domain: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(cross_domain & ~F.array_contains(kinds, "document_page"), "evidence_missing_document"),
            F.when(cross_domain & ~F.array_contains(kinds, "robot_sample"), "evidence_missing_robot"),
            F.when(F.size(F.array_except(required, refs)) > 0, "evidence_missing_required_ref"),
        )
    )


def generation_codes(answer: Column, citations: Column, allowed: Column, abstain: Column, required: Column, facts: Column, answerable: Column) -> Column:
    """First finding of each code in the order in which the checks run; answerable may be null for unknown."""
    found = F.array_compact(
        F.array(
            F.when(F.size(F.array_distinct(citations)) < F.size(citations), "generation_duplicate_citation"),
            F.when(F.size(F.array_except(citations, allowed)) > 0, "generation_hallucinated_citation"),
            F.when(~abstain & (F.size(citations) == 0), "generation_citation_gap"),
            F.when(F.size(F.array_except(required, citations)) > 0, "generation_citation_gap"),
            F.when((F.size(facts) > 0) & (required_fact_coverage(answer, facts) < 1), "generation_incomplete"),
            F.when(answerable & abstain, "generation_false_abstention"),
            F.when(~answerable & ~abstain, "generation_overanswer"),
        )
    )
    return F.array_distinct(found)


def report(codes: Column) -> Column:
    """Codes of all stages in the order of stage, then code."""
    def stage(c: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for k, s in enumerate(STAGES) for x in (s, k)]), F.split(c, "_")[0])

    return F.transform(F.array_sort(F.transform(codes, lambda c: F.struct(stage(c).alias("s"), c.alias("c")))), lambda x: x["c"])


def answer_metrics(cases: DataFrame) -> DataFrame:
    """One row from (parsed, abstain, answerable, policy_valid, gold_hit, fact_coverage): rates with their own denominators.

    A case whose answer does not parse fails but stays in n.
    """
    ok = F.coalesce(F.col("parsed"), F.lit(False))
    right = ok & (F.col("abstain") == ~F.col("answerable"))
    passed = right & F.col("policy_valid") & (~F.col("answerable") | (F.col("gold_hit") & (F.col("fact_coverage") >= 1)))

    def rate(c: Column, over: Column | None = None) -> Column:
        v = F.coalesce(c, F.lit(False)).cast("double")
        return F.avg(v if over is None else F.when(over, v))

    return cases.agg(
        F.count(F.lit(1)).alias("n"), rate(ok).alias("structured_rate"), rate(right).alias("answerability_rate"), rate(ok & F.col("policy_valid")).alias("citation_policy_rate"),
        rate(ok & F.col("gold_hit"), F.col("answerable")).alias("gold_hit_rate"), F.round(F.avg(F.when(F.col("answerable"), F.when(ok, F.col("fact_coverage")).otherwise(0.0))), 9).alias("fact_coverage"),
        rate(ok & F.col("abstain"), ~F.col("answerable")).alias("abstention_rate"), rate(passed).alias("pass_rate"),
    )
