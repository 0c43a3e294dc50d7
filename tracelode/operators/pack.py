"""Cross-domain cases: seeds from best proposals, their frames as evidence, bundles, and what a generation step needs of them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import REF

#: The states that a case record declares.
ORIGIN = "day20_gt_matched_best_proposal_for_post_eval_diagnostics"
SUPPORT = "retrieved_candidates_unlabeled_for_causal_support"
DECISION = "abstain_physical_root_cause"
PROPOSAL = ("start_frame", "center_frame", "end_frame")


def proposal_key(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").cast("long").alias(c) for c in PROPOSAL])


def representative_frames(start: Column, center: Column, end: Column) -> Column:
    """The distinct frames of a proposal in the order start, centre, end."""
    return F.array_distinct(F.array(start, center, end))


def case_seeds(results: DataFrame, proposals: DataFrame) -> DataFrame:
    """(event_id, episode_id, start_frame, center_frame, end_frame) of each result whose best proposal is one of its episode's.

    A result whose proposal is not there, or is out of order, and a second
    result of an event are errors.
    """
    keys = ["episode_id", *PROPOSAL]
    known = proposals.select(*keys).distinct().withColumn("_known", F.lit(True))
    rows = results.select("event_id", *keys).join(known, keys, "left")
    n = rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(n, "event_id")
    bad = (
        F.when(F.col("_n") > 1, "an event has more than one result").when(F.col("_known").isNull(), "a best proposal is none of its episode's")
        .when(~F.col("center_frame").between(F.col("start_frame"), F.col("end_frame")), "a proposal's frames are out of order")
    )
    checked = F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(True)
    return rows.where(checked).select("event_id", *keys)


def universe_gaps(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, side): ids on one side alone; empty if both are the same."""
    a, b = found.select(key).distinct().withColumn("_f", F.lit(1)), expected.select(key).distinct().withColumn("_e", F.lit(1))
    both = a.join(b, key, "full_outer").where("_f is null or _e is null")
    return both.select(key, F.when(F.col("_f").isNull(), "missing").otherwise("unexpected").alias("side"))


def case_frames(seeds: DataFrame) -> DataFrame:
    """(event_id, episode_id, position, frame_index): the representative frames of each seed."""
    frames = representative_frames(*[F.col(c) for c in PROPOSAL])
    return seeds.select("event_id", "episode_id", F.posexplode(frames).alias("position", "frame_index"))


def interval_items(seeds: DataFrame, sample_items: DataFrame) -> DataFrame:
    """(event_id, episode_id, items): the evidence items of each seed's frames in order; a frame without a sample is an error."""
    rows = case_frames(seeds).join(sample_items, ["episode_id", "frame_index"], "left")
    item = F.when(F.col("item").isNull(), F.raise_error(F.lit("a frame of a case has no sample")).cast(sample_items.schema["item"].dataType)).otherwise(F.col("item"))
    listed = rows.groupBy("event_id", "episode_id").agg(F.array_sort(F.collect_list(F.struct("position", item.alias("item"))), lambda a, b: a["position"] - b["position"]).alias("xs"))
    return listed.select("event_id", "episode_id", F.transform("xs", lambda x: x["item"]).alias("items"))


def case_bundles(seeds: DataFrame, sample_items: DataFrame, document_items: DataFrame, question: str, most: int = 1000) -> DataFrame:
    """(event_id, episode_id, bundle_id, question, items, readiness): the fixed document items, then the case's own.

    ``document_items`` (position, item) are the pages retrieved for all cases;
    more than ``most`` of them are an error, because every case holds them all.
    """
    n = document_items.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} document items")
    one = document_items.agg(F.array_sort(F.collect_list(F.struct("position", "item")), lambda a, b: a["position"] - b["position"]).alias("xs"))
    fixed = one.select(F.transform("xs", lambda x: x["item"]).alias("fixed"))
    rows = interval_items(seeds, sample_items).crossJoin(F.broadcast(fixed))
    return rows.select(
        "event_id", "episode_id", F.concat(F.lit("day21_cross_domain_"), F.col("event_id").cast("string")).alias("bundle_id"), F.lit(question).alias("question"),
        F.concat("fixed", "items").alias("items"), readiness((F.size("fixed") > 0) & (F.size("items") > 0), F.size("fixed"), F.size("items")).alias("readiness"),
    )


def readiness(bundle_valid: Column, document_items: Column, robot_items: Column) -> Column:
    """Always an abstention from a physical cause, with the checks that were made."""
    return F.struct(
        F.lit(DECISION).alias("decision"), F.lit(False).alias("root_cause_answerable"),
        F.struct(
            bundle_valid.alias("cross_domain_bundle_valid"), (document_items > 0).alias("document_evidence_available"), (robot_items > 0).alias("robot_visual_state_action_evidence_available"),
            F.lit(False).alias("manual_causal_ground_truth_available"), F.lit(False).alias("causal_supervision_available"), F.lit(False).alias("end_to_end_localization_inference_claim"),
        ).alias("checks"),
    )


# --- what is in a bundle ---


def items_of(items: Column, kind: str) -> Column:
    return F.filter(items, lambda i: i["kind"] == kind)


def find_page_item(items: Column, page: Column) -> Column:
    """The first document item of a page; null if there is none."""
    return F.get(F.filter(items, lambda i: (i["kind"] == "document_page") & (i["document"]["page_number"] == page)), F.lit(0))


def robot_items(items: Column) -> Column:
    return items_of(items, "robot_sample")


def allowed_refs(items: Column) -> Column:
    """The locators of all items in order."""
    return F.flatten(F.transform(items, lambda i: i["refs"]))


def allowed_keys(items: Column) -> Column:
    """The distinct locators as text."""
    return F.array_distinct(F.transform(allowed_refs(items), lambda r: F.to_json(r, {"ignoreNullFields": "false"})))


def required_refs(items: Column, page: Column, samples: int = 2) -> Column:
    """The locators that an answer must cite: the page's, then those of exactly ``samples`` robot items with two cameras each; anything else is an error."""
    document, robots = find_page_item(items, page), robot_items(items)
    refs = F.concat(document["refs"], allowed_refs(robots))
    bad = (
        F.when(document.isNull(), "the required page was not retrieved").when(F.size(robots) != samples, "a wrong number of robot samples")
        .when(F.size(refs) != 1 + 2 * samples, "a wrong number of locators")
    )
    return F.when(bad.isNotNull(), F.raise_error(bad).cast(f"array<{REF}>")).otherwise(refs)


def count_visual_inputs(items: Column, has_image: Column) -> Column:
    """Page images and camera images together; ``has_image`` says whether the pages were rendered."""
    pages = F.when(has_image, F.size(items_of(items, "document_page"))).otherwise(0)
    return pages + F.aggregate(robot_items(items), F.lit(0), lambda a, i: a + F.size(i["refs"]))


def case_shape_rules(document_items: int, robot_count: int) -> Mapping[str, Column]:
    """What a case record must hold."""
    items = F.col("items")
    return {
        "documents": F.size(items_of(items, "document_page")) == document_items, "robots": F.size(robot_items(items)) == robot_count,
        "abstains": ~F.col("readiness.root_cause_answerable"), "decision": F.col("readiness.decision") == DECISION,
    }


# --- retrieval of robot evidence against what was expected ---


def profile_matches(joints: Column, signals: Column, explicit: Column, expected_joints: Column, expected_signals: Column) -> Column:
    """Are both lists equal, order included, and did the query name them itself?"""
    return F.coalesce((joints == expected_joints) & (signals == expected_signals) & explicit, F.lit(False))


def profile_accuracy(cases: DataFrame) -> DataFrame:
    """One row over (profile_match, bundle_valid): the number of cases and both rates."""
    return cases.agg(
        F.count(F.lit(1)).alias("n_cases"), F.avg(F.col("profile_match").cast("double")).alias("robot_profile_accuracy"), F.avg(F.col("bundle_valid").cast("double")).alias("bundle_valid_rate")
    )


def candidate_errors(rank: Column, domain: Column, kind: Column, cameras: Column, frame: Column, state_frame: Column, time: Column, state_time: Column) -> Column:
    """The errors of one robot candidate; a wrong domain or kind ends its list."""
    at = F.concat(F.lit("rank="), rank.cast("string"), F.lit(": "))
    rest = F.array_compact(
        F.array(
            F.when(~cameras.eqNullSafe(F.array(F.lit("front"), F.lit("wrist"))), F.concat(at, F.lit("cameras="), F.array_join(cameras, ","))),
            F.when(frame != state_frame, F.concat(at, F.lit("state/action frame mismatch"))),
            F.when(F.abs(time - state_time) > 1e-12, F.concat(at, F.lit("state/action timestamp mismatch"))),
        )
    )
    return F.when(domain != "robot", F.array(F.concat(at, F.lit("non-robot domain")))).when(kind != "robot_sample", F.array(F.concat(at, F.lit("non-robot_sample item")))).otherwise(rest)


def generation_gate(retrieved: DataFrame, required: DataFrame) -> DataFrame:
    """(item_id, required_page_retrieved, action): generation is skipped for an item whose required page is not in its list."""
    hit = retrieved.join(required, ["item_id", "source_id", "page_number"], "left_semi").select("item_id").distinct().withColumn("_hit", F.lit(True))
    out = required.select("item_id").distinct().join(hit, "item_id", "left")
    found = F.coalesce("_hit", F.lit(False))
    return out.select("item_id", found.alias("required_page_retrieved"), F.when(found, "generate").otherwise("skip_generation").alias("action"))
