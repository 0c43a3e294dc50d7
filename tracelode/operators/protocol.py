"""Generated tables: the collection plan of 15 groups by 6 slots, and its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Causes with their interventions, in rotation order; the slots of a group (null cause: the rotated one).
CAUSES = (
    ("target_offset_or_perception", "object_target_pose_offset"),
    ("gripper_close_timing", "manual_gripper_close_timing_shift"),
    ("trajectory_execution_deviation", "manual_bounded_trajectory_deviation"),
)
GROUPS = 15


def rotated(group: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(group - 1, F.lit(len(values))) + 1).cast("int"))


def collection_plan(spark: SparkSession) -> DataFrame:
    """90 rows: a clean control, the three causes, a repeat of the group's rotated cause, and an ambiguous slot."""
    slots = [("clean_control", "none_clean", "none", False), *[("controlled_cause", c, i, False) for c, i in CAUSES], ("controlled_cause", None, None, True), ("insufficient_evidence_candidate", "unknown", "ambiguity_protocol", False)]
    table = spark.createDataFrame([(k, *s) for k, s in enumerate(slots, 1)], "slot_index int, slot_role string, cause string, intervention string, repeat_slot boolean")
    groups = spark.range(1, GROUPS + 1).select(F.col("id").cast("int").alias("g"))
    gid = F.format_string("rcv2_g%02d", F.col("g"))
    return groups.crossJoin(F.broadcast(table)).select(
        F.concat(gid, F.format_string("_s%02d", "slot_index")).alias("plan_row_id"), gid.alias("pair_group_id"), "slot_index", "slot_role",
        F.coalesce("cause", rotated(F.col("g"), [c for c, _ in CAUSES])).alias("planned_physical_cause"),
        F.coalesce("intervention", rotated(F.col("g"), [i for _, i in CAUSES])).alias("planned_intervention_type"), "repeat_slot", F.lit("final_v2").alias("benchmark_target"),
    )


def plan_violations(plan: DataFrame) -> DataFrame:
    """Groups whose slots are not one control, four causes of which one repeats, and one ambiguous; empty for a right plan."""
    role = lambda r: F.count_if(F.col("slot_role") == r)
    per = plan.groupBy("pair_group_id").agg(
        F.count(F.lit(1)).alias("n"), role("clean_control").alias("controls"), role("controlled_cause").alias("causes"), role("insufficient_evidence_candidate").alias("ambiguous"),
        F.count_if("repeat_slot").alias("repeats"), F.count_distinct("slot_index").alias("slots"),
    )
    return per.where("not (n = 6 and controls = 1 and causes = 4 and ambiguous = 1 and repeats = 1 and slots = 6)")


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("slot_role", "planned_physical_cause").agg(F.count(F.lit(1)).alias("n"))
