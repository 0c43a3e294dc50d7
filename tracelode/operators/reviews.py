"""Reviews of anomalous episodes: source presence, review cases, templates, their events, and checks of what was picked."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The five parts of a recording, and the fields of an event in a review.
PRESENCE = ("raw_episode_dir_exists", "metadata_exists", "samples_csv_exists", "front_dir_exists", "wrist_dir_exists")
EVENT = "event_id:string,observed_failure_mode:string,failure_interval:struct<start_frame:bigint,end_frame:bigint>,causal_diagnosis:string,supporting_robot_refs:array<string>,counterevidence_robot_refs:array<string>,confidence:double,event_status:string"


def presence_complete() -> Column:
    """Are all parts of the recording there? Null counts as absent."""
    out = F.lit(True)
    for c in PRESENCE:
        out = out & F.coalesce(F.col(c), F.lit(False))
    return out


def anomalies_present(audit: DataFrame) -> DataFrame:
    """One row: n_anomalies, and whether there are any and all of them are complete."""
    own = audit.where("audit_category = 'operation_anomaly'").withColumn("_whole", presence_complete())
    return own.agg(F.count(F.lit(1)).alias("n_anomalies"), (F.coalesce(F.every("_whole"), F.lit(False))).alias("complete"))


def require_presence(audit: DataFrame) -> DataFrame:
    """The audit, failing on the first row with a part missing."""
    bad = F.raise_error(F.concat(F.lit("incomplete source of episode "), F.col("episode_id").cast("string"))).cast("boolean")
    return audit.where(F.when(presence_complete(), True).otherwise(bad))


def review_cases(audit: DataFrame, manifest_root: str, processed_root: str) -> DataFrame:
    """One draft case for each operation anomaly, with an event for each observed failure mode."""
    own = audit.where("audit_category = 'operation_anomaly'")
    e = F.col("episode_id").cast("string")
    event = F.transform(
        F.col("observed_failure_modes"),
        lambda m, i: F.struct(
            F.format_string("%s_event_%02d", e, i + 1).alias("event_id"), m.alias("observed_failure_mode"), F.lit(None).alias("failure_interval"), F.lit(None).alias("causal_diagnosis"),
            F.array().alias("supporting_robot_refs"), F.array().alias("counterevidence_robot_refs"), F.lit(None).alias("confidence"), F.lit("draft").alias("event_status"),
        ),
    ).cast(f"array<struct<{EVENT}>>")
    reason = F.when(F.col("failure_reason").isNull(), F.raise_error(F.lit("an anomaly has no failure reason")).cast("string")).otherwise(F.col("failure_reason"))
    return own.select(
        F.concat(F.lit("day16_review_"), e).alias("review_id"), "episode_id", "task_success", reason.alias("original_failure_reason"), event.alias("events"), F.lit(None).cast("string").alias("reviewer"),
        F.lit(None).cast("string").alias("review_notes"), F.concat(F.lit(f"{manifest_root}/"), e, F.lit(".json")).alias("diagnostic_manifest_path"),
        F.concat(F.lit(f"{processed_root}/"), e, F.lit("/frames.jsonl")).alias("diagnostic_frames_path"),
    )


def observed_failure_modes(events: Column) -> Column:
    return F.transform(events, lambda e: e["observed_failure_mode"])


def all_events_draft(events: Column) -> Column:
    return F.forall(events, lambda e: e["event_status"] == "draft")


def all_diagnoses_unset(events: Column) -> Column:
    return F.forall(events, lambda e: e["causal_diagnosis"].isNull())


def review_complete(events: Column) -> Column:
    return F.forall(events, lambda e: e["event_status"] == "verified")


def review_template(case: DataFrame) -> DataFrame:
    """The template that a reviewer fills in: the case with its events reset to drafts."""
    blank = F.transform("events", lambda e: F.struct(
        e["event_id"].alias("event_id"), e["observed_failure_mode"].alias("observed_failure_mode"), F.lit(None).alias("failure_interval"), F.lit(None).alias("causal_diagnosis"),
        F.array().alias("supporting_robot_refs"), F.array().alias("counterevidence_robot_refs"), F.lit(None).alias("confidence"), F.lit("draft").alias("event_status"),
    )).cast(f"array<struct<{EVENT}>>")
    return case.select("review_id", "episode_id", "task_success", F.lit(True).alias("operation_anomaly"), "original_failure_reason", blank.alias("events"), F.lit(None).cast("string").alias("reviewer"), F.lit(None).cast("string").alias("notes"))


def flatten_events(cases: DataFrame) -> DataFrame:
    """A row for each event with its case's ids; an event_id that occurs twice is an error."""
    rows = cases.select("review_id", "episode_id", F.explode("events").alias("e")).select("review_id", "episode_id", "e.*")
    twice = rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("_n"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated event "), F.col("event_id"))).cast("boolean")).otherwise(True)
    return rows.join(twice, "event_id").where(checked).drop("_n")


def load_templates(spark, path: str, expected: int | None = None) -> DataFrame:
    """Review templates (JSON files, one a case) as event rows; another number of files than ``expected`` is an error."""
    rows = spark.read.schema(f"review_id string, episode_id string, events array<struct<{EVENT}>>, reviewer string, notes string").option("multiLine", True).json(path)
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"{n} review templates, not {expected}")
    return flatten_events(rows)


def camera_transforms(settings: Column) -> Column:
    """The transform of both cameras; 'none' where the settings do not name one."""
    raw = settings["camera_transforms"]
    return F.struct(*[F.coalesce(raw[c], F.lit("none")).alias(c) for c in ("front", "wrist")])


def required_count(settings: Column) -> Column:
    """The expected number of samples; an error where it is missing or not positive."""
    n = settings["expected_sample_count"]
    return F.when(n > 0, n).otherwise(F.raise_error(F.lit("expected_sample_count is missing")).cast("int"))


def rounded(values: Column, digits: int = 6) -> Column:
    """A map with rounded values."""
    return F.transform_values(values, lambda _, v: F.round(v.cast("double"), digits))


def joint_map(values: Column, joints: Sequence[str], digits: int = 6) -> Column:
    """A vector in joint order as a map of rounded values."""
    return rounded(F.map_from_arrays(F.array(*[F.lit(j) for j in joints]), values), digits)


def close(actual: Column, expected: Column, tolerance: float = 1e-5) -> Column:
    return F.abs(actual - expected) <= tolerance


def selection_rules(uniform: int, peaks: int, cap: int) -> None:
    """Positive numbers, and a cap that holds the uniform anchors."""
    if min(uniform, peaks, cap) < 1 or cap < uniform:
        raise ValueError("selection counts must be positive and the cap must hold the uniform anchors")


def pack_rules(cap: int) -> Mapping[str, Column]:
    """What a review pack's row (frames, events) must keep: frames in order, none twice, not above the cap, all events drafts without diagnosis."""
    frames = F.col("frames")
    return {
        "order": frames == F.array_sort(frames), "unique": F.size(F.array_distinct(frames)) == F.size(frames), "cap": F.size(frames) <= cap,
        "draft": all_events_draft(F.col("events")), "unset": all_diagnoses_unset(F.col("events")),
    }


def candidate_checks(candidates: DataFrame, samples: DataFrame, cap: int, tolerance: float = 1e-9) -> DataFrame:
    """(episode_id, n, unique, within_cap, timestamps_match) of reported candidates against the samples themselves."""
    rows = candidates.select("episode_id", "frame_index", F.col("timestamp_sec").alias("t")).join(samples.select("episode_id", "frame_index", "timestamp_sec"), ["episode_id", "frame_index"], "left")
    return rows.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("n"), (F.count_distinct("frame_index") == F.count(F.lit(1))).alias("unique"), (F.count(F.lit(1)) <= cap).alias("within_cap"),
        F.every(F.coalesce(F.abs(F.col("t") - F.col("timestamp_sec")) <= tolerance, F.lit(False))).alias("timestamps_match"),
    )


def preservation(audit: DataFrame, review: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(episode_id, problem): ids on one side alone, and rows whose columns were changed by the review; empty if all is preserved."""
    a = audit.select("episode_id", F.struct(*columns).alias("_a"))
    b = review.select("episode_id", F.struct(*columns).alias("_b"))
    both = a.join(b, "episode_id", "full_outer")
    problem = F.when(F.col("_b").isNull(), "not_reviewed").when(F.col("_a").isNull(), "not_audited").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select("episode_id", problem.alias("problem")).where("problem is not null")
