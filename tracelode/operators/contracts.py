"""Contracts: row rules as boolean columns, asserted or quarantined; expected counts; schema walks for leaked names.

A rule is a name and a column that is true where the row keeps it. Null counts
as broken.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scan

Rules = Mapping[str, Column]


def violations(rules: Rules) -> Column:
    """The names of broken rules, in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))


def quarantine(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with the rules they break."""
    marked = df.withColumn("violations", violations(rules))
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


def enforce(df: DataFrame, rules: Rules) -> DataFrame:
    """The frame, failing at run time on the first broken row."""
    names = violations(rules)
    kept = F.when(F.size(names) == 0, True).otherwise(F.raise_error(F.concat(F.lit("broken contract: "), F.array_join(names, ", "))).cast("boolean"))
    return df.where(kept)


def expect(df: DataFrame, expected: Mapping[str, int], counts: Mapping[str, Column]) -> DataFrame:
    """(check, expected, actual, passed): named counts of the frame in one pass against what they should be."""
    row = df.agg(*[F.sum(F.coalesce(c.cast("long"), F.lit(0))).alias(n) for n, c in counts.items()])
    checks = [F.struct(F.lit(n).alias("check"), F.lit(int(v)).cast("long").alias("expected"), F.coalesce(F.col(n), F.lit(0)).alias("actual")) for n, v in expected.items()]
    return row.select(F.inline(F.array(*checks))).withColumn("passed", F.col("expected") == F.col("actual"))


# --- rules of the rows ---


def bbox_rules(b: str = "bbox") -> Rules:
    x1, y1, x2, y2 = (F.col(f"{b}.{c}") for c in ("x1", "y1", "x2", "y2"))
    return {"bbox_unit": (F.least(x1, y1, x2, y2) >= 0) & (F.greatest(x1, y1, x2, y2) <= 1), "bbox_order": (x1 < x2) & (y1 < y2)}


def ref_rules(r: str = "ref") -> Rules:
    c = lambda n: F.col(f"{r}.{n}")
    return {
        "pdf_page": (c("source_type") != "pdf") | c("page_number").isNotNull(),
        "time_order": c("time_start_sec").isNull() | c("time_end_sec").isNull() | (c("time_end_sec") >= c("time_start_sec")),
        "robot_place": (c("source_type") != "robot_sequence") | c("time_start_sec").isNotNull() | c("frame_index").isNotNull(),
        "frame_camera": c("frame_index").isNull() | c("camera").isNotNull(),
    }


def manifest_rules() -> Rules:
    return {
        "pdf_pages": (F.col("source_type") != "pdf") | F.col("page_count").isNotNull(),
        "image_size": (F.col("source_type") != "image") | (F.col("width_px").isNotNull() & F.col("height_px").isNotNull()),
        "sha256": F.col("sha256").rlike("^[0-9a-f]{64}$"), "size": F.col("size_bytes") >= 0,
    }


def eval_case_rules() -> Rules:
    draft = F.col("annotation_status") != "verified"
    return {
        "label": draft | F.col("answerable").isNotNull(), "answer": draft | ~F.coalesce("answerable", F.lit(False)) | (F.length(F.trim("expected_answer")) > 0),
        "evidence": draft | ~F.coalesce("answerable", F.lit(False)) | (F.size("expected_evidence") > 0), "reviewer": draft | (F.col("verified_by").isNotNull() & F.col("verified_at").isNotNull()),
    }


def slice_rules() -> Rules:
    return {
        "duration": F.col("end_sec") > F.col("start_sec"), "midpoint": (F.col("midpoint_timestamp_sec") >= F.col("start_sec")) & (F.col("midpoint_timestamp_sec") < F.col("end_sec")),
        "frames": (F.col("start_frame_index") <= F.col("midpoint_frame_index")) & (F.col("midpoint_frame_index") < F.col("end_frame_index_exclusive")),
    }


def selection_rules(parts: tuple[str, str], fused: str) -> Rules:
    return {
        "inside": F.col("selected_timestamp_sec").between(F.col("start_sec"), F.col("end_sec")) & (F.col("selected_timestamp_sec") < F.col("end_sec")),
        "fused": F.abs(F.col(fused) - F.greatest(*parts)) <= 1e-12,
    }


def keyframe_rules(k: int, windows: Column) -> Rules:
    return {"k": F.lit(k in (1, 2, 3)), "samples": F.col("shared_sample_budget") == windows * k, "images": F.col("evidence_image_budget") == F.col("shared_sample_budget") * 2}


def annotation_rules() -> Rules:
    draft = F.col("status") != "verified"
    return {
        "interval": draft | (F.col("start_frame_index").isNotNull() & (F.col("end_frame_index_inclusive") >= F.col("start_frame_index"))), "cameras": F.size("evidence_cameras") > 0,
    }


def episode_rules() -> Rules:
    cameras = F.col("cameras")
    return {"order": F.transform(cameras, lambda c: c["camera"]) == F.array(F.lit("front"), F.lit("wrist")), "counts": F.forall(cameras, lambda c: c["frame_count"] == F.col("frame_count"))}


def provenance_rules(p: str = "provenance") -> Rules:
    return {"supporting": F.forall(F.map_values(F.col(f"{p}.supporting_sha256")), lambda v: v.rlike("^[0-9a-f]{64}$"))}


def item_rules(i: str = "item") -> Rules:
    item = F.col(i)
    document, robot = item["document"].isNotNull(), item["robot"].isNotNull()
    return {
        "payload": F.when(item["kind"] == "document_page", document & ~robot).when(item["kind"] == "robot_sample", robot & ~document).otherwise(False),
        "refs": F.when(item["kind"] == "document_page", F.size(item["refs"]) == 1).otherwise(F.size(item["refs"]) == 2),
        "frames": (item["kind"] != "robot_sample") | F.forall(item["refs"], lambda r: r["frame_index"] == item["robot"]["frame_index"]),
    }


def bundle_rules(items: str = "items") -> Rules:
    ids = F.transform(F.col(items), lambda i: i["evidence_id"])
    refs = F.transform(F.flatten(F.transform(F.col(items), lambda i: i["refs"])), lambda r: F.to_json(r, {"ignoreNullFields": "false"}))
    return {"some": F.size(items) > 0, "ids": F.size(F.array_distinct(ids)) == F.size(ids), "refs": F.size(F.array_distinct(refs)) == F.size(refs)}


def audit_rules() -> Rules:
    c = F.col("audit_category")
    return {
        "technical": (c != "technical_exclusion") | (~F.col("diagnostic_eligible") & F.col("exclusion_reason").isNotNull()),
        "anomaly": (c != "operation_anomaly") | (F.size("observed_failure_modes") > 0), "modes": (c == "operation_anomaly") | (F.size("observed_failure_modes") == 0),
    }


def interval_rules() -> Rules:
    return {"frames": F.col("end_frame") >= F.col("start_frame"), "seconds": F.col("end_sec") >= F.col("start_sec")}


def review_rules() -> Rules:
    """The decision table of a verified review record."""
    clean, insufficient = F.col("diagnostic_decision_gt") == "clean_success", F.col("diagnostic_decision_gt") == "insufficient_evidence"
    cause = ~clean & ~insufficient
    answer = F.col("evidence_answerability_gt")
    return {
        "valid": F.col("technical_valid") & F.col("experimental_valid"),
        "clean": ~clean | (F.col("task_success") & (F.col("physical_cause_gt") == "none_clean") & (answer == "not_applicable_clean") & F.col("failure_interval").isNull() & ~F.coalesce("intervention_verified", F.lit(False))),
        "failed": clean | (~F.col("task_success") & F.col("failure_interval").isNotNull()),
        "insufficient": ~insufficient | ((answer == "insufficient_evidence") & (F.col("physical_cause_gt") != "none_clean")),
        "cause": ~cause | ((F.col("physical_cause_gt") == F.col("diagnostic_decision_gt")) & (answer == "answerable") & F.coalesce("intervention_verified", F.lit(False)) & (F.size("supporting_robot_refs") > 0) & (F.size("supporting_manual_refs") > 0)),
    }


def ingest_rules(allowed_failed_checks: Iterable[str] = ()) -> Rules:
    """The diagnostic recording gate: completed, not aborted, no error, failed checks only of those allowed."""
    failed = F.array_sort(F.map_keys(F.map_filter("checks", lambda k, v: ~v)))
    allow = F.array(*[F.lit(x) for x in allowed_failed_checks]).cast("array<string>")
    return {
        "completed": F.col("completed"), "not_aborted": ~F.col("aborted"), "no_error": F.col("error").isNull(), "checks": F.size(F.array_except(failed, allow)) == 0,
    }


def retrieval_case_rules() -> Rules:
    """The gold pages of a retrieval case are all different."""
    return {"unique_gold": F.size(F.array_distinct("document_gold_pages")) == F.size("document_gold_pages")}


def retrieved_bundle_rules(top_k: int) -> Rules:
    """A bundle answers the question that was asked and holds at most top_k items."""
    return {"question": F.trim("bundle_question") == F.trim("question"), "size": F.size("items") <= top_k}


def strict_ingest_rules() -> Rules:
    """The stricter gate: all checks hold and the recording is valid for training."""
    return dict(ingest_rules()) | {"training": F.col("valid_for_training"), "overall": F.col("overall_pass"), "count": F.col("sample_count") == F.col("expected_sample_count")}


def ranked_list_rules(df: DataFrame, by: str = "item_id", key: str = "evidence_id") -> DataFrame:
    """(by, contiguous, unique, finite) for ranked lists with rank and score."""
    return df.groupBy(by).agg(
        ((F.min("rank") == 1) & (F.max("rank") == F.count(F.lit(1))) & (F.count_distinct("rank") == F.count(F.lit(1)))).alias("contiguous"),
        (F.count_distinct(key) == F.count(F.lit(1))).alias("unique"), F.every(~F.isnan("score") & (F.abs("score") < float("inf"))).alias("finite"),
    )


# --- leaks ---


def schema_names(kind: T.DataType, path: str = "") -> list[tuple[str, str]]:
    """(path, field name) of every field, at any depth of structs, arrays and maps."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in [(f"{path}.{f.name}".lstrip("."), f.name), *schema_names(f.dataType, f"{path}.{f.name}")]]
    if isinstance(kind, T.ArrayType):
        return schema_names(kind.elementType, path + "[]")
    if isinstance(kind, T.MapType):
        return schema_names(kind.valueType, path + "{}")
    return []


def leaked_fields(df: DataFrame, forbidden: Iterable[str]) -> list[str]:
    """Paths of fields with a forbidden name anywhere in the schema."""
    bad = set(forbidden)
    return [p for p, n in schema_names(df.schema) if n in bad]


def assert_no_leak(df: DataFrame, forbidden: Iterable[str]) -> DataFrame:
    if found := leaked_fields(df, forbidden):
        raise ValueError(f"forbidden fields: {', '.join(found)}")
    return df


def leaked_keys(column: Column, forbidden: Iterable[str]) -> Column:
    """Forbidden keys of a map column, for names that are data."""
    return F.array_intersect(F.map_keys(column), F.array(*[F.lit(x) for x in forbidden]))


def label_free(query: Column, labels: Iterable[str]) -> Column:
    """Does the query contain none of the label words, in any case?"""
    return ~F.exists(F.array(*[F.lit(x.lower()) for x in labels]), lambda x: F.contains(F.lower(query), x))


def absent_everywhere(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """item_id of absence terms (item_id, text) that some page contains after compaction of both; must be empty."""
    return scan.containing(pages, terms, scan.compact, any_page=True)
