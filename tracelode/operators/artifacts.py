"""Frozen artifacts: canonical JSON, the split, model and report tables, and the checks that a stored one still holds.

The parts of an artifact that grow with the data are tables, a row for each
episode or event; what is of fixed size (a grid, a metric block, flags) is one
row. ``canonical_json`` turns either into text whose bytes do not vary.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals as I


def canonical_json_bytes(value: Any) -> bytes:
    """Sorted keys, no spaces, text as it is, one line end."""
    return (json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n").encode()


def canonical_json(columns: Mapping[str, Column]) -> Column:
    """An object of the named columns as JSON with sorted keys; nulls are kept. For columns of text, whole numbers, booleans and arrays of these."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def table_digest(rows: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """One row (n, digest): an order-independent digest of the rows' canonical JSON, so a rebuilt table can be held against a frozen one."""
    line = F.sha2(canonical_json(columns), 256)
    part = F.conv(F.substring(line, 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest"))


def split_artifact(eligible: DataFrame, assignments: DataFrame, gold: DataFrame) -> DataFrame:
    """(episode_id, split, source_category, n_events, event_ids, dispositions) for every eligible episode.

    The assignments must be of exactly the eligible episodes, and the gold
    events of exactly the anomalous ones; anything else is an error. No interval
    column of the gold is read.
    """
    summary = gold.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.array_sort(F.collect_list("event_id")).alias("event_ids"), F.array_sort(F.collect_set("review_disposition")).alias("dispositions")
    )
    e = eligible.select("episode_id", "audit_category", F.lit(True).alias("_e"))
    rows = e.join(assignments.select("episode_id", "split"), "episode_id", "full_outer").join(summary, "episode_id", "full_outer")
    anomaly = F.col("audit_category") == "operation_anomaly"
    bad = (
        F.when(F.col("_e").isNull() | F.col("split").isNull(), "assignments are not of the eligible episodes")
        .when(anomaly != F.col("n_events").isNotNull(), "gold events are not of the anomalous episodes")
    )
    checked = F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(True)
    return rows.where(checked).select(
        "episode_id", "split", F.col("audit_category").alias("source_category"), F.coalesce("n_events", F.lit(0)).alias("n_events"),
        F.coalesce("event_ids", F.array().cast(summary.schema["event_ids"].dataType)).alias("event_ids"), F.coalesce("dispositions", F.array().cast("array<string>")).alias("dispositions"),
    )


def model_artifact(grid: DataFrame) -> DataFrame:
    """One row: the selected radius, its metrics, and the whole grid in order of radius."""
    metrics = F.struct(*[c for c in grid.columns if c != "selected"])
    return grid.agg(F.max(F.when(F.col("selected"), F.col("radius_frames"))).alias("selected_radius_frames"), F.max(F.when(F.col("selected"), metrics)).alias("selected_metrics"), F.array_sort(F.collect_list(metrics)).alias("grid_metrics"))


def development_report(proposals: DataFrame, results: DataFrame, unresolved: DataFrame, radius: int) -> DataFrame:
    """(kind, episode_id, key, start_frame, end_frame): proposals of the selected radius, results of verified events, ids of unresolved ones."""
    p = proposals.where(F.col("radius_frames") == radius).select(F.lit("proposal").alias("kind"), "episode_id", F.col("center_frame").cast("long").alias("key"), F.col("start_frame").cast("long").alias("start_frame"), F.col("end_frame").cast("long").alias("end_frame"))
    r = results.where(F.col("radius_frames") == radius).select(F.lit("result"), "episode_id", F.col("event_id").cast("long"), F.col("best_start_frame").cast("long"), F.col("best_end_frame").cast("long"))
    u = unresolved.select(F.lit("unresolved"), "episode_id", F.col("event_id").cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long"))
    return p.union(r).union(u)


def heldout_report(events: DataFrame, proposals: DataFrame, radius: int, thresholds: Sequence[float] = I.THRESHOLDS) -> tuple[DataFrame, DataFrame]:
    """(results, metrics) of the frozen radius on verified held-out events; a verified event of an episode without proposals is an error."""
    verified = events.where("review_disposition = 'verified'")
    own = proposals.where(F.col("radius_frames") == radius)
    known = own.select("episode_id").distinct().withColumn("_p", F.lit(True))
    bad = F.raise_error(F.lit("a held-out event has no proposals")).cast("boolean")
    checked = verified.join(known, "episode_id", "left").where(F.when(F.col("_p"), True).otherwise(bad)).drop("_p")
    results = I.best_overlap(checked, own)
    return results, I.metric_rollup(results, thresholds)


def localization_report(results: DataFrame, unresolved: DataFrame, tolerances: Sequence[int]) -> DataFrame:
    """The block of distances and hit rates over all verified events (mode null) and for each mode, with the number of unresolved ones in the first."""
    ts = sorted(set(tolerances))
    if any(t < 0 for t in ts):
        raise ValueError("tolerances must not be negative")
    block = [
        F.count(F.lit(1)).alias("n_events"), F.avg(F.col("exact_hit").cast("double")).alias("exact_event_recall"), *[F.avg((F.col("min_frame_distance") <= t).cast("double")).alias(f"recall_within_{t}") for t in ts],
        F.avg("min_frame_distance").alias("mean_min_frame_distance"), F.median("min_frame_distance").alias("median_min_frame_distance"),
    ]
    n = unresolved.agg(F.count(F.lit(1)).alias("n_unresolved"))
    overall = results.agg(*block).crossJoin(F.broadcast(n)).select(F.lit(None).cast("string").alias("mode"), "*")
    return overall.unionByName(results.groupBy("mode").agg(*block).withColumn("n_unresolved", F.lit(None).cast("long")))


def flag_rules(expected: Mapping[str, object]) -> Mapping[str, Column]:
    """A rule for each field that must have a stated value; dots lead into structs. For the seals of frozen models, reports and protocols."""
    return {name.replace(".", "_"): F.col(name).eqNullSafe(F.lit(value)) for name, value in expected.items()}


def digest_rules(expected: Mapping[str, str]) -> Mapping[str, Column]:
    """A rule for each digest field: 64 hexadecimal digits, and the stated ones."""
    return {name.replace(".", "_"): F.col(name).rlike("^[0-9a-f]{64}$") & (F.col(name) == value) for name, value in expected.items()}


def frozen(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(path, state) for each file of a manifest (path, sha256) against what is there: same, changed, missing, or unlisted."""
    both = manifest.select("path", F.col("sha256").alias("_m")).join(found.select("path", F.col("sha256").alias("_f")), "path", "full_outer")
    state = F.when(F.col("_m").isNull(), "unlisted").when(F.col("_f").isNull(), "missing").when(F.col("_m") == F.col("_f"), "same").otherwise("changed")
    return both.select("path", state.alias("state"))


def cases_with(cases: DataFrame, evidence: str, source_type: str = "pdf") -> DataFrame:
    """The cases of which any expected evidence is of a source type."""
    return cases.where(F.exists(evidence, lambda e: e["source_type"] == source_type))


def protocol_artifact(plan: DataFrame, config: Mapping[str, Any], plan_sha256: str) -> dict[str, Any]:
    """The frozen protocol: the configuration, the plan's digest, and its counts, checked against the configuration's."""
    counts = plan.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("pair_group_id").alias("groups")).first().asDict()
    wanted: Iterable[str] = [k for k in ("rows", "groups") if k in config]
    if any(config[k] != counts[k] for k in wanted):
        raise ValueError(f"the plan has {counts}, not what the configuration says")
    return {"config": dict(config), "collection_plan_sha256": plan_sha256, "counts": counts, "results_available": False}
