"""Intervals: range, nearest and best-overlap joins, proposals, metric blocks, radius search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric as N

THRESHOLDS = (0.10, 0.25, 0.50)


def threshold_key(x: float) -> str:
    return f"{x:.2f}"


#: Frames of a bucket of the range join: an interval is listed once for each bucket that it touches.
BUCKET = 64


def _touched(start: Column, end: Column) -> Column:
    return F.sequence(F.floor(start / BUCKET), F.floor(end / BUCKET))


def points_inside(events: DataFrame, points: DataFrame) -> DataFrame:
    """(event_id, episode_id, frame_index): the points of an event's closed frame range, met bucket by bucket and not by episode."""
    spread = events.where("start_frame <= end_frame").select("event_id", "episode_id", "start_frame", "end_frame", F.explode(_touched(F.col("start_frame"), F.col("end_frame"))).alias("_bucket"))
    placed = points.select("episode_id", "frame_index", F.floor(F.col("frame_index") / BUCKET).alias("_bucket"))
    return spread.join(placed, ["episode_id", "_bucket"]).where("frame_index between start_frame and end_frame").select("event_id", "episode_id", "frame_index")


def neighbours(events: DataFrame, points: DataFrame, by: Sequence[str], at: Column, place: Column, order: Column, payload: Column) -> DataFrame:
    """The events with ``before`` and ``after``: the payloads of the nearest points at or before, and at or after, ``at``.

    One sort of events and points together; no pair is made. Of points at the
    same place the one with the least ``order`` is taken. Null where there is none.
    """
    columns = events.columns
    e = events.select(*by, at.cast("double").alias("_x"), F.struct(*columns).alias("_e"))
    p = points.select(*by, place.cast("double").alias("_x"), order.alias("_o"), payload.alias("_p"))
    rows = e.unionByName(p, allowMissingColumns=True).withColumn("_is", F.col("_e").isNotNull())
    w = Window.partitionBy(*by)
    seen = F.last("_p", ignorenulls=True)
    rows = rows.withColumn("before", seen.over(w.orderBy("_x", "_is", F.desc("_o")).rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("after", seen.over(w.orderBy(F.desc("_x"), "_is", F.desc("_o")).rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("_is").select("_e.*", "before", "after")


def event_coverage(events: DataFrame, points: DataFrame) -> DataFrame:
    """For each event (event_id, episode_id, start_frame, end_frame, center_sec): the points inside it and the nearest point.

    points: (episode_id, frame_index, timestamp_sec). Points inside are met by a
    bucketed range join, the nearest by one sort; no episode's events and points
    are paired. Ties go to the lower frame.
    """
    inside = points_inside(events, points).groupBy("event_id", "episode_id").agg(F.count(F.lit(1)).alias("n"))
    found = neighbours(events, points, ["episode_id"], F.col("center_sec"), F.col("timestamp_sec"), F.col("frame_index"), F.struct("timestamp_sec", "frame_index"))

    def away(side: str) -> Column:
        return F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col(f"{side}.timestamp_sec") - F.col("center_sec")).alias("d"), F.col(f"{side}.frame_index").alias("frame")))

    near = F.array_min(F.array_compact(F.array(away("before"), away("after"))))
    return found.withColumn("near", near).join(inside, ["event_id", "episode_id"], "left").select(
        "event_id", "episode_id", F.coalesce("n", F.lit(0)).alias("n_inside"), F.col("n").isNotNull().alias("covered"), F.col("near.frame").alias("nearest_frame"),
        F.round(F.col("near.d") * 1000.0, 6).alias("nearest_ms"),
    )


def coverage_summary(coverage: DataFrame) -> DataFrame:
    return coverage.agg(
        F.count(F.lit(1)).alias("verified_events"), F.sum(F.col("covered").cast("int")).alias("covered_events"),
        F.avg(F.col("covered").cast("int")).alias("event_coverage"), F.round(F.avg("nearest_ms"), 6).alias("mean_distance_ms"),
    )


def localize(events: DataFrame, candidates: DataFrame, tolerances: Sequence[int] = (0, 5, 15)) -> DataFrame:
    """Point-to-interval join: the candidate nearest to each event's interval, and whether it is within each tolerance.

    Events of episodes without candidates have no row. A candidate outside is
    nearest from one of both sides; candidates inside come from a bucketed join.
    """
    own = points_inside(events, candidates).groupBy("event_id", "episode_id").agg(F.array_sort(F.collect_set("frame_index")).alias("inside"))
    frame = F.col("frame_index")
    left = neighbours(events, candidates, ["episode_id"], F.col("start_frame"), frame, frame, frame).withColumnRenamed("before", "_low").drop("after")
    both = neighbours(left, candidates, ["episode_id"], F.col("end_frame"), frame, frame, frame).drop("before").withColumnRenamed("after", "_high")
    rows = both.join(own, ["event_id", "episode_id"], "left").withColumn("inside", F.coalesce("inside", F.array().cast("array<int>")))

    def option(f: Column) -> Column:
        return F.when(f.isNotNull(), F.struct(N.point_distance(f, F.col("start_frame"), F.col("end_frame")).alias("d"), f.alias("frame")))

    best = F.array_min(F.array_compact(F.array(option(F.col("_low")), option(F.col("_high")), option(F.array_min("inside")))))
    return rows.withColumn("b", best).where("b is not null").select(
        "event_id", "episode_id", F.col("b.d").alias("min_frame_distance"), F.col("b.frame").alias("closest_frame"), F.size("inside").alias("n_inside"),
        (F.col("b.d") == 0).alias("exact_hit"), *[(F.col("b.d") <= t).alias(f"hit_within_{t}") for t in tolerances],
    )


def localization_block(results: DataFrame, tolerances: Sequence[int] = (0, 5, 15)) -> DataFrame:
    """One row over ``localize``: n_events, mean and median distance, and the hit rate of each tolerance."""
    return results.agg(
        F.count(F.lit(1)).alias("n_events"), F.round(F.avg("min_frame_distance"), 9).alias("mean_distance"), F.round(F.median("min_frame_distance"), 9).alias("median_distance"),
        *[F.round(F.avg(F.col(f"hit_within_{t}").cast("double")), 9).alias(f"hit_rate_{t}") for t in tolerances],
    )


def proposals(candidates: DataFrame, frame_counts: DataFrame, radii: Sequence[int]) -> DataFrame:
    """Intervals of each radius around candidates, cut to the episode; candidates whose only reason is a uniform anchor do not count."""
    signal = candidates.where(F.exists("reasons", lambda r: r != "uniform_anchor")).join(frame_counts, "episode_id")
    rows = signal.withColumn("radius_frames", F.explode(F.array(*[F.lit(int(r)) for r in sorted(set(radii))])))
    return rows.select(
        "episode_id", "radius_frames", F.col("frame_index").alias("center_frame"),
        F.greatest(F.lit(0), F.col("frame_index") - F.col("radius_frames")).alias("start_frame"),
        F.least(F.col("n_frames") - 1, F.col("frame_index") + F.col("radius_frames")).alias("end_frame"),
        F.array_sort(F.array_remove("reasons", "uniform_anchor")).alias("reasons"),
    )


def best_overlap(events: DataFrame, found: DataFrame, radii: Sequence[int] | None = None) -> DataFrame:
    """For each event and radius the proposal by (IoU, centre distance, centre).

    Proposals that overlap an event are met bucket by bucket; where none does,
    all have an IoU of 0 and one of the two nearest centres is the best. No
    episode's events and proposals are paired. radii: those that the proposals
    have, where they are known; otherwise they are read from the proposals.
    """
    p = found.select("episode_id", "radius_frames", "center_frame", F.col("start_frame").alias("p0"), F.col("end_frame").alias("p1"))
    keys = ["event_id", "episode_id", "mode", "start_frame", "end_frame"]
    e = events.select(*keys)
    middle = (F.col("start_frame") + F.col("end_frame")) / 2.0
    a = e.withColumn("_bucket", F.explode(_touched(F.col("start_frame"), F.col("end_frame"))))
    b = p.withColumn("_bucket", F.explode(_touched(F.col("p0"), F.col("p1"))))
    over = a.join(b, ["episode_id", "_bucket"]).where("start_frame <= p1 and p0 <= end_frame").select(*keys, "radius_frames", "center_frame", "p0", "p1")
    if radii is None:
        asked = e.join(p.select("episode_id", "radius_frames").distinct(), "episode_id")
    else:
        asked = e.withColumn("radius_frames", F.explode(F.array(*[F.lit(int(r)) for r in sorted(set(radii))])))
    sides = neighbours(asked, p, ["episode_id", "radius_frames"], middle, F.col("center_frame"), F.struct("center_frame", "p0", "p1"), F.struct("center_frame", "p0", "p1"))
    near = sides.select(*keys, "radius_frames", F.inline(F.array_compact(F.array("before", "after"))))
    iou = N.interval_iou(F.col("start_frame"), F.col("end_frame"), F.col("p0"), F.col("p1"))
    rank = F.struct((-iou).alias("neg"), F.abs(F.col("center_frame") - middle).alias("d"), F.col("center_frame").alias("c"), "p0", "p1")
    best = over.unionByName(near).groupBy(*keys, "radius_frames").agg(F.min(rank).alias("b"))
    return best.select(
        "event_id", "episode_id", "mode", "radius_frames", "start_frame", "end_frame", F.col("b.c").alias("best_center_frame"), F.col("b.p0").alias("best_start_frame"),
        F.col("b.p1").alias("best_end_frame"), (F.lit(0.0) - F.col("b.neg")).alias("best_iou"), (F.col("b.neg") < 0).alias("overlap_hit"),
        F.abs(F.col("b.p0") - F.col("start_frame")).alias("onset_error"), F.abs(F.col("b.p1") - F.col("end_frame")).alias("offset_error"),
    )


def _block(thresholds: Sequence[float]) -> list:
    return [
        F.count(F.lit(1)).alias("n_events"), F.avg(F.col("overlap_hit").cast("double")).alias("recall"), F.round(F.avg("best_iou"), 9).alias("mean_iou"),
        F.round(F.median("best_iou"), 9).alias("median_iou"),
        *[F.avg((F.col("best_iou") >= t).cast("double")).alias(f"recall_at_{threshold_key(t).replace('.', '_')}") for t in thresholds],
        F.round(F.avg("onset_error"), 9).alias("mean_onset_error"), F.round(F.avg("offset_error"), 9).alias("mean_offset_error"),
    ]


def metric_rollup(results: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """The metric block over all events and for each mode; the row for all has mode null, and is there without events too."""
    if any(not 0 < t <= 1 for t in thresholds):
        raise ValueError("thresholds must be in (0, 1]")
    block = _block(thresholds)
    overall = results.agg(*block)  # grouping sets would give no row at all for no events
    return overall.select(F.lit(None).cast("string").alias("mode"), "*").unionByName(results.groupBy("mode").agg(*block))


def radius_grid(results: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """A metric block for each radius, and whether it is the one to select: by recall, recall at 0.25, mean IoU, smaller radius."""
    grid = results.groupBy("radius_frames").agg(*_block(thresholds))
    order = Window.orderBy(F.desc("recall"), F.desc("recall_at_0_25"), F.desc("mean_iou"), "radius_frames")
    return grid.withColumn("selected", F.row_number().over(order) == 1)


def uncovered_bounds(events: DataFrame, frames: DataFrame) -> DataFrame:
    """(event_id, frame_index): interval bounds that are no frame of their episode; must be empty."""
    bounds = events.select("event_id", "episode_id", F.explode(F.array("start_frame", "end_frame")).alias("frame_index")).distinct()
    return bounds.join(frames.select("episode_id", "frame_index"), ["episode_id", "frame_index"], "left_anti").select("event_id", "frame_index")
