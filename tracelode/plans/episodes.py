"""Time-series and interval queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import intervals as I
from ..operators import timeseries as TS
from . import views as V

RADII = (1, 3, 5, 10, 15)
SCORES = ("state_change_rms", "action_change_rms", "tracking_gap_rms", "fused_state_action_score")


def _scores(s, d):
    return TS.change_scores(V.samples(s, d))


def signal_change_scores(s, d):
    return _scores(s, d).select("episode_id", "frame_index", *[F.round(c, 6).alias(c) for c in SCORES])


def signal_query_topk(s, d):
    joints, signals = TS.profile("gripper tracking_error".split(), ["wrist", "gripper"])
    out = TS.signal_search(V.samples(s, d), joints, signals, ["wrist", "gripper"], 3)
    return out.select("episode_id", "frame_index", F.round("raw_score", 6).alias("raw_score"), "rank")


def tumbling_slices_midpoint(s, d):
    out = TS.tumbling_slices(V.samples(s, d), V.DAY, "skip")
    return out.select("episode_id", "slice_index", "start_sec", "end_sec", "start_frame_index", "end_frame_index_exclusive", "midpoint_frame_index", F.round("midpoint_error_ms", 3).alias("midpoint_error_ms"))


def midpoint_error_summary(s, d):
    out = TS.tumbling_slices(V.samples(s, d), V.DAY, "skip")
    return out.agg(F.round(F.avg("midpoint_error_ms"), 3).alias("mean_ms"), F.round(F.max("midpoint_error_ms"), 3).alias("max_ms"), F.count(F.lit(1)).alias("n_slices"))


def argmax_per_slice(s, d):
    return TS.select_best(_scores(s, d), "fused_state_action_score", V.DAY).select("episode_id", "slice_index", "selected_frame_index", F.round("score", 6).alias("score"))


def multi_keyframe_k123(s, d):
    out = None
    for k in (1, 2, 3):
        one = TS.multi_keyframes(V.samples(s, d), V.DAY, k).withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.select("k", "episode_id", "slice_index", "keyframe_rank", "selected_frame_index", "distinct_frames")


def density_marginals(s, d):
    rows = multi_keyframe_k123(s, d).select("k", "episode_id", F.col("selected_frame_index").alias("frame_index")).distinct()
    hit = V.annotated(V.samples(s, d)).join(rows, "episode_id").groupBy("k", "event_id").agg(F.max(F.col("frame_index").between(F.col("start_frame"), F.col("end_frame")).cast("int")).alias("hit"))
    per = hit.groupBy("k").agg(F.avg("hit").alias("coverage"))
    return per.select("k", F.round("coverage", 9).alias("coverage"), F.round(F.col("coverage") - F.lag("coverage").over(Window.orderBy("k")), 9).alias("marginal"))


def strided_motion(s, d):
    frames = V.samples(s, d).withColumn("pixels", F.col("observation"))
    return TS.strided_motion(frames, 3).select("episode_id", "frame_index", F.round("motion_score", 6).alias("motion_score"))


def dominant_channel(s, d):
    c = F.when(F.col("state_change_rms") > F.col("action_change_rms"), "state").when(F.col("state_change_rms") < F.col("action_change_rms"), "action").otherwise("tie")
    return _scores(s, d).groupBy(c.alias("channel")).agg(F.count(F.lit(1)).alias("n"))


def _coverage(s, d):
    x = V.samples(s, d)
    mid = TS.tumbling_slices(x, V.DAY, "skip").select("episode_id", F.col("midpoint_frame_index").alias("frame_index"), F.col("midpoint_timestamp_sec").alias("timestamp_sec"))
    return I.event_coverage(V.annotated(x), mid)


def event_coverage_range_join(s, d):
    return _coverage(s, d).select("event_id", "n_inside", "covered")


def nearest_sample_join(s, d):
    return _coverage(s, d).select("event_id", "nearest_frame", F.round("nearest_ms", 3).alias("nearest_ms"))


def coverage_summary(s, d):
    out = I.coverage_summary(_coverage(s, d))
    return out.select("verified_events", "covered_events", F.round("event_coverage", 9).alias("event_coverage"), F.round("mean_distance_ms", 2).alias("mean_distance_ms"))


def method_comparison(s, d):
    x = V.samples(s, d)
    best = TS.select_best(TS.change_scores(x), "fused_state_action_score", V.DAY).select("episode_id", F.col("selected_frame_index").alias("frame_index"), F.col("selected_timestamp_sec").alias("timestamp_sec"))
    a = _coverage(s, d).select("event_id", F.col("covered").alias("by_midpoint"))
    b = I.event_coverage(V.annotated(x), best).select("event_id", F.col("covered").alias("by_change"))
    return a.join(b, "event_id").select("event_id", "by_midpoint", "by_change", (F.col("by_change").cast("int") - F.col("by_midpoint").cast("int")).alias("delta"))


def uniform_anchors(s, d):
    return TS.uniform_anchors(V.samples(s, d), 7)


def nms_peaks(s, d):
    return V.peaks_of(V.samples(s, d)).select("episode_id", "rank", "frame_index", F.round("score", 6).alias("score"))


def _candidates(s, d):
    x = V.samples(s, d)
    gap = TS.peaks(TS.change_scores(x), "tracking_gap_rms", 2, 5)
    return TS.review_candidates(x, {"state_action_change": (V.peaks_of(x), 900.0), "tracking_gap": (gap, 700.0)}, 3, 6)


def review_candidates(s, d):
    return _candidates(s, d).select("episode_id", "frame_index", F.array_join("reasons", "|").alias("reasons"), "best_priority")


def point_interval_distance(s, d):
    x = V.samples(s, d)
    return I.localize(V.annotated(x), V.peaks_of(x))


def _proposals(s, d):
    x = V.samples(s, d)
    c = V.peaks_of(x).select("episode_id", "frame_index", F.array(F.lit("state_action_change")).alias("reasons"))
    return I.proposals(c, V.frame_counts(x), RADII)


def interval_proposals(s, d):
    return _proposals(s, d).select("episode_id", "radius_frames", "center_frame", "start_frame", "end_frame")


def _overlap(s, d):
    return I.best_overlap(V.annotated(V.samples(s, d)), _proposals(s, d), RADII)


def best_iou_per_event(s, d):
    return _overlap(s, d).select("event_id", "radius_frames", "best_center_frame", "best_start_frame", "best_end_frame", F.round("best_iou", 9).alias("best_iou"), "overlap_hit", "onset_error", "offset_error")


def interval_metrics_rollup(s, d):
    return I.metric_rollup(_overlap(s, d).where("radius_frames = 5")).select("mode", "n_events", *[F.round(c, 6).alias(c) for c in METRICS])


def radius_grid_search(s, d):
    return I.radius_grid(_overlap(s, d)).select("radius_frames", "n_events", *[F.round(c, 6).alias(c) for c in METRICS], "selected")


def contiguity_check(s, d):
    return TS.contiguity(V.samples(s, d))


def _wide(s, d):
    return V.samples(s, d).select(
        "episode_id", "frame_index", "timestamp_sec", F.concat(F.lit("front/"), "frame_index", F.lit(".jpg")).alias("front_image"), F.concat(F.lit("wrist/"), "frame_index", F.lit(".jpg")).alias("wrist_image"),
        F.col("value").alias("front_age_ms"), F.col("k").alias("wrist_age_ms"),
    )


def frame_unpivot(s, d):
    return TS.unpivot_cameras(_wide(s, d)).select("episode_id", "frame_index", "camera", "image_relpath", "source_age_ms")


def frame_pair_pivot(s, d):
    rows = TS.unpivot_cameras(_wide(s, d)).where("not (camera = 'wrist' and frame_index % 10 = 9)")
    return TS.pair_cameras(rows).select("episode_id", "frame_index", F.col("front.image_relpath").alias("front"), F.col("wrist.image_relpath").alias("wrist"), "complete")


def episode_digest(s, d):
    rows = TS.unpivot_cameras(_wide(s, d)).withColumn("image_sha256", F.sha2("image_relpath", 256))
    return TS.episode_digest(rows)


def label_bounds_check(s, d):
    x = V.samples(s, d)
    return I.uncovered_bounds(V.annotated(x), x.where("frame_index % 7 <> 0"))


METRICS = ("recall", "mean_iou", "median_iou", "recall_at_0_10", "recall_at_0_25", "recall_at_0_50", "mean_onset_error", "mean_offset_error")
S = f"WITH {V.SAMPLES}"
SLICES = """sl AS (SELECT *, floor(timestamp_sec / 86400.0::DOUBLE)::BIGINT AS slice_index FROM sc),
mid AS (SELECT *, (slice_index + 0.5::DOUBLE) * 86400.0::DOUBLE AS middle FROM sl),
sr AS (SELECT episode_id, slice_index, min(frame_index) AS f0, max(frame_index) + 1 AS f1, arg_min(frame_index, (abs(timestamp_sec - middle), frame_index)) AS mf,
  arg_min(timestamp_sec, (abs(timestamp_sec - middle), frame_index)) AS mt, min(abs(timestamp_sec - middle)) * 1000 AS err FROM mid GROUP BY episode_id, slice_index)"""
BEST = "bs AS (SELECT episode_id, slice_index, arg_max(frame_index, (fused, -frame_index)) AS bf, arg_max(timestamp_sec, (fused, -frame_index)) AS bt, max(fused) AS score FROM sl GROUP BY episode_id, slice_index)"


def _cover(points: str, name: str) -> str:
    return f"""{name} AS (SELECT event_id, an.episode_id, coalesce(sum((p.f BETWEEN start_frame AND end_frame)::INT), 0) AS n_inside,
  arg_min(p.f, (abs(p.t - center_sec), p.f)) AS nf, min(abs(p.t - center_sec)) * 1000 AS ms FROM an LEFT JOIN ({points}) p ON an.episode_id = p.episode_id GROUP BY event_id, an.episode_id)"""


COVER = _cover("SELECT episode_id, mf AS f, mt AS t FROM sr", "cv")


def _nms(score: str, k: int, name: str) -> str:
    return f"""{name}_ AS (SELECT episode_id, list_reduce(list({{'neg': -{score}, 'frame': frame_index}} ORDER BY -{score}, frame_index),
  lambda acc, x: CASE WHEN len(acc) < {k} AND len(list_filter(acc, lambda t: abs(t.frame - x.frame) < 5)) = 0 THEN list_append(acc, x) ELSE acc END,
  []::STRUCT(neg DOUBLE, frame INT)[]) AS xs FROM sc GROUP BY episode_id),
{name} AS (SELECT episode_id, unnest(range(1, len(xs) + 1)) AS rank, unnest(list_transform(xs, lambda t: t.frame)) AS frame_index, unnest(list_transform(xs, lambda t: -t.neg)) AS score FROM {name}_)"""


PK = _nms("fused", 3, "pk")
UNIFORM = "SELECT DISTINCT episode_id, CASE WHEN n_frames <= {c} THEN i ELSE round_even(i * (n_frames - 1) / {m}::DOUBLE, 0)::INT END AS frame_index FROM (SELECT *, unnest(range(0, CASE WHEN n_frames <= {c} THEN n_frames ELSE {c} END)) AS i FROM n)"
PROP = "pr AS (SELECT pk.episode_id, r AS radius_frames, frame_index AS center_frame, greatest(0, frame_index - r) AS start_frame, least(n_frames - 1, frame_index + r) AS end_frame FROM pk JOIN n ON pk.episode_id = n.episode_id, (SELECT unnest([1, 3, 5, 10, 15]) AS r))"
OVER = """pp AS (SELECT event_id, mode, an.start_frame AS g0, an.end_frame AS g1, radius_frames, center_frame, pr.start_frame AS p0, pr.end_frame AS p1,
  greatest(0, least(an.end_frame, pr.end_frame) - greatest(an.start_frame, pr.start_frame) + 1) AS i FROM an JOIN pr ON an.episode_id = pr.episode_id),
iu AS (SELECT *, i::DOUBLE / ((g1 - g0 + 1) + (p1 - p0 + 1) - i) AS iou FROM pp),
bo AS (SELECT event_id, mode, radius_frames, center_frame AS best_center_frame, p0 AS best_start_frame, p1 AS best_end_frame, iou AS best_iou, iou > 0 AS overlap_hit, abs(p0 - g0) AS onset_error, abs(p1 - g1) AS offset_error
  FROM iu QUALIFY row_number() OVER (PARTITION BY event_id, radius_frames ORDER BY iou DESC, abs(center_frame - (g0 + g1) / 2.0::DOUBLE), center_frame, p0, p1) = 1)"""
BLOCK = """count(*) AS n_events, round(avg(overlap_hit::INT), 6) AS recall, round(avg(best_iou), 6) AS mean_iou, round(median(best_iou), 6) AS median_iou, round(avg((best_iou >= 0.1)::INT), 6) AS recall_at_0_10,
  round(avg((best_iou >= 0.25)::INT), 6) AS recall_at_0_25, round(avg((best_iou >= 0.5)::INT), 6) AS recall_at_0_50, round(avg(onset_error), 6) AS mean_onset_error, round(avg(offset_error), 6) AS mean_offset_error"""
KEYS = """kf AS (SELECT kk.k, kk.rank AS keyframe_rank, episode_id, slice_index, arg_min(frame_index, (abs(timestamp_sec - (slice_index + kk.rank / (kk.k + 1)::DOUBLE) * 86400.0::DOUBLE), frame_index)) AS f
  FROM sl, (SELECT k, unnest(range(1, k + 1)) AS rank FROM (SELECT unnest([1, 2, 3]) AS k)) kk GROUP BY ALL)"""
WIDE = "w AS (SELECT episode_id, frame_index, 'front' AS camera, 'front/' || frame_index || '.jpg' AS image_relpath, value AS source_age_ms FROM s UNION ALL SELECT episode_id, frame_index, 'wrist', 'wrist/' || frame_index || '.jpg', k FROM s)"

QUERIES = {f.__name__: f for f in (signal_change_scores, signal_query_topk, tumbling_slices_midpoint, midpoint_error_summary, argmax_per_slice, multi_keyframe_k123, density_marginals, strided_motion, dominant_channel, event_coverage_range_join, nearest_sample_join, coverage_summary, method_comparison, uniform_anchors, nms_peaks, review_candidates, point_interval_distance, interval_proposals, best_iou_per_event, interval_metrics_rollup, radius_grid_search, contiguity_check, frame_unpivot, frame_pair_pivot, episode_digest, label_bounds_check)}
ORACLE_SQL = {
    "signal_change_scores": f"{S} SELECT episode_id, frame_index, round(state_change_rms, 6) AS state_change_rms, round(action_change_rms, 6) AS action_change_rms, round(tracking_gap_rms, 6) AS tracking_gap_rms, round(fused, 6) AS fused_state_action_score FROM sc",
    "signal_query_topk": f"{S} SELECT episode_id, frame_index, round(sqrt(t2 * t2 / 1), 6) AS raw_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY sqrt(t2 * t2 / 1) DESC, frame_index) AS rank FROM sc) WHERE rank <= 3",
    "tumbling_slices_midpoint": f"{S}, {SLICES} SELECT episode_id, slice_index, slice_index * 86400.0::DOUBLE AS start_sec, (slice_index + 1) * 86400.0::DOUBLE AS end_sec, f0 AS start_frame_index, f1 AS end_frame_index_exclusive, mf AS midpoint_frame_index, round(err, 3) AS midpoint_error_ms FROM sr",
    "midpoint_error_summary": f"{S}, {SLICES} SELECT round(avg(err), 3) AS mean_ms, round(max(err), 3) AS max_ms, count(*) AS n_slices FROM sr",
    "argmax_per_slice": f"{S}, {SLICES}, {BEST} SELECT episode_id, slice_index, bf AS selected_frame_index, round(score, 6) AS score FROM bs",
    "multi_keyframe_k123": f"{S}, {SLICES}, {KEYS} SELECT k, episode_id, slice_index, keyframe_rank, f AS selected_frame_index, len(list_distinct(list(f) OVER (PARTITION BY k, episode_id, slice_index))) = k AS distinct_frames FROM kf",
    "density_marginals": f"""{S}, {SLICES}, {KEYS}, h AS (SELECT k, event_id, max((f BETWEEN start_frame AND end_frame)::INT) AS hit FROM an JOIN kf ON an.episode_id = kf.episode_id GROUP BY k, event_id),
c AS (SELECT k, avg(hit) AS coverage FROM h GROUP BY k) SELECT k, round(coverage, 9) AS coverage, round(coverage - lag(coverage) OVER (ORDER BY k), 9) AS marginal FROM c""",
    "strided_motion": f"""{S}, st AS (SELECT s.*, n_frames FROM s JOIN n ON s.episode_id = n.episode_id WHERE frame_index % 3 = 0 OR frame_index = n_frames - 1),
l AS (SELECT *, lag(o1) OVER w AS p1, lag(o2) OVER w AS p2 FROM st WINDOW w AS (PARTITION BY episode_id ORDER BY frame_index))
SELECT episode_id, frame_index, round(CASE WHEN p1 IS NULL THEN 0.0::DOUBLE ELSE (abs(p1 - o1) + abs(p2 - o2)) / 2 END, 6) AS motion_score FROM l""",
    "dominant_channel": f"{S} SELECT CASE WHEN state_change_rms > action_change_rms THEN 'state' WHEN state_change_rms < action_change_rms THEN 'action' ELSE 'tie' END AS channel, count(*) AS n FROM sc GROUP BY 1",
    "event_coverage_range_join": f"{S}, {SLICES}, {COVER} SELECT event_id, n_inside::BIGINT AS n_inside, n_inside > 0 AS covered FROM cv",
    "nearest_sample_join": f"{S}, {SLICES}, {COVER} SELECT event_id, nf AS nearest_frame, round(ms, 3) AS nearest_ms FROM cv",
    "coverage_summary": f"{S}, {SLICES}, {COVER} SELECT count(*) AS verified_events, sum((n_inside > 0)::INT)::BIGINT AS covered_events, round(avg((n_inside > 0)::INT), 9) AS event_coverage, round(avg(ms), 2) AS mean_distance_ms FROM cv",
    "method_comparison": f"""{S}, {SLICES}, {BEST}, {COVER}, {_cover("SELECT episode_id, bf AS f, bt AS t FROM bs", "cb")}
SELECT cv.event_id, cv.n_inside > 0 AS by_midpoint, cb.n_inside > 0 AS by_change, (cb.n_inside > 0)::INT - (cv.n_inside > 0)::INT AS delta FROM cv JOIN cb ON cv.event_id = cb.event_id""",
    "uniform_anchors": f"{S} {UNIFORM.format(c=7, m=6)}",
    "nms_peaks": f"{S}, {PK} SELECT episode_id, rank, frame_index, round(score, 6) AS score FROM pk",
    "review_candidates": f"""{S}, {PK}, {_nms('tracking_gap_rms', 2, 'gp')}, al AS ({UNIFORM.format(c=3, m=2).replace('SELECT DISTINCT episode_id,', "SELECT DISTINCT episode_id, 'uniform_anchor' AS reason, 1000.0::DOUBLE AS priority,")}
  UNION ALL SELECT episode_id, 'state_action_change', 900.0 - rank, frame_index FROM pk UNION ALL SELECT episode_id, 'tracking_gap', 700.0 - rank, frame_index FROM gp),
c AS (SELECT episode_id, frame_index, string_agg(DISTINCT reason, '|' ORDER BY reason) AS reasons, max(priority) AS best_priority, bool_or(reason = 'uniform_anchor') AS fixed FROM al GROUP BY episode_id, frame_index),
r AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY fixed DESC, CASE WHEN NOT fixed THEN -best_priority END NULLS FIRST, frame_index) AS pos FROM c)
SELECT episode_id, frame_index, reasons, best_priority FROM r WHERE fixed OR pos <= 6""",
    "point_interval_distance": f"""{S}, {PK}, d AS (SELECT event_id, an.episode_id, frame_index, greatest(start_frame - frame_index, frame_index - end_frame, 0) AS d FROM an JOIN pk ON an.episode_id = pk.episode_id),
b AS (SELECT event_id, episode_id, min(d) AS m, arg_min(frame_index, (d, frame_index)) AS f, count(DISTINCT CASE WHEN d = 0 THEN frame_index END) AS c FROM d GROUP BY event_id, episode_id)
SELECT event_id, episode_id, m AS min_frame_distance, f AS closest_frame, c AS n_inside, m = 0 AS exact_hit, m <= 0 AS hit_within_0, m <= 5 AS hit_within_5, m <= 15 AS hit_within_15 FROM b""",
    "interval_proposals": f"{S}, {PK}, {PROP} SELECT * FROM pr",
    "best_iou_per_event": f"{S}, {PK}, {PROP}, {OVER} SELECT event_id, radius_frames, best_center_frame, best_start_frame, best_end_frame, round(best_iou, 9) AS best_iou, overlap_hit, onset_error, offset_error FROM bo",
    "interval_metrics_rollup": f"{S}, {PK}, {PROP}, {OVER} SELECT mode, {BLOCK} FROM bo WHERE radius_frames = 5 GROUP BY GROUPING SETS ((), (mode))",
    "radius_grid_search": f"""{S}, {PK}, {PROP}, {OVER}, g AS (SELECT radius_frames, {BLOCK} FROM bo GROUP BY radius_frames)
SELECT *, row_number() OVER (ORDER BY recall DESC, recall_at_0_25 DESC, mean_iou DESC, radius_frames) = 1 AS selected FROM g""",
    "contiguity_check": f"""{S}, c AS (SELECT *, frame_index - coalesce(lag(frame_index) OVER w, -1) AS step, coalesce(timestamp_sec > lag(timestamp_sec) OVER w, true) AS rise FROM s WINDOW w AS (PARTITION BY episode_id ORDER BY frame_index))
SELECT episode_id, count(*) AS n_frames, bool_and(step = 1) AS contiguous, bool_and(rise) AS increasing FROM c GROUP BY episode_id""",
    "frame_unpivot": f"{S}, {WIDE} SELECT * FROM w",
    "frame_pair_pivot": f"""{S}, {WIDE} SELECT episode_id, frame_index, max(CASE WHEN camera = 'front' THEN image_relpath END) AS front, max(CASE WHEN camera = 'wrist' THEN image_relpath END) AS wrist, count(*) = 2 AS complete
FROM w WHERE NOT (camera = 'wrist' AND frame_index % 10 = 9) GROUP BY episode_id, frame_index""",
    "episode_digest": f"{S}, {WIDE} SELECT episode_id, sha256(string_agg(camera || ',' || frame_index || ',' || sha256(image_relpath), chr(10) ORDER BY camera, frame_index) || chr(10)) AS episode_sha256 FROM w GROUP BY episode_id",
    "label_bounds_check": f"""{S}, b AS (SELECT DISTINCT event_id, episode_id, unnest([start_frame, end_frame]) AS frame_index FROM an)
SELECT event_id, b.frame_index FROM b ANTI JOIN (SELECT * FROM s WHERE frame_index % 7 <> 0) f ON b.episode_id = f.episode_id AND b.frame_index = f.frame_index""",
}
