"""Time series of episodes: change scores, tumbling slices, keyframes, motion, peak selection.

Lags are taken over the whole episode before anything is cut into slices, so a
slice's first frame is scored against its true predecessor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric as N


def by_frame() -> Window:
    return Window.partitionBy("episode_id").orderBy("frame_index")


def change_scores(samples: DataFrame) -> DataFrame:
    """Samples (episode_id, frame_index, timestamp_sec, observation, action, tracking_error as arrays) with change scores.

    state and action changes are RMS differences from the frame before (0 for
    the first), fused is the larger; tracking_gap_rms is of the frame itself.
    """
    w = by_frame()

    def change(c: str) -> Column:
        before = F.lag(c).over(w)
        return F.when(before.isNull(), F.lit(0.0)).otherwise(N.rms(N.subtract(F.col(c), F.coalesce(before, F.col(c)))))

    return samples.withColumns(
        {"state_change_rms": change("observation"), "action_change_rms": change("action"), "tracking_gap_rms": N.rms(F.col("tracking_error"))}
    ).withColumn("fused_state_action_score", F.greatest("state_change_rms", "action_change_rms"))


def channel_change(samples: DataFrame, column: str, position: int) -> DataFrame:
    """(episode_id, frame_index, change): the absolute difference of one channel (position from 0) from the frame before; 0 for the first frame."""
    value = F.get(F.col(column), F.lit(position))
    before = F.lag(value).over(by_frame())
    return samples.select("episode_id", "frame_index", F.abs(value - F.coalesce(before, value)).alias("change"))


def profile(query_tokens: list[str], joints: list[str]) -> tuple[list[str], list[str]]:
    """The joints and signals that a query names, in canonical order; all joints, and observation and action, if it names none."""
    signals = ["observation", "action", "tracking_error"]
    return [j for j in joints if j in query_tokens] or list(joints), [s for s in signals if s in query_tokens] or signals[:2]


def signal_search(samples: DataFrame, joints: list[str], signals: list[str], canonical: list[str], top_k: int = 5) -> DataFrame:
    """The frames of each episode by (-score, frame): score is the largest RMS over the chosen joints of the chosen signals."""
    at = [canonical.index(j) for j in joints]
    w = by_frame()

    def pick(c: Column) -> Column:
        return F.array(*[c[k] for k in at])

    def score(s: str) -> Column:
        if s == "tracking_error":
            return N.rms(pick(F.col(s)))
        before = F.lag(s).over(w)
        return F.when(before.isNull(), F.lit(0.0)).otherwise(N.rms(N.subtract(pick(F.col(s)), pick(F.coalesce(before, F.col(s))))))

    scored = samples.select("episode_id", "frame_index", "timestamp_sec", *[score(s).alias(f"s_{s}") for s in signals])
    best = F.greatest(*[F.col(f"s_{s}") for s in signals]) if len(signals) > 1 else F.col(f"s_{signals[0]}")
    by = F.map_from_arrays(F.array(*[F.lit(s) for s in signals]), F.array(*[F.col(f"s_{s}") for s in signals]))
    rows = scored.select("episode_id", "frame_index", "timestamp_sec", best.alias("raw_score"), by.alias("signal_scores"))
    order = Window.partitionBy("episode_id").orderBy(F.desc("raw_score"), "frame_index")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def tumbling_slices(frames: DataFrame, duration: float, on_empty: str = "error") -> DataFrame:
    """Half-open slices [i*d, (i+1)*d) of each episode with first and last frame and the frame nearest to the middle.

    Ties go to the lower frame. A slice without frames between others is an
    error, or left out with ``on_empty='skip'``.
    """
    if duration <= 0 or on_empty not in ("error", "skip"):
        raise ValueError("duration must be positive and on_empty 'error' or 'skip'")
    i = F.floor(F.col("timestamp_sec") / F.lit(float(duration))).cast("long")
    cut = frames.withColumn("slice_index", i).withColumn("middle", (F.col("slice_index") + 0.5) * F.lit(float(duration)))
    best = F.min(F.struct(F.abs(F.col("timestamp_sec") - F.col("middle")).alias("d"), F.col("frame_index").alias("frame"), F.col("timestamp_sec").alias("ts")))
    out = cut.groupBy("episode_id", "slice_index").agg(
        F.min("frame_index").alias("start_frame_index"), (F.max("frame_index") + 1).alias("end_frame_index_exclusive"),
        F.first("middle").alias("midpoint_target_sec"), best.alias("best"),
    )
    out = out.select(
        "episode_id", "slice_index", (F.col("slice_index") * float(duration)).alias("start_sec"), ((F.col("slice_index") + 1) * float(duration)).alias("end_sec"),
        "start_frame_index", "end_frame_index_exclusive", "midpoint_target_sec", F.col("best.frame").alias("midpoint_frame_index"),
        F.col("best.ts").alias("midpoint_timestamp_sec"), (F.col("best.d") * 1000.0).alias("midpoint_error_ms"),
    )
    if on_empty == "error":
        before = F.coalesce(F.lag("slice_index").over(Window.partitionBy("episode_id").orderBy("slice_index")), F.lit(-1))
        bad = F.col("slice_index") != before + 1
        out = out.withColumn("slice_index", F.when(bad, F.raise_error(F.lit("a slice has no frames")).cast("long")).otherwise(F.col("slice_index")))
    return out


def select_best(scores: DataFrame, score: str, duration: float) -> DataFrame:
    """The frame with the largest score of each slice; ties go to the lower frame."""
    i = F.floor(F.col("timestamp_sec") / F.lit(float(duration))).cast("long")
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col("frame_index")).alias("neg"), F.col("timestamp_sec").alias("ts")))
    return scores.withColumn("slice_index", i).groupBy("episode_id", "slice_index").agg(best.alias("b")).select(
        "episode_id", "slice_index", (-F.col("b.neg")).alias("selected_frame_index"), F.col("b.ts").alias("selected_timestamp_sec"), F.col("b.s").alias("score")
    )


def multi_keyframes(frames: DataFrame, duration: float, k: int) -> DataFrame:
    """The k frames nearest to the interior quantiles of each slice's time; ties go to the lower frame.

    ``distinct_frames`` says whether the k frames differ, which the contract requires.
    """
    parts = F.array(*[F.struct(F.lit(r).alias("keyframe_rank"), F.lit(f).alias("target_fraction")) for r, f in enumerate(N.interior_fractions(k), 1)])
    i = F.floor(F.col("timestamp_sec") / F.lit(float(duration))).cast("long")
    rows = frames.withColumn("slice_index", i).select("episode_id", "slice_index", "frame_index", "timestamp_sec", F.inline(parts))
    target = (F.col("slice_index") + F.col("target_fraction")) * F.lit(float(duration))
    best = F.min(F.struct(F.abs(F.col("timestamp_sec") - target).alias("d"), F.col("frame_index").alias("frame"), F.col("timestamp_sec").alias("ts")))
    out = rows.groupBy("episode_id", "slice_index", "keyframe_rank", "target_fraction").agg(best.alias("b"))
    w = Window.partitionBy("episode_id", "slice_index")
    return out.select(
        "episode_id", "slice_index", "keyframe_rank", "target_fraction", F.col("b.frame").alias("selected_frame_index"), F.col("b.ts").alias("selected_timestamp_sec"),
        (F.col("b.d") * 1000.0).alias("selection_error_ms"), (F.size(F.collect_set(F.col("b.frame")).over(w)) == k).alias("distinct_frames"),
    )


def strided_motion(frames: DataFrame, stride: int, pixels: str = "pixels") -> DataFrame:
    """Mean absolute difference from the frame before among every ``stride``-th frame and the last; 0 for the first."""
    last = F.max("frame_index").over(Window.partitionBy("episode_id"))
    kept = frames.withColumn("last", last).where((F.col("frame_index") % stride == 0) | (F.col("frame_index") == F.col("last")))
    before = F.lag(pixels).over(by_frame())
    score = F.when(before.isNull(), F.lit(0.0)).otherwise(N.mean_absolute_difference(F.coalesce(before, F.col(pixels)), F.col(pixels)))
    return kept.select("episode_id", "frame_index", "timestamp_sec", score.alias("motion_score"))


def peaks(scores: DataFrame, score: str, top_k: int, min_separation: int) -> DataFrame:
    """Greedy non-maximum suppression of each episode: (episode_id, rank, frame_index, score).

    An episode's frames are one bounded recording; they meet in one array.
    """
    listed = scores.groupBy("episode_id").agg(F.collect_list(F.struct(F.col(score).cast("double").alias("score"), F.col("frame_index").cast("int").alias("frame"))).alias("xs"))
    return listed.select("episode_id", F.posexplode(N.top_peaks(F.col("xs"), top_k, min_separation)).alias("pos", "x")).select(
        "episode_id", (F.col("pos") + 1).alias("rank"), F.col("x.frame").alias("frame_index"), F.col("x.score").alias("score")
    )


def uniform_anchors(frames: DataFrame, count: int) -> DataFrame:
    """(episode_id, frame_index) of frames spread evenly over each episode."""
    n = frames.groupBy("episode_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return n.select("episode_id", F.explode(N.uniform_indices(F.col("n"), count)).alias("frame_index"))


def review_candidates(frames: DataFrame, ranked: dict[str, tuple[DataFrame, float]], uniform_count: int, cap: int) -> DataFrame:
    """Union of selectors for each frame, with its reasons and best priority.

    Uniform anchors are always kept; the others fill the cap by (-priority, frame).
    ranked: for each reason its peaks and base priority, from which the rank is taken off.
    """
    if cap < uniform_count:
        raise ValueError("the cap must hold the uniform anchors")
    rows = uniform_anchors(frames, uniform_count).select("episode_id", "frame_index", F.lit("uniform_anchor").alias("reason"), F.lit(1000.0).alias("priority"))
    for reason, (found, base) in ranked.items():
        rows = rows.unionByName(found.select("episode_id", "frame_index", F.lit(reason).alias("reason"), (F.lit(float(base)) - F.col("rank")).alias("priority")))
    per = rows.groupBy("episode_id", "frame_index").agg(F.array_sort(F.collect_set("reason")).alias("reasons"), F.max("priority").alias("best_priority"))
    per = per.withColumn("fixed", F.array_contains("reasons", "uniform_anchor"))
    w = Window.partitionBy("episode_id")
    order = w.orderBy(F.desc("fixed"), F.when(~F.col("fixed"), -F.col("best_priority")), "frame_index")
    n_fixed = F.sum(F.col("fixed").cast("int")).over(w)
    kept = per.withColumn("n", F.row_number().over(order)).withColumn("n_fixed", n_fixed)
    return kept.where(F.col("fixed") | (F.col("n") <= cap)).select("episode_id", "frame_index", "reasons", "best_priority")


def contiguity(frames: DataFrame) -> DataFrame:
    """For each episode: are frames 0..n-1 without gaps, and does the clock rise strictly?"""
    w = by_frame()
    checked = frames.withColumn("step", F.col("frame_index") - F.coalesce(F.lag("frame_index").over(w), F.lit(-1))).withColumn(
        "rise", F.coalesce(F.col("timestamp_sec") > F.lag("timestamp_sec").over(w), F.lit(True))
    )
    return checked.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_frames"), F.every(F.col("step") == 1).alias("contiguous"), F.every("rise").alias("increasing"))


def unpivot_cameras(samples: DataFrame) -> DataFrame:
    """One row for each frame and camera (front, wrist) from columns front_image, wrist_image, front_age_ms and wrist_age_ms."""
    pair = F.array(*[F.struct(F.lit(c).alias("camera"), F.col(f"{c}_image").alias("image_relpath"), F.col(f"{c}_age_ms").alias("source_age_ms")) for c in ("front", "wrist")])
    return samples.select("episode_id", "frame_index", "timestamp_sec", F.inline(pair))


def pair_cameras(records: DataFrame) -> DataFrame:
    """Camera records as one row a frame with front and wrist, and whether the pair is complete and shares a time."""
    cell = F.struct("image_relpath", "timestamp_sec")
    wide = records.groupBy("episode_id", "frame_index").agg(
        *[F.max(F.when(F.col("camera") == c, cell)).alias(c) for c in ("front", "wrist")], F.count(F.lit(1)).alias("n_records")
    )
    whole = F.col("front").isNotNull() & F.col("wrist").isNotNull() & (F.col("n_records") == 2)
    same = F.abs(F.col("front.timestamp_sec") - F.col("wrist.timestamp_sec")) <= 1e-12
    return wide.withColumn("complete", whole & F.coalesce(same, F.lit(False)))


def episode_digest(records: DataFrame, digest: str = "image_sha256") -> DataFrame:
    """An order-independent digest of each episode: its (camera, frame, hash) lines in order, each with a line end."""
    lines = F.array_sort(F.collect_list(F.struct("camera", "frame_index", F.col(digest).alias("h"))))
    text = F.concat(F.array_join(F.transform(lines, lambda x: F.concat_ws(",", x["camera"], x["frame_index"].cast("string"), x["h"])), "\n"), F.lit("\n"))
    return records.groupBy("episode_id").agg(F.sha2(text, 256).alias("episode_sha256"))
