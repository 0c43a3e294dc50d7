"""Review packs of every case over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review_pages as P
from ..operators import timeseries as TS
from . import cases, episodes
from . import views as V

JOINTS = ("wrist", "gripper")


def _packs(s, d):
    """The recording of an anomaly is that of user episode_id % 15, whom every table has."""
    samples, reviews = V.samples(s, d), cases._cases(s, d)
    e = F.col("episode_id")
    metrics = F.create_map(F.lit("fused_state_action_score"), F.col("fused_state_action_score"), F.lit("tracking_gap_rms"), F.col("tracking_gap_rms"))
    picked = TS.change_scores(samples).join(episodes._candidates(s, d), ["episode_id", "frame_index"]).withColumn("metrics", metrics)
    picked = picked.withColumnRenamed("episode_id", "user_id").join(reviews.select("episode_id", (e % 15).alias("user_id")), "user_id")
    failed = F.when(e % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("age"), F.lit("count")))
    audit = cases._audit(s, d).withColumns({"source_status": F.when(e % 2 == 0, "pass").otherwise('a < b & "c"'), "source_overall_pass": e % 3 == 0, "source_failed_checks": failed})
    bound = audit.where(e % 4 == 0).withColumns({"source_status": F.lit("bound"), "source_overall_pass": F.lit(True), "source_failed_checks": F.array().cast("array<string>")})
    return P.packs(reviews, audit, picked, JOINTS, bound)


def review_packs(s, d):
    return _packs(s, d).select(
        "episode_id", "original_failure_reason", F.array_join("observed_failure_modes", "|").alias("modes"), "event_count", F.array_join(F.col("frames").cast("array<string>"), ",").alias("frames"), "selected_frame_count",
        "source_status", "source_overall_pass", F.array_join("source_failed_checks", "|").alias("failed_checks"), "all_draft", "all_unset", "html",
    )


def review_index(s, d):
    return P.index_lines(_packs(s, d))


def review_manifest(s, d):
    return P.manifest(_packs(s, d)).withColumn("non_claims", F.size("non_claims"))


def gripper_action_delta(s, d):
    return TS.channel_change(V.samples(s, d), "action", 1).select("episode_id", "frame_index", F.round("change", 6).alias("change"))


CARD = """'<section id="frame-' || frame_index || '"><h2>Frame ' || frame_index || ' at ' || printf('%.6f', timestamp_sec) || ' s</h2><p>Picked by: ' || replace(reasons, '|', ', ') ||
  '</p><p>Metrics: fused_state_action_score=' || printf('%.5f', fused) || '; tracking_gap_rms=' || printf('%.5f', tracking_gap_rms) ||
  '</p><table><tr><th>joint</th><th>observation</th><th>action</th><th>tracking error</th></tr>' ||
  '<tr><td>wrist</td><td>' || printf('%.4f', o1) || '</td><td>' || printf('%.4f', a1) || '</td><td>' || printf('%.4f', t1) || '</td></tr>' ||
  '<tr><td>gripper</td><td>' || printf('%.4f', o2) || '</td><td>' || printf('%.4f', a2) || '</td><td>' || printf('%.4f', t2) || '</td></tr></table></section>'"""
PACKS = f"""WITH cand AS ({episodes.ORACLE_SQL["review_candidates"]}), score AS (WITH {V.SAMPLES} SELECT * FROM sc),
card AS (SELECT cand.episode_id, string_agg({CARD}, '' ORDER BY cand.frame_index) AS cards, string_agg(cand.frame_index::VARCHAR, ',' ORDER BY cand.frame_index) AS frames, count(*)::INT AS nf
  FROM cand JOIN score USING (episode_id, frame_index) GROUP BY cand.episode_id),
rev AS (WITH {cases.AU}, le AS (SELECT episode_id, string_agg('<li>' || event_id || ': ' || m || '</li>', '' ORDER BY event_id) AS li, count(*)::INT AS ne FROM ev GROUP BY episode_id)
  SELECT rc.episode_id, ts, reason, modes, li, ne FROM rc JOIN le ON rc.episode_id = le.episode_id),
pk AS (SELECT rev.*, coalesce(cards, '') AS cards, coalesce(frames, '') AS frames, coalesce(nf, 0) AS nf, rev.episode_id % 4 = 0 AS b, b OR rev.episode_id % 3 = 0 AS passed,
  CASE WHEN b THEN 'bound' WHEN rev.episode_id % 2 = 0 THEN 'pass' ELSE 'a < b & "c"' END AS status FROM rev LEFT JOIN card ON rev.episode_id % 15 = card.episode_id),
pa AS (SELECT *, replace(replace(replace(status, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') AS safe FROM pk)"""

QUERIES = {f.__name__: f for f in (review_packs, review_index, review_manifest, gripper_action_delta)}
ORACLE_SQL = {
    "review_packs": f"""{PACKS} SELECT episode_id, reason AS original_failure_reason, modes, ne AS event_count, frames, nf AS selected_frame_count, status AS source_status, passed AS source_overall_pass,
  CASE WHEN passed THEN '' ELSE 'age|count' END AS failed_checks, true AS all_draft, true AS all_unset,
  '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Review of ' || episode_id || '</title></head><body><h1>Review of ' || episode_id ||
  '</h1><p>Find an interval for each event on its own; the label at the source is no diagnosis.</p><dl><dt>task success</dt><dd>' || ts || '</dd><dt>failure reason</dt><dd>' || reason ||
  '</dd><dt>source status</dt><dd>' || safe || '</dd><dt>source passed</dt><dd>' || passed || '</dd><dt>failed checks</dt><dd>' || CASE WHEN passed THEN 'none' ELSE 'age, count' END ||
  '</dd><dt>frames</dt><dd>' || nf || '</dd></dl><ul>' || li || '</ul>' || cards || '</body></html>' AS html FROM pa""",
    "review_index": f"""{PACKS} SELECT 1 AS part, episode_id, '<tr><td><a href="' || episode_id || '/review.html">' || episode_id || '</a></td><td>' || reason || '</td><td>' || replace(modes, '|', ', ') || '</td><td>' || ne ||
  '</td><td>' || nf || '</td><td>' || safe || '</td></tr>' AS line FROM pa UNION ALL SELECT 0, NULL, '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Reviews</title></head><body><h1>Reviews</h1><table>' ||
  '<tr><th>episode</th><th>failure reason</th><th>observed modes</th><th>events</th><th>frames</th><th>source status</th></tr>' UNION ALL SELECT 2, NULL, '</table></body></html>'""",
    "review_manifest": f"{PACKS} SELECT count(*) AS pack_count, coalesce(sum(ne), 0)::BIGINT AS event_count, count(*) FILTER (ne > 1) AS multi_event_count, true AS all_unset, 3 AS non_claims FROM pa",
    "gripper_action_delta": f"WITH {V.SAMPLES} SELECT episode_id, frame_index, round(coalesce(abs(a2 - pa2), 0), 6) AS change FROM lagged",
}
