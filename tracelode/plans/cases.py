"""Case packs, reviews, artifacts and the canonical path over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import artifacts as A
from ..operators import evidence as E
from ..operators import intervals as I
from ..operators import pack as K
from ..operators import reviews as W
from ..operators import timeseries as TS
from . import canonical, curation, episodes, retrieval
from . import views as V

PAGE = ["source_id", "page_number"]


def _audit(s, d):
    e = F.col("episode_id")
    flags = {c: (e % (k + 19) != 0) for k, c in enumerate(W.PRESENCE)}
    return curation._audit(s, d).withColumns({"task_success": e % 2 == 0, "operation_anomaly": F.col("audit_category") == "operation_anomaly"} | flags)


def source_presence(s, d):
    return _audit(s, d).select("episode_id", W.presence_complete().alias("complete"))


def anomaly_presence(s, d):
    return W.anomalies_present(_audit(s, d))


def _cases(s, d):
    return W.review_cases(_audit(s, d), "manifests", "processed")


def review_cases(s, d):
    c = F.col("events")
    return _cases(s, d).select(
        "review_id", "episode_id", "task_success", "original_failure_reason", F.array_join(W.observed_failure_modes(c), "|").alias("modes"), W.all_events_draft(c).alias("all_draft"),
        W.all_diagnoses_unset(c).alias("all_unset"), W.review_complete(c).alias("complete"), "diagnostic_manifest_path", "diagnostic_frames_path",
    )


def review_events(s, d):
    return W.flatten_events(W.review_template(_cases(s, d))).select("event_id", "review_id", "episode_id", "observed_failure_mode", "event_status")


def review_preservation(s, d):
    a = _audit(s, d)
    e = F.col("episode_id")
    changed = a.where(e % 7 != 0).withColumn("task_success", F.when(e % 9 == 0, ~F.col("task_success")).otherwise(F.col("task_success")))
    return W.preservation(a, changed, ["task_success", "failure_reason"])


def _seeds(s, d):
    best = episodes._overlap(s, d).where("radius_frames = 5")
    results = best.select("event_id", "episode_id", F.col("best_start_frame").alias("start_frame"), F.col("best_center_frame").alias("center_frame"), F.col("best_end_frame").alias("end_frame"))
    return K.case_seeds(results, episodes._proposals(s, d).where("radius_frames = 5"))


def case_seed_frames(s, d):
    return K.case_frames(_seeds(s, d))


def case_universe(s, d):
    return K.universe_gaps(_seeds(s, d), V.annotated(V.samples(s, d)).where("event_id % 6 <> 0"), "event_id")


def case_bundles(s, d):
    first = retrieval.bm25_topk(s, d).where("item_id = 1 and rank <= 3").select(*PAGE, F.col("rank").alias("position"))
    pages = V.pages(s, d).join(first.select(*PAGE), PAGE, "left_semi").withColumns(X.page_columns(F.col("text")))
    docs = E.page_items(pages).join(first, PAGE).select("position", "item")
    b = K.case_bundles(_seeds(s, d), E.sample_items(V.samples(s, d)), docs, "what happened?")
    items = F.col("items")
    names = F.array(*[F.lit(n) for n in K.case_shape_rules(3, 3)])
    kept = F.array(*list(K.case_shape_rules(3, 3).values()))
    broken = F.array_join(F.transform(F.filter(F.arrays_zip(names.alias("n"), kept.alias("k")), lambda x: ~x["k"]), lambda x: x["n"]), ",")
    return b.select(
        "event_id", "bundle_id", F.array_join(F.transform(items, lambda i: i["evidence_id"]), "|").alias("evidence"), F.size(K.robot_items(items)).alias("n_robots"),
        F.size(K.allowed_keys(items)).alias("n_refs"), K.count_visual_inputs(items, F.lit(True)).alias("visual_inputs"), F.col("readiness.decision").alias("decision"), broken.alias("violations"),
    )


def generation_refs(s, d):
    pages = V.pages(s, d).withColumns(X.page_columns(F.col("text")))
    x = V.samples(s, d)
    sample = E.sample_items(x).join(x.select("episode_id", "frame_index", "event_id"), ["episode_id", "frame_index"]).select("event_id", "item")
    one, two = sample.select(F.col("event_id").alias("page_number"), F.col("item").alias("i1")), sample.select((F.col("event_id") - 1).alias("page_number"), F.col("item").alias("i2"))
    rows = E.page_items(pages).join(one, "page_number").join(two, "page_number").withColumn("items", F.array("i1", "item", "i2"))
    items, refs = F.col("items"), K.required_refs(F.col("items"), F.col("page_number"))
    return rows.select(
        *PAGE, F.array_join(F.transform(refs, E.alias_of), "|").alias("citations"), K.find_page_item(items, F.col("page_number"))["evidence_id"].alias("page_item"),
        F.size(K.allowed_refs(items)).alias("n_allowed"), K.count_visual_inputs(items, F.lit(False)).alias("visual_inputs"),
    )


def fact_group_forms(s, d):
    forms = E.frame_fact_groups(F.col("frame_index"), F.col("timestamp_sec"))
    return V.samples(s, d).where("frame_index % 5 = 0").select("episode_id", "frame_index", F.array_join(F.flatten(forms), "|").alias("forms"))


def generation_gate(s, d):
    return K.generation_gate(retrieval.bm25_topk(s, d).where("rank <= 1"), V.gold(s, d))


def _profiles(s, d):
    i = F.col("item_id")
    joints = F.when(i % 2 == 0, F.array(F.lit("wrist"))).otherwise(F.array(F.lit("wrist"), F.lit("gripper")))
    signals = F.array(F.lit("observation"), F.lit("action"))
    match = K.profile_matches(joints, signals, i % 5 != 0, F.when(i % 3 == 0, F.array(F.lit("gripper"), F.lit("wrist"))).otherwise(joints), signals)
    return V.queries(s, d).select("item_id", match.alias("profile_match"), (i % 4 != 0).alias("bundle_valid"))


def robot_profiles(s, d):
    return _profiles(s, d).select("item_id", "profile_match")


def robot_profile_accuracy(s, d):
    out = K.profile_accuracy(_profiles(s, d))
    return out.select("n_cases", F.round("robot_profile_accuracy", 9).alias("robot_profile_accuracy"), F.round("bundle_valid_rate", 9).alias("bundle_valid_rate"))


def robot_candidate_errors(s, d):
    e, f = F.col("event_id"), F.col("frame_index")
    errors = K.candidate_errors(
        f + 1, F.when(e % 11 == 0, "document").otherwise("robot"), F.when(e % 7 == 0, "document_page").otherwise("robot_sample"),
        F.when(e % 5 == 0, F.array(F.lit("wrist"), F.lit("front"))).otherwise(F.array(F.lit("front"), F.lit("wrist"))), f, F.when(e % 3 == 0, f + 1).otherwise(f),
        F.col("timestamp_sec"), F.when(e % 13 == 0, F.col("timestamp_sec") + 0.5).otherwise(F.col("timestamp_sec")),
    )
    return V.samples(s, d).select("event_id", F.array_join(errors, "|").alias("errors"))


def report_candidates(s, d):
    x = V.samples(s, d)
    c = TS.uniform_anchors(x, 7).join(x.select("episode_id", "frame_index", "timestamp_sec"), ["episode_id", "frame_index"])
    moved = c.withColumn("timestamp_sec", F.when(F.col("frame_index") == 9, F.col("timestamp_sec") + 1.0).otherwise(F.col("timestamp_sec")))
    return W.candidate_checks(moved, x, 6)


def method_comparison_three(s, d):
    """Midpoint, motion and change selection at equal budget."""
    x = V.samples(s, d)
    events = V.annotated(x)
    mid = TS.tumbling_slices(x, V.DAY, "skip").select("episode_id", F.col("midpoint_frame_index").alias("frame_index"), F.col("midpoint_timestamp_sec").alias("timestamp_sec"))
    moved = TS.select_best(TS.strided_motion(x.withColumn("pixels", F.col("observation")), 3), "motion_score", V.DAY)
    change = TS.select_best(TS.change_scores(x), "fused_state_action_score", V.DAY)
    picked = [mid, *(p.select("episode_id", F.col("selected_frame_index").alias("frame_index"), F.col("selected_timestamp_sec").alias("timestamp_sec")) for p in (moved, change))]
    a, b, c = (I.event_coverage(events, p).select("event_id", F.col("covered").alias(n), F.col("nearest_ms").alias(f"{n}_ms")) for n, p in zip(("midpoint", "motion", "change"), picked, strict=True))
    both = a.join(b, "event_id").join(c, "event_id")
    delta = lambda n: (F.col(n).cast("int") - F.col("midpoint").cast("int")).alias(f"{n}_delta")
    return both.select("event_id", "midpoint", "motion", "change", delta("motion"), delta("change"), F.round(F.col("motion_ms") - F.col("midpoint_ms"), 3).alias("motion_delta_ms"))


def split_artifact(s, d):
    a = _audit(s, d).where("audit_category in ('clean_reference_candidate', 'operation_anomaly')")
    gold = W.flatten_events(_cases(s, d)).select("event_id", "episode_id", F.when(F.col("episode_id") % 4 == 0, "reviewed_unresolved").otherwise("verified").alias("review_disposition"))
    sides = a.select("episode_id", F.when(F.col("episode_id") % 5 == 0, "held_out").otherwise("development").alias("split"))
    out = A.split_artifact(a, sides, gold)
    return out.select("episode_id", "split", "source_category", "n_events", F.array_join("event_ids", ",").alias("event_ids"), F.array_join("dispositions", ",").alias("dispositions"))


def _unresolved(s, d):
    return V.annotated(V.samples(s, d)).where("event_id % 5 = 0")


def model_artifact(s, d):
    m = A.model_artifact(I.radius_grid(episodes._overlap(s, d)))
    return m.select("selected_radius_frames", F.round("selected_metrics.recall", 6).alias("recall"), F.array_join(F.transform("grid_metrics", lambda g: g["radius_frames"].cast("string")), ",").alias("radii"))


def development_report(s, d):
    return A.development_report(episodes._proposals(s, d), episodes._overlap(s, d).where("event_id % 5 <> 0"), _unresolved(s, d), 5)


def heldout_metrics(s, d):
    x = V.annotated(V.samples(s, d)).withColumn("review_disposition", F.when(F.col("event_id") % 5 == 0, "reviewed_unresolved").otherwise("verified"))
    metrics = A.heldout_report(x, episodes._proposals(s, d), 5)[1]
    return metrics.select("mode", "n_events", *[F.round(c, 6).alias(c) for c in episodes.METRICS])


def localization_report(s, d):
    x = V.samples(s, d)
    events = V.annotated(x)
    found = I.localize(events.where("event_id % 5 <> 0"), V.peaks_of(x)).join(events.select("event_id", "mode"), "event_id")
    out = A.localization_report(found, _unresolved(s, d), [0, 5, 15])
    return out.select("mode", "n_events", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("mode", "n_events", "n_unresolved")], "n_unresolved")


def table_digest(s, d):
    return A.table_digest(V.table(s, d, "nation"), {"name": F.col("n_name"), "key": F.col("n_nationkey"), "region": F.col("n_regionkey")})


def frozen_files(s, d):
    t = V.table(s, d, "nation").select(F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("sha256"), F.col("n_nationkey").alias("k"))
    found = t.where("k <> 2").withColumn("sha256", F.when(F.col("k") == 4, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256"))).unionByName(t.where("k = 6").withColumn("path", F.lit("new")))
    return A.frozen(t.where("k <> 9"), found)


def pdf_cases(s, d):
    kinds = F.transform(F.sequence(F.lit(1), F.col("doc_id") % 3 + 1), lambda i: F.struct(F.when((F.col("doc_id") + i) % 4 == 0, "pdf").otherwise("image").alias("source_type")))
    return A.cases_with(V.table(s, d, "documents").select("doc_id", kinds.alias("evidence")), "evidence").select("doc_id")


def canonical_retrieval(s, d):
    pages, queries, x = V.pages(s, d), V.queries(s, d), V.samples(s, d)
    cases = queries.select("item_id", (F.col("item_id") + 1).alias("episode_id"))
    lists = (retrieval.bm25_topk(s, d), V.lexical_hits(s, d))
    return canonical.canonical_retrieval("bm25", pages, queries, x, cases).unionByName(canonical.canonical_retrieval(" Hybrid ", pages, queries, x, cases, lists))


AU = f"""{curation.AUD}, au AS (SELECT *, episode_id % 2 = 0 AS ts, episode_id % 19 <> 0 AND episode_id % 20 <> 0 AND episode_id % 21 <> 0 AND episode_id % 22 <> 0 AND episode_id % 23 <> 0 AS whole FROM a),
rc AS (SELECT * FROM au WHERE cat = 'operation_anomaly'),
ev AS (SELECT episode_id, printf('%s_event_%02d', episode_id::VARCHAR, i::INT) AS event_id, m FROM (SELECT episode_id, unnest(string_split(modes, '|')) AS m, generate_subscripts(string_split(modes, '|'), 1) AS i FROM rc))"""
SEED = f"{V.SAMPLES}, {episodes.PK}, {episodes.PROP}, {episodes.OVER}, se AS (SELECT bo.event_id, an.episode_id, best_start_frame AS p0, best_center_frame AS c, best_end_frame AS p1 FROM bo JOIN an ON an.event_id = bo.event_id WHERE radius_frames = 5)"
FRAMES = """fr AS (SELECT event_id, episode_id, 0 AS position, p0 AS frame_index FROM se UNION ALL SELECT event_id, episode_id, 1, c FROM se WHERE c <> p0
  UNION ALL SELECT event_id, episode_id, CASE WHEN c <> p0 THEN 2 ELSE 1 END, p1 FROM se WHERE p1 <> c)"""
MOTION = """st AS (SELECT s.*, n_frames FROM s JOIN n ON s.episode_id = n.episode_id WHERE frame_index % 3 = 0 OR frame_index = n_frames - 1),
lm AS (SELECT *, lag(o1) OVER w AS p1, lag(o2) OVER w AS p2 FROM st WINDOW w AS (PARTITION BY episode_id ORDER BY frame_index)),
mo AS (SELECT *, CASE WHEN p1 IS NULL THEN 0.0::DOUBLE ELSE (abs(p1 - o1) + abs(p2 - o2)) / 2 END AS ms, floor(timestamp_sec / 86400.0::DOUBLE)::BIGINT AS slice_index FROM lm),
mb AS (SELECT episode_id, slice_index, arg_max(frame_index, (ms, -frame_index)) AS f, arg_max(timestamp_sec, (ms, -frame_index)) AS t FROM mo GROUP BY episode_id, slice_index)"""
QUOTA = """SELECT item_id, '{m}' AS mode, domain, rank, evidence_id, row_number() OVER (PARTITION BY item_id ORDER BY b, rank) AS position FROM (
  SELECT item_id, 0 AS b, 'document' AS domain, rank, 'doc:' || source_id || ':p' || page_number AS evidence_id FROM {t} WHERE rank <= 3 UNION ALL SELECT item_id, 1, 'robot', rank, evidence_id FROM rb WHERE rank <= 2)"""

QUERIES = {f.__name__: f for f in (
    source_presence, anomaly_presence, review_cases, review_events, review_preservation, case_seed_frames, case_universe, case_bundles, generation_refs, fact_group_forms, generation_gate, robot_profiles,
    robot_profile_accuracy, robot_candidate_errors, report_candidates, method_comparison_three, split_artifact, model_artifact, development_report, heldout_metrics, localization_report, table_digest,
    frozen_files, pdf_cases, canonical_retrieval,
)}
ORACLE_SQL = {
    "source_presence": f"WITH {AU} SELECT episode_id, whole AS complete FROM au",
    "anomaly_presence": f"WITH {AU} SELECT count(*) AS n_anomalies, coalesce(bool_and(whole), false) AS complete FROM rc",
    "review_cases": f"""WITH {AU} SELECT 'day16_review_' || episode_id AS review_id, episode_id, ts AS task_success, reason AS original_failure_reason, modes, true AS all_draft, true AS all_unset, false AS complete,
  'manifests/' || episode_id || '.json' AS diagnostic_manifest_path, 'processed/' || episode_id || '/frames.jsonl' AS diagnostic_frames_path FROM rc""",
    "review_events": f"WITH {AU} SELECT event_id, 'day16_review_' || episode_id AS review_id, episode_id, m AS observed_failure_mode, 'draft' AS event_status FROM ev",
    "review_preservation": f"WITH {AU} SELECT episode_id, CASE WHEN episode_id % 7 = 0 THEN 'not_reviewed' ELSE 'changed' END AS problem FROM au WHERE episode_id % 7 = 0 OR episode_id % 9 = 0",
    "case_seed_frames": f"WITH {SEED}, {FRAMES} SELECT * FROM fr",
    "case_universe": f"WITH {SEED} SELECT event_id, 'unexpected' AS side FROM se WHERE event_id % 6 = 0 UNION ALL SELECT event_id, 'missing' FROM an WHERE event_id % 6 <> 0 AND event_id NOT IN (SELECT event_id FROM se)",
    "case_bundles": f"""WITH {V.BM25}, {SEED}, {FRAMES}, dl AS (SELECT string_agg('doc:' || source_id || ':p' || page_number, '|' ORDER BY rank) AS docs, count(*) AS nd FROM bm WHERE item_id = 1 AND rank <= 3),
fe AS (SELECT event_id, count(*) AS nf, string_agg('robot:' || episode_id || ':f' || frame_index, '|' ORDER BY position) AS fs FROM fr GROUP BY event_id)
SELECT event_id, 'day21_cross_domain_' || event_id AS bundle_id, docs || '|' || fs AS evidence, nf AS n_robots, nd + 2 * nf AS n_refs, nd + 2 * nf AS visual_inputs, 'abstain_physical_root_cause' AS decision,
  CASE WHEN nf <> 3 THEN 'robots' ELSE '' END AS violations FROM fe, dl""",
    "generation_refs": f"""WITH {V.PAGES}, {V.SAMPLES}
SELECT source_id, page_number, 'DOC_P' || page_number || '|ROBOT_F' || x.frame_index || '_FRONT|ROBOT_F' || x.frame_index || '_WRIST|ROBOT_F' || y.frame_index || '_FRONT|ROBOT_F' || y.frame_index || '_WRIST' AS citations,
  'doc:' || source_id || ':p' || page_number AS page_item, 5 AS n_allowed, 4 AS visual_inputs FROM pg JOIN s x ON x.event_id = page_number JOIN s y ON y.event_id = page_number + 1""",
    "fact_group_forms": f"""WITH {V.SAMPLES} SELECT episode_id, frame_index, array_to_string(list_concat(list_transform(['frame ', 'frame_index ', 'frame_index=', 'frame_index 是 ', 'frame_index是', 'frame_index 为 ', 'frame_index为', '帧', '帧 '],
  lambda f: f || frame_index), [printf('%.7f', timestamp_sec), printf('%.4f', timestamp_sec), printf('%.3f', timestamp_sec)]), '|') AS forms FROM s WHERE frame_index % 5 = 0""",
    "generation_gate": f"""WITH {V.BM25}, {V.GOLD}, h AS (SELECT DISTINCT g.item_id FROM gold g JOIN bm ON bm.item_id = g.item_id AND bm.source_id = g.source_id AND bm.page_number = g.page_number WHERE rank <= 1)
SELECT DISTINCT g.item_id, h.item_id IS NOT NULL AS required_page_retrieved, CASE WHEN h.item_id IS NOT NULL THEN 'generate' ELSE 'skip_generation' END AS action FROM gold g LEFT JOIN h ON g.item_id = h.item_id""",
    "robot_profiles": "SELECT item_id, item_id % 5 <> 0 AND item_id % 3 <> 0 AS profile_match FROM benchmark",
    "robot_profile_accuracy": "SELECT count(*) AS n_cases, round(avg((item_id % 5 <> 0 AND item_id % 3 <> 0)::INT), 9) AS robot_profile_accuracy, round(avg((item_id % 4 <> 0)::INT), 9) AS bundle_valid_rate FROM benchmark",
    "robot_candidate_errors": f"""WITH {V.SAMPLES}, p AS (SELECT *, 'rank=' || (frame_index + 1) || ': ' AS a FROM s)
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN a || 'non-robot domain' WHEN event_id % 7 = 0 THEN a || 'non-robot_sample item' ELSE array_to_string(list_filter([CASE WHEN event_id % 5 = 0 THEN a || 'cameras=wrist,front' END,
  CASE WHEN event_id % 3 = 0 THEN a || 'state/action frame mismatch' END, CASE WHEN event_id % 13 = 0 THEN a || 'state/action timestamp mismatch' END], lambda x: x IS NOT NULL), '|') END AS errors FROM p""",
    "report_candidates": f"""WITH {V.SAMPLES}, u AS ({episodes.UNIFORM.format(c=7, m=6)}) SELECT episode_id, count(*) AS n, true AS "unique", count(*) <= 6 AS within_cap, bool_and(frame_index <> 9) AS timestamps_match FROM u GROUP BY episode_id""",
    "method_comparison_three": f"""WITH {V.SAMPLES}, {episodes.SLICES}, {episodes.BEST}, {MOTION}, {episodes.COVER}, {episodes._cover("SELECT episode_id, bf AS f, bt AS t FROM bs", "cb")}, {episodes._cover("SELECT episode_id, f, t FROM mb", "cm")}
SELECT cv.event_id, cv.n_inside > 0 AS midpoint, cm.n_inside > 0 AS motion, cb.n_inside > 0 AS change, (cm.n_inside > 0)::INT - (cv.n_inside > 0)::INT AS motion_delta, (cb.n_inside > 0)::INT - (cv.n_inside > 0)::INT AS change_delta,
  round(round(cm.ms, 6) - round(cv.ms, 6), 3) AS motion_delta_ms FROM cv JOIN cm ON cv.event_id = cm.event_id JOIN cb ON cv.event_id = cb.event_id""",
    "split_artifact": f"""WITH {AU}, es AS (SELECT episode_id, count(*) AS n, string_agg(event_id, ',' ORDER BY event_id) AS ids FROM ev GROUP BY episode_id)
SELECT au.episode_id, CASE WHEN au.episode_id % 5 = 0 THEN 'held_out' ELSE 'development' END AS split, cat AS source_category, coalesce(n, 0) AS n_events, coalesce(ids, '') AS event_ids,
  CASE WHEN n IS NULL THEN '' WHEN au.episode_id % 4 = 0 THEN 'reviewed_unresolved' ELSE 'verified' END AS dispositions FROM au LEFT JOIN es ON au.episode_id = es.episode_id WHERE cat IN ('clean_reference_candidate', 'operation_anomaly')""",
    "model_artifact": f"""WITH {V.SAMPLES}, {episodes.PK}, {episodes.PROP}, {episodes.OVER}, g AS (SELECT radius_frames, {episodes.BLOCK} FROM bo GROUP BY radius_frames),
o AS (SELECT *, row_number() OVER (ORDER BY recall DESC, recall_at_0_25 DESC, mean_iou DESC, radius_frames) AS r FROM g)
SELECT max(CASE WHEN r = 1 THEN radius_frames END) AS selected_radius_frames, max(CASE WHEN r = 1 THEN recall END) AS recall, string_agg(radius_frames::VARCHAR, ',' ORDER BY radius_frames) AS radii FROM o""",
    "development_report": f"""WITH {SEED} SELECT 'proposal' AS kind, episode_id, center_frame::BIGINT AS "key", start_frame::BIGINT AS start_frame, end_frame::BIGINT AS end_frame FROM pr WHERE radius_frames = 5
UNION ALL SELECT 'result', episode_id, event_id, p0, p1 FROM se WHERE event_id % 5 <> 0 UNION ALL SELECT 'unresolved', episode_id, event_id, NULL, NULL FROM an WHERE event_id % 5 = 0""",
    "heldout_metrics": f"WITH {V.SAMPLES}, {episodes.PK}, {episodes.PROP}, {episodes.OVER} SELECT mode, {episodes.BLOCK} FROM bo WHERE radius_frames = 5 AND event_id % 5 <> 0 GROUP BY GROUPING SETS ((), (mode))",
    "localization_report": f"""WITH {V.SAMPLES}, {episodes.PK}, m AS (SELECT event_id, mode, min(greatest(start_frame - frame_index, frame_index - end_frame, 0)) AS d FROM an JOIN pk ON an.episode_id = pk.episode_id WHERE event_id % 5 <> 0 GROUP BY event_id, mode)
SELECT mode, count(*) AS n_events, round(avg((d = 0)::INT), 6) AS exact_event_recall, round(avg((d <= 0)::INT), 6) AS recall_within_0, round(avg((d <= 5)::INT), 6) AS recall_within_5, round(avg((d <= 15)::INT), 6) AS recall_within_15,
  round(avg(d), 6) AS mean_min_frame_distance, round(median(d), 6) AS median_min_frame_distance, CASE WHEN mode IS NULL THEN (SELECT count(*) FROM an WHERE event_id % 5 = 0) END AS n_unresolved FROM m GROUP BY GROUPING SETS ((), (mode))""",
    "table_digest": """WITH l AS (SELECT sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '","region":' || n_regionkey || '}') AS h FROM nation)
SELECT count(*) AS n, sum(('0x' || substring(h, 1, 15))::UBIGINT)::VARCHAR AS digest FROM l""",
    "frozen_files": """SELECT n_name AS path, CASE n_nationkey WHEN 2 THEN 'missing' WHEN 4 THEN 'changed' WHEN 9 THEN 'unlisted' ELSE 'same' END AS state FROM nation UNION ALL SELECT 'new', 'unlisted'""",
    "pdf_cases": "SELECT doc_id FROM documents WHERE len(list_filter(range(1, doc_id % 3 + 2), lambda i: (doc_id + i) % 4 = 0)) > 0",
    "canonical_retrieval": f"""{retrieval.BOTH}, {retrieval.UNI}, r AS (SELECT un.*, lex.score AS s FROM un JOIN lex USING (item_id, source_id, page_number)),
re AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, source_id, page_number) AS rank FROM r) WHERE rank <= 3), {V.SAMPLES},
rb AS (SELECT episode_id - 1 AS item_id, row_number() OVER (PARTITION BY episode_id ORDER BY fused DESC, frame_index) AS rank, 'robot:' || episode_id || ':f' || frame_index AS evidence_id FROM sc WHERE episode_id - 1 IN (SELECT item_id FROM benchmark))
{QUOTA.format(m='bm25', t='bm')} UNION ALL {QUOTA.format(m='hybrid', t='re')}""",
}
