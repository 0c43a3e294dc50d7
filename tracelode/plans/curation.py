"""Audit, split, plan and evidence queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import inference
from ..functions import numeric as N
from ..functions import text as X
from ..operators import contracts as C
from ..operators import evidence as E
from ..operators import protocol as P
from ..operators import ranking as R
from ..operators import splits as S
from . import views as V


def _audit(s, d):
    docs = V.table(s, d, "documents").join(V.table(s, d, "labels"), "doc_id")
    rows = docs.select(
        F.col("doc_id").alias("episode_id"), (F.col("doc_id") % 11 != 0).alias("technical_valid"), (F.col("quality") == 1).alias("demo_quality_valid"),
        F.when(F.col("toxic") == 1, F.concat(F.lit("drop "), "lang")).when(F.col("doc_id") % 13 == 0, "wrist_duplicate_ratio: FAIL").when(F.col("doc_id") % 17 == 0, "other").alias("failure_reason"),
    )
    return S.classify(rows, ["ratio: FAIL"], {"drop en": ["grasp_drop"], "drop de": ["grasp_drop", "post_place_collision"]}, ["drop fr"])


def audit_classify(s, d):
    return _audit(s, d).select("episode_id", "audit_category", F.array_join("observed_failure_modes", "|").alias("modes"), "diagnostic_eligible", "exclusion_reason")


def audit_frequency(s, d):
    return S.frequency(_audit(s, d), ["audit_category", "observed_failure_modes", "failure_reason", "technical_valid"])


HELD = {"en": 20, "de": 5, "fr": 5, "es": 5}


def stratified_hash_split(s, d):
    return S.stratified_split(V.table(s, d, "documents").select("doc_id", "lang"), "lang", "doc_id", "seed-18", HELD)


def group_atomic_split(s, d):
    return S.group_split(V.table(s, d, "documents").select("doc_id", "source"), "source", "seed-22", 4).select("doc_id", "source", "split")


def split_counts_cube(s, d):
    return S.split_counts(stratified_hash_split(s, d), "lang")


def _gold(s, d):
    return V.annotated(V.samples(s, d)).withColumn("review_disposition", F.when(F.col("event_id") % 5 == 0, "reviewed_unresolved").otherwise("verified"))


def gold_summary_by_episode(s, d):
    out = S.event_summary(_gold(s, d))
    return out.select("episode_id", "n_events", F.array_join("event_ids", ",").alias("event_ids"), F.array_join("dispositions", ",").alias("dispositions"))


def gold_counts_by_split(s, d):
    ids = V.samples(s, d).select("episode_id").distinct()
    return S.gold_counts_by_split(S.group_split(ids, "episode_id", "seed-18", 30), _gold(s, d))


def allowed_gold(s, d):
    ids = V.samples(s, d).select("episode_id").distinct().where("episode_id % 2 = 0")
    return S.load_gold(_gold(s, d), ids).select("event_id", "episode_id", "start_frame", "end_frame")


def gold_integration(s, d):
    a = V.annotated(V.samples(s, d)).select("event_id", "episode_id", "mode")
    done = F.col("event_id") % 5 != 0
    r = V.annotated(V.samples(s, d)).select("event_id", F.when(done, F.col("start_frame")).alias("start_frame"), F.when(done, F.col("end_frame")).alias("end_frame"), F.when(done, "r1").alias("reviewer"), F.when(~done, "unclear").alias("review_notes"))
    return S.integrate_gold(a, r).groupBy("mode", "review_disposition").agg(F.count(F.lit(1)).alias("n"))


def collection_plan_90(s, d):
    return P.collection_plan(s)


def plan_summary(s, d):
    return P.plan_summary(P.collection_plan(s))


def referential_antijoin(s, d):
    docs = V.table(s, d, "documents").where("doc_id % 3 <> 0").select("doc_id")
    return V.table(s, d, "labels").join(docs, "doc_id", "left_anti").select("doc_id").distinct()


def recompute_diff(s, d):
    a = V.table(s, d, "nation").select("n_nationkey", "n_name")
    return S.recompute_diff(a, a.where("n_nationkey <> 3").unionByName(a.where("n_nationkey = 5")))


def expected_counts(s, d):
    docs = V.table(s, d, "documents")
    return C.expect(docs, {"en": 20, "short": 0}, {"en": F.col("lang") == "en", "short": F.length("text") < 5})


def quarantined_rows(s, d):
    x = V.annotated(V.samples(s, d)).withColumn("start_sec", F.col("center_sec")).withColumn("end_sec", F.when(F.col("event_id") % 7 == 0, F.col("center_sec") - 1).otherwise(F.col("center_sec") + 1))
    return C.quarantine(x, C.interval_rules())[1].select("event_id", F.array_join("violations", ",").alias("violations"))


def ranked_list_contract(s, d):
    best = R.bm25_search(V.pages(s, d), V.queries(s, d)).withColumn("evidence_id", F.concat_ws(":", "source_id", F.col("page_number").cast("string")))
    return C.ranked_list_rules(best)


def absence_check(s, d):
    return C.absent_everywhere(V.pages(s, d), V.queries(s, d)).select(F.col("item_id").alias("case_id"))


# --- answers: the assistant's turns, with what the user's turn before asks for ---


def _answers(s, d):
    c = V.table(s, d, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", "turn", "text")
    words = F.split(F.trim(F.col("text")), "\\s+")
    rows = a.withColumn("cites", F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < F.length("text") % 4), lambda i: F.concat(F.lit("D"), ((F.col("conv_id") + i * F.col("turn")) % 4).cast("string"))))
    return rows.select(
        "conv_id", "turn", "text", "cites", (F.col("conv_id") % 7 == 0).alias("abstain"), (F.col("conv_id") % 3 != 0).alias("answerable"),
        F.array(F.lit("D0"), F.lit("D1"), F.lit("D2")).alias("allowed"), F.array(F.lit("D1")).alias("required"), F.array(F.array(F.lit("the"), F.lit("der ")), F.array(F.element_at(words, 1)), F.array(F.lit("zzz"))).alias("facts"),
    )


def citation_policy(s, d):
    e = E.citation_errors(F.col("cites"), F.col("allowed"), F.col("abstain"))
    return _answers(s, d).select("conv_id", "turn", F.array_join(e, "|").alias("errors"), (F.size(e) == 0).alias("valid"))


def required_citation_coverage(s, d):
    return _answers(s, d).select("conv_id", "turn", F.array_join(E.missing_required(F.col("cites"), F.col("required")), "|").alias("missing"))


def fact_coverage(s, d):
    return _answers(s, d).select("conv_id", "turn", F.round(X.required_fact_coverage(F.col("text"), F.col("facts")), 9).alias("coverage"))


def _codes(c=None):
    f = F.col
    return E.generation_codes(f("text"), f("cites"), f("allowed"), f("abstain"), f("required"), f("facts"), f("answerable"))


def diagnosis_findings(s, d):
    return _answers(s, d).select("conv_id", "turn", F.array_join(E.report(_codes()), "|").alias("codes"))


def diagnosis_counts(s, d):
    return _answers(s, d).select(F.explode(_codes()).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def grounded_answer_metrics(s, d):
    a = _answers(s, d)
    cases = a.select(
        (F.length("text") % 5 != 0).alias("parsed"), "abstain", "answerable", (F.size(E.citation_errors(F.col("cites"), F.col("allowed"), F.col("abstain"))) == 0).alias("policy_valid"),
        F.array_contains("cites", "D1").alias("gold_hit"), X.required_fact_coverage(F.col("text"), F.col("facts")).alias("fact_coverage"),
    )
    out = E.answer_metrics(cases)
    return out.select("n", *[F.round(c, 9).alias(c) for c in out.columns if c != "n"])


def fault_injection_matrix(s, d):
    """Eight faults put into one healthy answer and bundle, with the codes expected and found."""
    rows = [
        ("healthy", ["D1", "D2"], False, True, ["document_page", "robot_sample"], "x fact", ["p1"], []),
        ("hallucinated", ["D1", "D9"], False, True, ["document_page", "robot_sample"], "x fact", ["p1"], ["generation_hallucinated_citation"]),
        ("duplicate", ["D1", "D1"], False, True, ["document_page", "robot_sample"], "x fact", ["p1"], ["generation_duplicate_citation"]),
        ("gap", ["D2"], False, True, ["document_page", "robot_sample"], "x fact", ["p1"], ["generation_citation_gap"]),
        ("incomplete", ["D1"], False, True, ["document_page", "robot_sample"], "x", ["p1"], ["generation_incomplete"]),
        ("false_abstention", ["D1"], True, True, ["document_page", "robot_sample"], "x fact", ["p1"], ["generation_false_abstention"]),
        ("overanswer", ["D1"], False, False, ["document_page", "robot_sample"], "x fact", ["p1"], ["generation_overanswer"]),
        ("no_robot_and_miss", ["D1"], False, True, ["document_page"], "x fact", ["p8"], ["retrieval_miss", "evidence_missing_robot"]),
    ]
    t = s.createDataFrame(rows, "scenario string, cites array<string>, abstain boolean, answerable boolean, kinds array<string>, text string, ranked array<string>, expected array<string>")
    t = t.withColumns({"allowed": F.array(F.lit("D1"), F.lit("D2")), "required": F.array(F.lit("D1")), "facts": F.array(F.array(F.lit("fact")))})
    found = F.concat(E.retrieval_codes(F.col("ranked"), F.array(F.lit("p1")), 3), E.bundle_codes(F.col("kinds"), F.col("allowed"), F.col("required"), F.lit(True)), _codes())
    t = t.withColumn("codes", E.report(found))
    return t.select("scenario", F.array_join("codes", "|").alias("codes"), (F.array_sort("codes") == F.array_sort("expected")).alias("passed"))


def citation_aliases(s, d):
    """Every page with the sample whose event has the page's number."""
    pages = V.pages(s, d).withColumns(X.page_columns(F.col("text")))
    samples = V.samples(s, d)
    robot = E.sample_items(samples).join(samples.select("episode_id", "frame_index", F.col("event_id").alias("page_number")), ["episode_id", "frame_index"])
    both = E.page_items(pages).join(robot.select("page_number", F.col("item").alias("robot")), "page_number")
    m = both.select("source_id", "page_number", E.alias_map(F.array(F.col("item"), F.col("robot"))).alias("m"))
    return m.select("source_id", "page_number", F.array_join(F.array_sort(F.map_keys("m")), "|").alias("aliases"))


def encoded_pages(s, d):
    """No SQL: pages through the stand-in encoder; norms are 1 or 0."""
    v = inference.encoder(inference.hashing_encoder)(F.col("text"))
    return V.pages(s, d).select("source_id", "page_number", F.round(N.norm(v), 4).alias("norm"))


def golden_intervals(s, d):
    """Published interval cases: (673, 680) with (670, 680), and (480, 482) with (475, 485)."""
    t = s.createDataFrame([(673, 680, 670, 680), (480, 482, 475, 485), (1, 2, 3, 4)], "a0 int, a1 int, b0 int, b1 int")
    return t.select("a0", F.round(N.interval_iou(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")), 9).alias("iou"))


QUERIES = {f.__name__: f for f in (audit_classify, audit_frequency, stratified_hash_split, group_atomic_split, split_counts_cube, gold_summary_by_episode, gold_counts_by_split, allowed_gold, gold_integration, collection_plan_90, plan_summary, referential_antijoin, recompute_diff, expected_counts, quarantined_rows, ranked_list_contract, absence_check, citation_policy, required_citation_coverage, fact_coverage, diagnosis_findings, diagnosis_counts, grounded_answer_metrics, fault_injection_matrix, citation_aliases, encoded_pages, golden_intervals)}

AUD = """r AS (SELECT d.doc_id AS episode_id, d.doc_id % 11 <> 0 AS tv, quality = 1 AS dq, CASE WHEN toxic = 1 THEN 'drop ' || lang WHEN d.doc_id % 13 = 0 THEN 'wrist_duplicate_ratio: FAIL' WHEN d.doc_id % 17 = 0 THEN 'other' END AS reason
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT *, (NOT tv OR coalesce(contains(reason, 'ratio: FAIL'), false)) AS tech FROM r),
a AS (SELECT *, CASE WHEN tech THEN 'technical_exclusion' WHEN reason IN ('drop en', 'drop de') THEN 'operation_anomaly' WHEN reason = 'drop fr' OR (NOT dq AND reason IS NULL) THEN 'demo_quality_only'
  WHEN reason IS NULL THEN 'clean_reference_candidate' ELSE 'manual_review_required' END AS cat,
  CASE WHEN tech THEN '' WHEN reason = 'drop en' THEN 'grasp_drop' WHEN reason = 'drop de' THEN 'grasp_drop|post_place_collision' ELSE '' END AS modes FROM c)"""
SPLIT = """h AS (SELECT doc_id, lang, sha256('seed-18|' || lang || '|' || doc_id) AS rank_digest FROM documents),
sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY rank_digest, doc_id) <= CASE lang WHEN 'en' THEN 20 ELSE 5 END THEN 'held_out' ELSE 'development' END AS split FROM h)"""
PLAN = """g AS (SELECT unnest(range(1, 16)) AS g), sl AS (SELECT * FROM (VALUES (1, 'clean_control', 'none_clean', 'none', false), (2, 'controlled_cause', 'target_offset_or_perception', 'object_target_pose_offset', false),
  (3, 'controlled_cause', 'gripper_close_timing', 'manual_gripper_close_timing_shift', false), (4, 'controlled_cause', 'trajectory_execution_deviation', 'manual_bounded_trajectory_deviation', false),
  (5, 'controlled_cause', NULL, NULL, true), (6, 'insufficient_evidence_candidate', 'unknown', 'ambiguity_protocol', false)) t(i, role, cause, act, rep)),
p AS (SELECT printf('rcv2_g%02d_s%02d', g::INT, i) AS plan_row_id, printf('rcv2_g%02d', g::INT) AS pair_group_id, i AS slot_index, role AS slot_role,
  coalesce(cause, ['target_offset_or_perception', 'gripper_close_timing', 'trajectory_execution_deviation'][(g - 1) % 3 + 1]) AS planned_physical_cause,
  coalesce(act, ['object_target_pose_offset', 'manual_gripper_close_timing_shift', 'manual_bounded_trajectory_deviation'][(g - 1) % 3 + 1]) AS planned_intervention_type, rep AS repeat_slot, 'final_v2' AS benchmark_target FROM g, sl)"""
ANS = """an_ AS (SELECT conv_id, turn, text, list_transform(list_filter([0, 1, 2], lambda i: i < length(text) % 4), lambda i: 'D' || ((conv_id + i * turn) % 4)) AS cites,
  conv_id % 7 = 0 AS abstain, conv_id % 3 <> 0 AS answerable FROM conversations WHERE role = 'assistant'),
fx AS (SELECT *, regexp_replace(lower(text), '\\s+', '', 'g') AS ct, regexp_replace(lower(string_split_regex(trim(text), '\\s+')[1]), '\\s+', '', 'g') AS w1 FROM an_),
aw AS (SELECT *, len(list_distinct(cites)) < len(cites) AS dup, list_sort(list_distinct(list_filter(cites, lambda c: c = 'D3'))) AS outside,
  ((contains(ct, 'the') OR contains(ct, 'der'))::INT + contains(ct, w1)::INT + contains(ct, 'zzz')::INT) / 3.0::DOUBLE AS cov, list_contains(cites, 'D1') AS gold FROM fx)"""
ERR = """array_to_string(list_filter([CASE WHEN dup THEN 'duplicate_citations' END, CASE WHEN len(outside) > 0 THEN 'citation_outside_supplied_evidence=' || array_to_string(outside, ',') END,
  CASE WHEN abstain AND len(cites) > 0 THEN 'abstain_requires_no_citation' END, CASE WHEN NOT abstain AND len(cites) = 0 THEN 'answerable_response_requires_citation' END], lambda x: x IS NOT NULL), '|')"""
COD = """list_filter([CASE WHEN (NOT abstain AND len(cites) = 0) OR NOT gold THEN 'generation_citation_gap' END, CASE WHEN dup THEN 'generation_duplicate_citation' END, CASE WHEN answerable AND abstain THEN 'generation_false_abstention' END,
  CASE WHEN len(outside) > 0 THEN 'generation_hallucinated_citation' END, CASE WHEN cov < 1 THEN 'generation_incomplete' END, CASE WHEN NOT answerable AND NOT abstain THEN 'generation_overanswer' END], lambda x: x IS NOT NULL)"""
GE = f"WITH {V.SAMPLES}, ge AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN 'reviewed_unresolved' ELSE 'verified' END AS disp FROM an)"
ORACLE_SQL = {
    "audit_classify": f"WITH {AUD} SELECT episode_id, cat AS audit_category, modes, NOT tech AS diagnostic_eligible, CASE WHEN tech THEN coalesce(reason, 'technical_valid=False') END AS exclusion_reason FROM a",
    "audit_frequency": f"""WITH {AUD}, u AS (SELECT 'audit_category' AS attribute, cat AS value FROM a UNION ALL SELECT 'observed_failure_modes', unnest(string_split(modes, '|')) FROM a WHERE modes <> ''
  UNION ALL SELECT 'failure_reason', reason FROM a UNION ALL SELECT 'technical_valid', tv::VARCHAR FROM a) SELECT attribute, value, count(*) AS n FROM u GROUP BY attribute, value""",
    "stratified_hash_split": f"WITH {SPLIT} SELECT * FROM sp",
    "group_atomic_split": "WITH g AS (SELECT source, row_number() OVER (ORDER BY sha256('seed-22|' || source), source) AS r FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, d.source, CASE WHEN r <= 4 THEN 'held_out' ELSE 'development' END AS split FROM documents d JOIN g ON d.source = g.source",
    "split_counts_cube": f"WITH {SPLIT} SELECT split, lang, count(*) AS n FROM sp GROUP BY CUBE (split, lang)",
    "gold_summary_by_episode": f"{GE} SELECT episode_id, count(*) AS n_events, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS event_ids, string_agg(DISTINCT disp, ',' ORDER BY disp) AS dispositions FROM ge GROUP BY episode_id",
    "gold_counts_by_split": f"""{GE}, g AS (SELECT episode_id, CASE WHEN row_number() OVER (ORDER BY sha256('seed-18|' || episode_id), episode_id) <= 30 THEN 'held_out' ELSE 'development' END AS split FROM n)
SELECT split, count(*) AS n_events, sum((disp = 'verified')::INT)::BIGINT AS n_verified FROM ge JOIN g ON ge.episode_id = g.episode_id GROUP BY split""",
    "allowed_gold": f"{GE} SELECT event_id, episode_id, start_frame, end_frame FROM ge WHERE episode_id % 2 = 0",
    "gold_integration": f"{GE} SELECT mode, disp AS review_disposition, count(*) AS n FROM ge GROUP BY mode, disp",
    "collection_plan_90": f"WITH {PLAN} SELECT * FROM p",
    "plan_summary": f"WITH {PLAN} SELECT slot_role, planned_physical_cause, count(*) AS n FROM p GROUP BY slot_role, planned_physical_cause",
    "referential_antijoin": "SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)",
    "recompute_diff": "SELECT n_nationkey, n_name, CASE n_nationkey WHEN 3 THEN 'stored' ELSE 'rebuilt' END AS side FROM nation WHERE n_nationkey IN (3, 5)",
    "expected_counts": """WITH c AS (SELECT count(*) FILTER (lang = 'en') AS en, count(*) FILTER (length(text) < 5) AS sh FROM documents)
SELECT 'en' AS "check", 20::BIGINT AS expected, en AS actual, en = 20 AS passed FROM c UNION ALL SELECT 'short', 0, sh, sh = 0 FROM c""",
    "quarantined_rows": f"WITH {V.SAMPLES} SELECT event_id, 'seconds' AS violations FROM an WHERE event_id % 7 = 0",
    "ranked_list_contract": f"WITH {V.BM25} SELECT item_id, min(rank) = 1 AND max(rank) = count(*) AS contiguous, count(DISTINCT source_id || ':' || page_number) = count(*) AS \"unique\", true AS finite FROM bm GROUP BY item_id",
    "absence_check": r"""SELECT item_id AS case_id FROM benchmark b WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(regexp_replace(lower(d.text), '\s+', '', 'g'), regexp_replace(lower(b.text), '\s+', '', 'g')))""",
    "citation_policy": f"WITH {ANS} SELECT conv_id, turn, {ERR} AS errors, {ERR} = '' AS valid FROM aw",
    "required_citation_coverage": f"WITH {ANS} SELECT conv_id, turn, CASE WHEN gold THEN '' ELSE 'D1' END AS missing FROM aw",
    "fact_coverage": f"WITH {ANS} SELECT conv_id, turn, round(cov, 9) AS coverage FROM aw",
    "diagnosis_findings": f"WITH {ANS} SELECT conv_id, turn, array_to_string({COD}, '|') AS codes FROM aw",
    "diagnosis_counts": f"WITH {ANS} SELECT code, count(*) AS n FROM (SELECT unnest({COD}) AS code FROM aw) GROUP BY code",
    "grounded_answer_metrics": f"""WITH {ANS}, m AS (SELECT *, length(text) % 5 <> 0 AS ok, {ERR} = '' AS pol FROM aw), f AS (SELECT *, ok AND abstain = NOT answerable AS rgt FROM m)
SELECT count(*) AS n, round(avg(ok::INT), 9) AS structured_rate, round(avg(rgt::INT), 9) AS answerability_rate, round(avg((ok AND pol)::INT), 9) AS citation_policy_rate,
  round(avg(CASE WHEN answerable THEN (ok AND gold)::INT END), 9) AS gold_hit_rate, round(avg(CASE WHEN answerable THEN CASE WHEN ok THEN cov ELSE 0 END END), 9) AS fact_coverage,
  round(avg(CASE WHEN NOT answerable THEN (ok AND abstain)::INT END), 9) AS abstention_rate, round(avg((rgt AND pol AND (NOT answerable OR (gold AND cov >= 1)))::INT), 9) AS pass_rate FROM f""",
    "fault_injection_matrix": """SELECT * FROM (VALUES ('healthy', '', true), ('hallucinated', 'generation_hallucinated_citation', true), ('duplicate', 'generation_duplicate_citation', true), ('gap', 'generation_citation_gap', true),
  ('incomplete', 'generation_incomplete', true), ('false_abstention', 'generation_false_abstention', true), ('overanswer', 'generation_overanswer', true), ('no_robot_and_miss', 'retrieval_miss|evidence_missing_robot', true)) t(scenario, codes, passed)""",
    "citation_aliases": f"""WITH {V.PAGES}, {V.SAMPLES}
SELECT source_id, page_number, array_to_string(list_sort(['DOC_P' || page_number, 'ROBOT_F' || frame_index || '_FRONT', 'ROBOT_F' || frame_index || '_WRIST']), '|') AS aliases FROM pg JOIN s ON s.event_id = pg.page_number""",
    "golden_intervals": "SELECT * FROM (VALUES (673, round(8 / 11.0::DOUBLE, 9)), (480, round(3 / 11.0::DOUBLE, 9)), (1, 0.0::DOUBLE)) t(a0, iou)",
}
