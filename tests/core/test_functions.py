"""Edge cases of functions and operators on small literals."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from tracelode.functions import inference, text
from tracelode.functions import numeric as N
from tracelode.operators import contracts as C
from tracelode.operators import evidence as E
from tracelode.operators import intervals as I
from tracelode.operators import protocol as P
from tracelode.operators import ranking as R
from tracelode.operators import splits as S
from tracelode.operators import timeseries as TS


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tokens(spark):
    words = F.lit("Ａ STS-3215 v1.2 舵机 电")
    got = one(spark, text.tokenize_mixed(words), text.tokenize_mixed(F.lit(None).cast("string")), text.tokenize_mixed(words, nfkc=False))
    assert list(got[0]) == ["a", "sts-3215", "v1.2", "舵", "机", "舵机", "电"]
    assert list(got[2]) == ["sts-3215", "v1.2", "舵", "机", "舵机", "电"]
    assert list(got[1]) == []
    full = spark.createDataFrame([("Ａ １２",)], "t string").select(text.tokenize_mixed(F.col("t"), nfkc=True)).first()[0]
    assert full == unicodedata.normalize("NFKC", "ａ １２").lower().split()


def test_white_space(spark):
    assert one(spark, text.collapse(F.lit("　a  b\x1c\n")))[0] == "a b"
    assert one(spark, text.compact_text(F.lit("A b\tC"), False))[0] == "abc"


def test_json(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('x {"a": 1, "b": 2} y',), ("none",), (None,)], "t string")
    got = [r[0] for r in df.select(text.parse_strict(F.col("t"), "a int", ["a"])).collect()]
    assert got[0].a == 1 and got[1:] == [None, None, None]


def test_rrf_anchors(spark):
    got = one(spark, *[F.round(N.rrf(F.lit(a)) + N.rrf(F.lit(b)), 6) for a, b in ((1, 1), (2, 1), (1, 5))])
    assert list(got) == [0.032787, 0.032522, 0.031778]


def test_rrf_ties_and_missing_ranks(spark):
    a = spark.createDataFrame([(1, "d", 1, 1), (1, "d", 2, 2)], "item_id int, source_id string, page_number int, rank int")
    b = spark.createDataFrame([(1, "d", 2, 1), (1, "d", 3, 2)], "item_id int, source_id string, page_number int, rank int")
    got = [(r.page_number, r.rank) for r in R.fuse_rrf(a, b, 3).orderBy("rank").collect()]
    assert got == [(2, 1), (1, 2), (3, 3)]


def test_peaks(spark):
    rows = [(5.0, 3), (5.0, 1), (4.0, 9), (float("nan"), 20), (float("inf"), 30), (3.0, 10)]
    df = spark.createDataFrame([(rows,)], "xs array<struct<score:double,frame:int>>")
    got = df.select(N.top_peaks(F.col("xs"), 3, 3), N.top_peaks(F.col("xs"), 0, 3)).first()
    assert [(x.score, x.frame) for x in got[0]] == [(5.0, 1), (4.0, 9)] and got[1] == []


def test_uniform(spark):
    got = one(spark, N.uniform_indices(F.lit(6), 3), N.uniform_indices(F.lit(2), 5), N.uniform_indices(F.lit(9), 1))
    assert [list(x) for x in got] == [[0, 2, 5], [0, 1], [0]]


def test_intervals(spark):
    assert one(spark, N.interval_iou(F.lit(673), F.lit(680), F.lit(670), F.lit(680)))[0] == 8 / 11
    assert one(spark, N.point_distance(F.lit(3), F.lit(5), F.lit(9)))[0] == 2
    with pytest.raises(Exception, match="inverted"):
        one(spark, N.interval_iou(F.lit(9), F.lit(1), F.lit(0), F.lit(1)))


def test_first_frame_and_empty_slices(spark):
    rows = [("e", 0, 0.0, [1.0, 2.0]), ("e", 1, 0.5, [1.0, 4.0]), ("e", 2, 5.0, [1.0, 4.0])]
    s = spark.createDataFrame(rows, "episode_id string, frame_index int, timestamp_sec double, observation array<double>").withColumns({"action": F.col("observation"), "tracking_error": F.col("observation")})
    got = [r.state_change_rms for r in TS.change_scores(s).orderBy("frame_index").collect()]
    assert got == [0.0, (4.0 / 2) ** 0.5, 0.0]
    assert TS.tumbling_slices(s, 2.0, "skip").count() == 2
    with pytest.raises(Exception, match="no frames"):
        TS.tumbling_slices(s, 2.0).collect()


def test_contiguity_finds_gaps(spark):
    s = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 1.0), ("b", 0, 1.0), ("b", 2, 1.0)], "episode_id string, frame_index int, timestamp_sec double")
    got = {r.episode_id: (r.contiguous, r.increasing) for r in TS.contiguity(s).collect()}
    assert got == {"a": (True, True), "b": (False, False)}


def test_empty_metrics_are_null(spark):
    schema = "mode string, overlap_hit boolean, best_iou double, onset_error int, offset_error int"
    got = I.metric_rollup(spark.createDataFrame([], schema)).collect()
    assert len(got) == 1 and got[0].n_events == 0 and got[0].mean_iou is None


def test_split_needs_a_remainder(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x")], "id int, s string")
    with pytest.raises(Exception, match="too few"):
        S.stratified_split(rows, "s", "id", "seed", {"x": 2}).collect()


def test_parse_bool(spark):
    df = spark.createDataFrame([("Yes",), ("0",)], "v string")
    assert [r[0] for r in df.select(S.parse_bool(F.col("v"))).collect()] == [True, False]
    with pytest.raises(Exception, match="not a boolean"):
        one(spark, S.parse_bool(F.lit("maybe")))


def test_plan(spark):
    plan = P.collection_plan(spark)
    assert plan.count() == 90 and P.plan_violations(plan).isEmpty()
    assert not P.plan_violations(plan.where("slot_index > 1")).isEmpty()


def test_contracts(spark):
    df = spark.createDataFrame([(1, 5, 0.0, 1.0), (5, 1, 0.0, 1.0), (None, 1, 0.0, 1.0)], "start_frame int, end_frame int, start_sec double, end_sec double")
    good, bad = C.quarantine(df, C.interval_rules())
    assert good.count() == 1 and [r.violations for r in bad.collect()] == [["frames"], ["frames"]]
    with pytest.raises(Exception, match="broken contract"):
        C.enforce(df, C.interval_rules()).collect()


def test_leaks(spark):
    df = spark.createDataFrame([], "a struct<b:array<struct<gold_start:int>>>, m map<string,struct<gold_start:int>>")
    assert C.leaked_fields(df, ["gold_start"]) == ["a.b[].gold_start", "m{}.gold_start"]
    with pytest.raises(ValueError, match="forbidden"):
        C.assert_no_leak(df, ["gold_start"])
    assert one(spark, C.label_free(F.lit("a Drop"), ["drop"]))[0] is False


def test_review_table(spark):
    schema = (
        "technical_valid boolean, experimental_valid boolean, task_success boolean, intervention_verified boolean, physical_cause_gt string, evidence_answerability_gt string, diagnostic_decision_gt string, "
        "failure_interval struct<a:int>, supporting_robot_refs array<int>, supporting_manual_refs array<int>"
    )
    rows = [
        (True, True, True, None, "none_clean", "not_applicable_clean", "clean_success", None, [], []),
        (True, True, False, True, "gripper_close_timing", "answerable", "gripper_close_timing", (1,), [1], [1]),
        (True, True, False, True, "gripper_close_timing", "answerable", "gripper_close_timing", (1,), [], [1]),
        (True, True, False, None, "none_clean", "insufficient_evidence", "insufficient_evidence", (1,), [], []),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(C.violations(C.review_rules())).collect()]
    assert got == [[], [], ["cause"], ["insufficient"]]


def test_citations(spark):
    a = F.array(F.lit("x"), F.lit("x"), F.lit("z"))
    got = one(spark, E.citation_errors(a, F.array(F.lit("x")), F.lit(True)))[0]
    assert list(got) == ["duplicate_citations", "citation_outside_supplied_evidence=z", "abstain_requires_no_citation"]
    with pytest.raises(Exception, match="unknown"):
        m = F.create_map(F.lit("A"), E.ref(F.lit("s"), "pdf", page=F.lit(1)))
        one(spark, E.resolve_citations(F.array(F.lit("B")), m, F.lit(False)))


def test_zero_pages_fill_short_lists(spark):
    pages = spark.createDataFrame([("s", 1, "foo"), ("s", 2, "bar"), ("s", 3, "")], "source_id string, page_number int, text string")
    q = spark.createDataFrame([(1, "bar bar"), (2, "nothing")], "item_id int, text string")
    got = R.bm25_search(pages, q, 2, with_zeros=True).orderBy("item_id", "rank").collect()
    assert [(r.item_id, r.page_number) for r in got] == [(1, 2), (1, 1), (2, 1), (2, 2)]


def test_partition_invariance(spark):
    pages = spark.createDataFrame([("s", i, f"w{i % 7} w{i % 3} common") for i in range(60)], "source_id string, page_number int, text string")
    q = spark.createDataFrame([(1, "w1 w2 common"), (2, "w0 w0")], "item_id int, text string")
    a, b = ([tuple(r) for r in R.bm25_search(pages.repartition(n), q).orderBy("item_id", "rank").collect()] for n in (1, 7))
    assert a == b


def test_encoder_and_scorer(spark):
    df = spark.createDataFrame([("a b",), (None,)], "t string")
    got = df.select(F.size(inference.encoder(inference.hashing_encoder)(F.col("t")))).collect()
    assert [r[0] for r in got] == [64, 64]
    score = inference.scorer(lambda: lambda q, p: [float(len(x)) for x in p])
    assert [r[0] for r in df.select(score(F.col("t"), F.col("t"))).collect()] == [3.0, 0.0]


def test_model_contracts(spark, tmp_path):
    from tracelode.functions import inference

    class Model:
        def __init__(self, answer):
            self.answer = answer

        def __call__(self, batch):
            return [self.answer(x) for x in batch]

        def close(self):
            (tmp_path / "closed").write_text("yes")

    df = spark.createDataFrame([("a",), (None,), ("bb",)], "p string").coalesce(1)
    got = df.select(inference.generator(lambda: Model(str.upper))("p").alias("t")).collect()
    assert [r.t for r in got] == ["A", None, "BB"]
    assert (tmp_path / "closed").read_text() == "yes"
    files = df.selectExpr("cast(p as binary) AS b")
    got = files.select(inference.image_encoder(lambda: Model(lambda b: [[float(len(b)), 0.0]]))("b").alias("v")).collect()
    assert [r.v for r in got] == [[[1.0, 0.0]], None, [[2.0, 0.0]]]
    with pytest.raises(Exception, match="one finite matrix"):
        files.select(inference.image_encoder(lambda: Model(lambda b: [float("nan")]))("b")).collect()
    with pytest.raises(ValueError, match="visual tokens"):
        inference.visual_bounds(5, 4)
