"""Contracts on rows that keep and break them, readers and writers in round trips, and text functions, with their SQL."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import sources as IO
from ..functions import images as IM
from ..functions import numeric as N
from ..functions import text as X
from ..operators import artifacts as A
from ..operators import contracts as C
from ..operators import evidence as E
from ..operators import protocol as P
from ..operators import reviews as W
from ..operators import splits as SP
from . import curation, episodes
from . import views as V

def _id() -> Column:
    return F.col("doc_id")


def _sha() -> Column:
    return F.sha2(F.col("doc_id").cast("string"), 256)


def _rows(s, d) -> DataFrame:
    return V.table(s, d, "documents").select("doc_id", "text", "lang", "source")


def _broken(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    return df.select("doc_id", F.array_join(C.violations(rules), ",").alias("violations"))


def contract_bbox(s, d):
    i = _id()
    b = F.struct((i % 5 / 10.0).alias("x1"), F.lit(0.1).alias("y1"), (F.when(i % 7 == 0, 1.5).otherwise(0.35)).alias("x2"), F.when(i % 3 == 0, 0.1).otherwise(0.9).alias("y2"))
    return _broken(_rows(s, d).withColumn("bbox", b), C.bbox_rules())


def _refs(s, d):
    i = _id()
    kind = F.when(i % 3 == 0, "pdf").when(i % 3 == 1, "robot_sequence").otherwise("image")
    r = F.struct(
        kind.alias("source_type"), F.when(i % 6 != 0, i).alias("page_number"), F.when(i % 4 != 0, i * 1.0).alias("time_start_sec"), F.when(i % 5 == 0, i - 1.0).otherwise(i + 1.0).alias("time_end_sec"),
        F.when(i % 2 == 0, i).alias("frame_index"), F.when(i % 8 != 0, "front").alias("camera"),
    )
    return _rows(s, d).withColumn("ref", r)


def contract_ref(s, d):
    return _broken(_refs(s, d), C.ref_rules())


def contract_manifest(s, d):
    i = _id()
    x = _rows(s, d).withColumns({
        "source_type": F.when(i % 2 == 0, "pdf").otherwise("image"), "page_count": F.when(i % 6 != 0, 3), "width_px": F.lit(4), "height_px": F.when(i % 5 != 0, 4),
        "sha256": F.when(i % 7 == 0, F.upper(_sha())).otherwise(_sha()), "size_bytes": F.when(i % 11 == 0, -1).otherwise(i),
    })
    return _broken(x, C.manifest_rules())


def contract_eval_case(s, d):
    i = _id()
    x = _rows(s, d).withColumns({
        "annotation_status": F.when(i % 4 == 0, "draft").otherwise("verified"), "answerable": F.when(i % 9 != 1, i % 2 == 0), "expected_answer": F.when(i % 5 == 0, " ").otherwise("a"),
        "expected_evidence": F.when(i % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("e"))), "verified_by": F.when(i % 7 != 0, "r"), "verified_at": F.lit("2020"),
    })
    return _broken(x, C.eval_case_rules())


def contract_slice(s, d):
    i = _id()
    x = _rows(s, d).withColumns({
        "start_sec": i * 1.0, "end_sec": F.when(i % 5 == 0, i * 1.0).otherwise(i + 2.0), "midpoint_timestamp_sec": F.when(i % 7 == 0, i + 2.0).otherwise(i + 1.0), "start_frame_index": i,
        "midpoint_frame_index": F.when(i % 3 == 0, i - 1).otherwise(i + 1), "end_frame_index_exclusive": i + 4,
    })
    return _broken(x, C.slice_rules())


def contract_selection(s, d):
    i = _id()
    x = _rows(s, d).withColumns({"start_sec": i * 1.0, "end_sec": i + 2.0, "selected_timestamp_sec": F.when(i % 4 == 0, i + 2.0).otherwise(i * 1.0), "a": F.lit(1.0), "b": i * 1.0, "fused": F.when(i % 3 == 0, 0.5).otherwise(F.greatest(F.lit(1.0), i * 1.0))})
    return _broken(x, C.selection_rules(("a", "b"), "fused"))


def contract_keyframe(s, d):
    i = _id()
    x = _rows(s, d).withColumns({"shared_sample_budget": F.when(i % 3 == 0, 5).otherwise(i * 2), "evidence_image_budget": F.when(i % 4 == 0, 0).otherwise(F.when(i % 3 == 0, 5).otherwise(i * 2) * 2)})
    return _broken(x, C.keyframe_rules(2, i))


def contract_annotation(s, d):
    i = _id()
    x = _rows(s, d).withColumns({
        "status": F.when(i % 2 == 0, "draft").otherwise("verified"), "start_frame_index": F.when(i % 5 != 0, i), "end_frame_index_inclusive": F.when(i % 3 == 0, i - 1).otherwise(i),
        "evidence_cameras": F.when(i % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("front"))),
    })
    return _broken(x, C.annotation_rules())


def contract_episode(s, d):
    i = _id()
    cam = lambda n, k: F.struct(F.lit(n).alias("camera"), k.alias("frame_count"))
    n = F.when(i % 5 == 0, i + 1).otherwise(i)
    x = _rows(s, d).withColumns({"frame_count": i, "cameras": F.when(i % 3 == 0, F.array(cam("wrist", i), cam("front", i))).otherwise(F.array(cam("front", i), cam("wrist", n)))})
    return _broken(x, C.episode_rules())


def contract_provenance(s, d):
    i = _id()
    x = _rows(s, d).withColumn("provenance", F.struct(F.create_map(F.lit("a"), _sha(), F.lit("b"), F.when(i % 4 == 0, "none").otherwise(_sha())).alias("supporting_sha256")))
    return _broken(x, C.provenance_rules())


def _items(s, d):
    i = _id()
    frame = F.when(i % 5 == 0, i + 1).otherwise(i)
    page = E.ref(F.col("source"), "pdf", page=i)
    cameras = F.array(*[E.ref(F.col("source"), "robot_sequence", frame=f, camera=c, time=i * 1.0) for f, c in ((i, "front"), (frame, "wrist"))])
    document = F.struct(i.alias("page_number"))
    robot = F.struct(i.alias("frame_index"))
    is_page = i % 2 == 0
    item = F.struct(
        F.concat(F.lit("e"), (i - i % 3 % 2).cast("string")).alias("evidence_id"), F.when(is_page, "document_page").otherwise("robot_sample").alias("kind"),
        F.when(is_page, F.when(i % 6 == 0, F.array(page, page)).otherwise(F.array(page))).otherwise(cameras).alias("refs"),
        F.when(is_page, document).alias("document"), F.when(~is_page | (i % 10 == 0), robot).alias("robot"),
    )
    return _rows(s, d).withColumn("item", item)


def contract_item(s, d):
    return _broken(_items(s, d), C.item_rules())


def contract_bundle(s, d):
    i = _id()
    x = _items(s, d).where("doc_id % 2 = 1")
    other = F.struct(F.when(i % 3 == 0, F.col("item.evidence_id")).otherwise("x").alias("evidence_id"), F.when(i % 5 == 0, F.col("item.refs")).otherwise(F.array().cast(f"array<{E.REF}>")).alias("refs"))
    items = F.when(i % 7 == 0, F.array().cast(f"array<struct<evidence_id:string,refs:array<{E.REF}>>>")).otherwise(F.array(F.struct("item.evidence_id", "item.refs"), other))
    return _broken(x.withColumn("items", items), C.bundle_rules())


def contract_audit(s, d):
    i = _id()
    x = _rows(s, d).withColumns({
        "audit_category": F.when(i % 3 == 0, "technical_exclusion").when(i % 3 == 1, "operation_anomaly").otherwise("clean_reference_candidate"), "diagnostic_eligible": i % 6 == 0,
        "exclusion_reason": F.when(i % 9 != 0, "r"), "observed_failure_modes": F.when(i % 4 == 0, F.array(F.lit("m"))).otherwise(F.array().cast("array<string>")),
    })
    return _broken(x, C.audit_rules())


def contract_review(s, d):
    i = _id()
    clean, insufficient = i % 3 == 0, i % 3 == 1
    decision = F.when(clean, "clean_success").when(insufficient, "insufficient_evidence").otherwise("gripper_close_timing")
    x = _rows(s, d).withColumns({
        "technical_valid": i % 13 != 0, "experimental_valid": F.lit(True), "diagnostic_decision_gt": decision, "task_success": F.when(i % 5 == 0, ~clean).otherwise(clean),
        "physical_cause_gt": F.when(clean | (i % 7 == 0), "none_clean").otherwise("gripper_close_timing"), "intervention_verified": ~clean & (i % 4 != 0),
        "evidence_answerability_gt": F.when(clean, "not_applicable_clean").when(insufficient, "insufficient_evidence").otherwise("answerable"),
        "failure_interval": F.when(~clean, F.struct(i.alias("start_frame"), i.alias("end_frame"))), "supporting_robot_refs": F.array(F.lit("r")), "supporting_manual_refs": F.array(F.lit("m")),
    })
    return _broken(x, C.review_rules())


def _recordings(s, d):
    i = _id()
    return _rows(s, d).withColumns({
        "completed": i % 3 != 0, "aborted": i % 4 == 0, "error": F.when(i % 5 == 0, "e"), "checks": F.create_map(F.lit("a"), i % 6 != 0, F.lit("b"), i % 7 != 0),
        "valid_for_training": i % 8 != 0, "overall_pass": F.lit(True), "sample_count": i, "settings": F.struct((F.when(i % 9 == 0, i + 1).otherwise(i)).alias("expected_sample_count"), F.create_map(F.lit("front"), F.lit("ccw90")).alias("camera_transforms")),
    })


def contract_ingest(s, d):
    return _broken(_recordings(s, d), C.ingest_rules(["a"]))


def contract_strict_ingest(s, d):
    return _broken(_recordings(s, d).withColumn("expected_sample_count", F.col("settings.expected_sample_count")), C.strict_ingest_rules())


def recording_settings(s, d):
    x = _recordings(s, d).where("doc_id > 0")
    t = W.camera_transforms(F.col("settings"))
    return x.select("doc_id", t["front"].alias("front"), t["wrist"].alias("wrist"), W.required_count(F.col("settings")).alias("n"))


def contract_retrieval(s, d):
    i = _id()
    x = _rows(s, d).withColumns({
        "document_gold_pages": F.when(i % 3 == 0, F.array(i, i)).otherwise(F.array(i, i + 1)), "question": F.lit("what?"), "bundle_question": F.when(i % 4 == 0, "other?").otherwise(" what? "),
        "items": F.sequence(F.lit(0), (i % 5).cast("int")),
    })
    return _broken(x, dict(C.retrieval_case_rules()) | dict(C.retrieved_bundle_rules(3)))


def oriented_images(s, d):
    i = _id()
    rows = F.array(F.array(i * 1.0, i + 1.0, i + 2.0), F.array(i + 3.0, i + 4.0, i + 5.0))
    name = F.element_at(F.array(*[F.lit(n) for n in ("none", "ccw90", "cw90", "180", "odd")]), (i % 5 + 1).cast("int"))
    out = IM.orient(rows, name)
    strict = F.size(IM.orient(rows, F.when(i % 2 == 0, "ccw90").otherwise("none"), strict=True))
    same = IM.verified(F.col("text").cast("binary"), F.sha2(F.col("text"), 256))
    flat = F.array_join(F.transform(F.flatten(out), lambda v: (v - i).cast("int").cast("string")), ",")
    return _rows(s, d).select("doc_id", F.size(out).alias("height"), flat.alias("pixels"), strict.alias("strict_height"), IM.grey(i % 256, (i * 7) % 256, (i * 13) % 256).alias("grey"), F.octet_length(same).alias("n_bytes"))


def contract_pack(s, d):
    i = _id()
    event = F.struct(F.when(i % 5 == 0, "verified").otherwise("draft").alias("event_status"), F.when(i % 6 == 0, "cause").alias("causal_diagnosis"))
    frames = F.when(i % 3 == 0, F.array(i, i)).when(i % 4 == 0, F.array(i + 2, i)).when(i % 7 == 0, F.sequence(i, i + 5)).otherwise(F.array(i, i + 2))
    return _broken(_rows(s, d).withColumns({"frames": frames, "events": F.array(event)}), W.pack_rules(4))


def contract_seal(s, d):
    i = _id()
    x = _rows(s, d).withColumns({"status": F.when(i % 3 == 0, "open").otherwise("frozen"), "seal": F.struct((i % 4 == 0).alias("tuned"), F.when(i % 5 == 0, "x").otherwise(F.sha2(F.lit("m"), 256)).alias("sha256"))})
    return _broken(x, dict(A.flag_rules({"status": "frozen", "seal.tuned": False})) | A.digest_rules({"seal.sha256": "62c66a7a5dd70c3146618063c344e531e6d4b59e379808443ce962b3abd63c5a"}))


def label_free_queries(s, d):
    i = _id()
    return _rows(s, d).select("doc_id", C.label_free(F.col("text"), ["License", "Und "]).alias("label_free"), F.array_join(C.leaked_keys(F.create_map(F.lit("gold_frame"), i, F.col("lang"), i), ["gold_frame", "de"]), ",").alias("leaked"))


def plan_checks(s, d):
    plan = P.collection_plan(s)
    return P.plan_violations(plan.where("not (plan_row_id = 'rcv2_g03_s02')").withColumn("repeat_slot", F.col("repeat_slot") | F.col("plan_row_id").isin("rcv2_g05_s01")))


# --- round trips: what is read back is what was written ---


def jsonl_pages(s, d):
    path = IO.scratch_folder(s)
    c = X.page_columns(F.col("text"))
    IO.write_jsonl(V.pages(s, d).select("source_id", F.col("page_number").cast("int").alias("page_number"), c["text"].alias("text"), c["text_sha256"].alias("text_sha256"), c["char_count"].alias("char_count")), path)
    return IO.read_jsonl(s, path, IO.PAGE).select("source_id", "page_number", (F.sha2("text", 256) == F.col("text_sha256")).alias("same"), "char_count")


def jsonl_frames(s, d):
    path = IO.scratch_folder(s)
    x = V.samples(s, d).select(F.col("episode_id").cast("string").alias("episode_id"), F.lit("front").alias("camera"), F.col("frame_index").cast("long").alias("frame_index"), "timestamp_sec", F.sha2(F.col("event_id").cast("string"), 256).alias("image_sha256"))
    IO.write_jsonl(x, path)
    return IO.read_jsonl(s, path, IO.FRAME).select("episode_id", "camera", "frame_index", "timestamp_sec", "image_sha256", F.col("width_px").isNull().alias("no_width"))


def parquet_frames(s, d):
    path = IO.scratch_folder(s)
    x = V.samples(s, d).select("episode_id", "frame_index", F.lit("front").alias("camera"), "value")
    IO.write_frames(x, path)
    return s.read.parquet(path).select(F.col("episode_id").cast("long").alias("episode_id"), "frame_index", "camera", "value")


def jsonl_annotations(s, d):
    path = IO.scratch_folder(s)
    x = V.annotated(V.samples(s, d)).select(
        F.col("event_id").cast("string").alias("event_id"), F.col("episode_id").cast("string").alias("episode_id"), F.col("mode").alias("event_type"), F.lit("verified").alias("status"),
        F.col("start_frame").cast("long").alias("start_frame_index"), F.col("end_frame").cast("long").alias("end_frame_index_inclusive"), F.array(F.lit("front")).alias("evidence_cameras"),
    )
    IO.write_jsonl(x, path)
    return IO.read_jsonl(s, path, IO.ANNOTATION).select("event_id", "episode_id", "event_type", "status", "start_frame_index", "end_frame_index_inclusive", F.array_join("evidence_cameras", "|").alias("cameras"))


def jsonl_slices(s, d):
    from ..operators import timeseries as TS

    path = IO.scratch_folder(s)
    x = TS.tumbling_slices(V.samples(s, d), V.DAY, "skip")
    IO.write_jsonl(x.select(F.concat_ws("_", "episode_id", "slice_index").alias("slice_group_id"), F.col("episode_id").cast("string").alias("episode_id"), "start_sec", "end_sec", "start_frame_index", "end_frame_index_exclusive", "midpoint_frame_index"), path)
    return IO.read_jsonl(s, path, IO.SLICE).select("slice_group_id", "episode_id", "start_sec", "end_sec", "start_frame_index", "end_frame_index_exclusive", "midpoint_frame_index")


def jsonl_bad_lines(s, d):
    i = _id()
    path = IO.scratch_folder(s)
    line = F.when(i % 3 == 0, "{\"a\": 1").when(i % 3 == 1, "  ").otherwise(F.concat(F.lit("{\"a\": "), i.cast("string"), F.lit("}")))
    _rows(s, d).select(line.alias("value")).write.text(path)
    return IO.bad_lines(s, path).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def samples_csv(s, d):
    path = IO.scratch_folder(s)
    x = V.samples(s, d).where("frame_index < 20")
    signals = {}
    for k, j in enumerate(IO.JOINTS):
        o, a = F.col("value") + k, F.col("k") - k
        signals |= {f"observation_{j}": o, f"action_{j}": a, f"tracking_error_{j}": F.abs(a - o)}
    whole = {n: F.lit(1).cast("long") for n in ("front_sequence", "wrist_sequence", "front_source_timestamp_ns", "wrist_source_timestamp_ns")}
    x = x.select(
        F.format_string("%04d", F.col("episode_id").cast("int")).alias("episode"), F.col("frame_index").cast("long").alias("frame_index"), (F.col("timestamp_sec") * 1e9).cast("long").alias("sample_timestamp_ns"),
        (F.col("frame_index").cast("long") * 1000000000).alias("elapsed_ns"), *[c.alias(n) for n, c in whole.items()], F.lit(0.5).alias("front_age_ms"), F.lit(0.25).alias("wrist_age_ms"),
        F.lit("f.png").alias("front_image"), F.lit("w.png").alias("wrist_image"), *[c.alias(n) for n, c in signals.items()],
    )
    names = [f.name for f in IO.sample_schema()]
    x.select("episode", *names).repartition("episode").write.partitionBy("episode").option("header", True).csv(path)
    out = IO.read_samples(s, f"{path}/*/*.csv")
    return out.select(F.regexp_extract("episode_id", "([0-9]+)$", 1).alias("episode_id"), "frame_index", "timestamp_sec", F.round(F.col("observation")[1] - F.col("action")[1], 6).alias("gap"), "front_image")


def manifest_csv(s, d):
    path = IO.scratch_folder(s)
    t = V.table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("episode_id"), F.when(F.col("n_nationkey") % 2 == 0, "TRUE").otherwise("no").alias("technical_valid"), F.when(F.col("n_nationkey") % 3 == 0, " nan ").otherwise(F.concat(F.lit(" 失败 "), "n_name")).alias("notes"))
    s.conf.set("spark.sql.legacy.javaCharsets", "true")
    t.write.option("header", True).option("encoding", "gb18030").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    out = IO.read_manifest_csv(s, path)
    return out.select("episode_id", SP.parse_bool(F.col("technical_valid")).alias("technical_valid"), SP.optional_text(F.col("notes")).alias("notes"))


def plan_csv(s, d):
    path = IO.scratch_folder(s)
    IO.write_plan(P.collection_plan(s), path)
    return IO.read_plan(s, path)


def bound_sources(s, d):
    path = IO.scratch_folder(s)
    V.table(s, d, "region").select(F.col("r_name").alias("value")).coalesce(1).sortWithinPartitions("value").write.text(path)  # five rows
    return IO.bind_sources(s, f"{path}/part-*").select("sha256", "size_bytes")


def split_page_files(s, d):
    i = _id()
    docs = _rows(s, d).select(F.concat(F.lit("d"), i.cast("string")).alias("source_id"), F.col("text").cast("binary").alias("content")).where("content is not null")
    return IO.split_pages(docs, lambda raw: raw.decode().split("\n"), nfkc=True).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("char_count").alias("chars"))


def template_upsert(s, d):
    old = V.table(s, d, "nation").where("n_nationkey < 15").select("n_nationkey", F.lit("old").alias("text"), (F.col("n_nationkey") % 2 == 0).alias("edited"))
    new = V.table(s, d, "nation").where("n_nationkey > 4").select("n_nationkey", F.lit("new").alias("text"), F.lit(False).alias("edited"))
    return IO.upsert(old, new, "n_nationkey", "edited")


def png_sizes(s, d):
    i = _id()
    head = F.unhex(F.lit("89504E470D0A1A0A0000000D49484452"))
    png = F.concat(head, F.unhex(F.lpad(F.hex(i + 1), 8, "0")), F.unhex(F.lpad(F.hex(i * 2 + 3), 8, "0")))
    size = IO.image_size(F.when(i % 5 == 0, F.encode(F.lit("GIF89a"), "UTF-8")).otherwise(png))
    return _rows(s, d).select("doc_id", size["width_px"].alias("width_px"), size["height_px"].alias("height_px"))


# --- functions ---


def tokenize_cjk(s, d):
    """Texts with full-width letters and Chinese words: both are folded or cut into characters and pairs."""
    i = _id()
    han = F.array_join(F.transform(F.sequence(F.lit(0), (i % 4).cast("int")), lambda k: F.decode(F.unhex(F.concat(F.lit("E4B8"), F.hex(F.lit(128) + (i + k) % 64))), "UTF-8")), "")
    t = F.concat(F.lit("ＡＢ１ v"), (i % 10).cast("string"), F.lit(".2　"), han, F.lit(" End"))
    tokens = X.tokenize_mixed(t)
    return _rows(s, d).select("doc_id", F.array_join(tokens, "|").alias("tokens"), X.compact_text(t).alias("compact"))


def strict_answers(s, d):
    i = _id()
    body = F.concat(F.lit('{"answer": "a'), i.cast("string"), F.lit('", "abstain": '), F.when(i % 2 == 0, "true").otherwise("false"), F.when(i % 5 == 0, F.lit(', "extra": 1}')).otherwise(F.lit("}")))
    raw = F.when(i % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(i % 7 == 0, F.lit("no object")).otherwise(body)
    p = X.parse_strict(raw, "answer string, abstain boolean", ["answer", "abstain"])
    return _rows(s, d).select("doc_id", p["answer"].alias("answer"), p["abstain"].alias("abstain"))


def resolved_citations(s, d):
    i = _id()
    refs = {f"D{k}": E.ref(F.col("source"), "pdf", page=F.lit(k).cast("long")) for k in range(3)}
    aliases = F.create_map(*[x for n, r in refs.items() for x in (F.lit(n), r)])
    abstain = i % 4 == 0
    ids = F.when(abstain, F.array().cast("array<string>")).otherwise(F.array(F.lit("D2"), F.concat(F.lit("D"), (i % 2).cast("string"))))
    out = E.resolve_citations(ids, aliases, abstain)
    return _rows(s, d).select("doc_id", F.array_join(F.transform(out, lambda r: r["page_number"].cast("string")), ",").alias("pages"))


def stored_paths(s, d):
    i = _id()
    p = F.concat(F.when(i % 2 == 0, "/data/root/").otherwise("/other/"), "source", F.lit(".bin"))
    kept = X.stored_path(p, "/data/root")
    return _rows(s, d).select("doc_id", kept.alias("stored"), IO.resolve_path(kept, "/data/root").alias("resolved"))


def joint_maps(s, d):
    i = _id()
    m = W.joint_map(F.array((i / 7.0), i * 1.0), ["wrist", "gripper"])
    return _rows(s, d).select("doc_id", m["wrist"].alias("wrist"), m["gripper"].alias("gripper"), W.close(m["wrist"], i / 7.0, 1e-5).alias("close"), N.point_distance(i / 7.0, F.lit(2.0), F.lit(5.0)).alias("distance"))


QUERIES = {f.__name__: f for f in (
    contract_bbox, contract_ref, contract_manifest, contract_eval_case, contract_slice, contract_selection, contract_keyframe, contract_annotation, contract_episode, contract_provenance, contract_item,
    contract_bundle, contract_audit, contract_review, contract_ingest, contract_strict_ingest, recording_settings, contract_retrieval, oriented_images, contract_pack, contract_seal, label_free_queries, plan_checks, jsonl_pages, jsonl_frames,
    parquet_frames, jsonl_annotations, jsonl_slices, jsonl_bad_lines, samples_csv, manifest_csv, plan_csv, bound_sources, split_page_files, template_upsert, png_sizes, tokenize_cjk, strict_answers,
    resolved_citations, stored_paths, joint_maps,
)}


def _sql(**kept: str) -> str:
    """doc_id and the names of the conditions that a row does not keep; an unknown condition is broken."""
    cases = ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in kept.items())
    return f"SELECT doc_id, array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',') AS violations FROM documents"


M = "doc_id % {} {} 0".format
HAN = "array_to_string(list_transform(range(0, doc_id % 4 + 1), lambda k: chr((19968 + (doc_id + k) % 64)::INT)), '')"
ORACLE_SQL = {
    "contract_bbox": _sql(bbox_unit=M(7, "<>"), bbox_order="doc_id % 5 / 10.0 < CASE WHEN doc_id % 7 = 0 THEN 1.5 ELSE 0.35 END AND doc_id % 3 <> 0"),
    "contract_ref": _sql(
        pdf_page="doc_id % 3 <> 0 OR doc_id % 6 <> 0", time_order="doc_id % 4 = 0 OR doc_id % 5 <> 0", robot_place="doc_id % 3 <> 1 OR doc_id % 4 <> 0 OR doc_id % 2 = 0",
        frame_camera="doc_id % 2 <> 0 OR doc_id % 8 <> 0"),
    "contract_manifest": _sql(pdf_pages="doc_id % 2 <> 0 OR doc_id % 6 <> 0", image_size="doc_id % 2 = 0 OR doc_id % 5 <> 0", sha256=M(7, "<>"), size=M(11, "<>")),
    "contract_eval_case": _sql(
        label="doc_id % 4 = 0 OR doc_id % 9 <> 1", answer="doc_id % 4 = 0 OR doc_id % 9 = 1 OR doc_id % 2 <> 0 OR doc_id % 5 <> 0", evidence="doc_id % 4 = 0 OR doc_id % 9 = 1 OR doc_id % 2 <> 0 OR doc_id % 6 <> 0",
        reviewer="doc_id % 4 = 0 OR doc_id % 7 <> 0"),
    "contract_slice": _sql(duration=M(5, "<>"), midpoint="doc_id % 5 <> 0 AND doc_id % 7 <> 0", frames=M(3, "<>")),
    "contract_selection": _sql(inside=M(4, "<>"), fused=M(3, "<>")),
    "contract_keyframe": _sql(k="true", samples=M(3, "<>"), images="doc_id % 4 <> 0 OR (doc_id = 0 AND doc_id % 3 <> 0)"),
    "contract_annotation": _sql(interval="doc_id % 2 = 0 OR (doc_id % 5 <> 0 AND doc_id % 3 <> 0)", cameras=M(7, "<>")),
    "contract_episode": _sql(order=M(3, "<>"), counts="doc_id % 3 = 0 OR doc_id % 5 <> 0"),
    "contract_provenance": _sql(supporting=M(4, "<>")),
    "contract_item": _sql(payload="doc_id % 2 = 1 OR doc_id % 10 <> 0", refs="doc_id % 2 = 1 OR doc_id % 6 <> 0", frames="doc_id % 2 = 0 OR doc_id % 5 <> 0"),
    "contract_bundle": _sql(some=M(7, "<>"), ids="doc_id % 7 = 0 OR doc_id % 3 <> 0", refs="doc_id % 7 = 0 OR doc_id % 5 <> 0") + " WHERE doc_id % 2 = 1",
    "contract_audit": _sql(technical="doc_id % 3 <> 0 OR (doc_id % 6 <> 0 AND doc_id % 9 <> 0)", anomaly="doc_id % 3 <> 1 OR doc_id % 4 = 0", modes="doc_id % 3 = 1 OR doc_id % 4 <> 0"),
    "contract_review": _sql(
        valid=M(13, "<>"), clean="doc_id % 3 <> 0 OR doc_id % 5 <> 0", failed="doc_id % 3 = 0 OR doc_id % 5 <> 0", insufficient="doc_id % 3 <> 1 OR doc_id % 7 <> 0",
        cause="doc_id % 3 <> 2 OR (doc_id % 7 <> 0 AND doc_id % 4 <> 0)"),
    "contract_ingest": _sql(completed=M(3, "<>"), not_aborted=M(4, "<>"), no_error=M(5, "<>"), checks=M(7, "<>")),
    "contract_strict_ingest": _sql(
        completed=M(3, "<>"), not_aborted=M(4, "<>"), no_error=M(5, "<>"), checks="doc_id % 6 <> 0 AND doc_id % 7 <> 0", training=M(8, "<>"), overall="true", count=M(9, "<>")),
    "recording_settings": "SELECT doc_id, 'ccw90' AS front, 'none' AS wrist, CASE WHEN doc_id % 9 = 0 THEN doc_id + 1 ELSE doc_id END AS n FROM documents WHERE doc_id > 0",
    "contract_retrieval": _sql(unique_gold=M(3, "<>"), question=M(4, "<>"), size="doc_id % 5 + 1 <= 3"),
    "oriented_images": """SELECT doc_id, CASE WHEN doc_id % 5 IN (1, 2) THEN 3 ELSE 2 END AS height,
  CASE doc_id % 5 WHEN 1 THEN '2,5,1,4,0,3' WHEN 2 THEN '3,0,4,1,5,2' WHEN 3 THEN '5,4,3,2,1,0' ELSE '0,1,2,3,4,5' END AS pixels, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END AS strict_height,
  ((doc_id % 256 * 19595 + (doc_id * 7) % 256 * 38470 + (doc_id * 13) % 256 * 7471 + 32768) // 65536)::INT AS grey, strlen(text) AS n_bytes FROM documents""",
    "contract_pack": _sql(order="doc_id % 3 = 0 OR doc_id % 4 <> 0", unique=M(3, "<>"), cap="doc_id % 3 = 0 OR doc_id % 4 = 0 OR doc_id % 7 <> 0", draft=M(5, "<>"), unset=M(6, "<>")),
    "contract_seal": _sql(status=M(3, "<>"), seal_tuned=M(4, "<>"), seal_sha256=M(5, "<>")),
    "label_free_queries": "SELECT doc_id, NOT (contains(lower(text), 'license') OR contains(lower(text), 'und ')) AS label_free, CASE WHEN lang = 'de' THEN 'gold_frame,de' ELSE 'gold_frame' END AS leaked FROM documents",
    "plan_checks": "SELECT * FROM (VALUES ('rcv2_g03', 5, 1, 3, 1, 1, 5), ('rcv2_g05', 6, 1, 4, 1, 2, 6)) t(pair_group_id, n, controls, causes, ambiguous, repeats, slots)",
    "jsonl_pages": rf"WITH {V.PAGES} SELECT source_id, page_number, true AS same, length(trim(regexp_replace(text, '[\x09-\x0D\x1C-\x20]+', ' ', 'g'))) AS char_count FROM pg",
    "jsonl_frames": f"WITH {V.SAMPLES} SELECT episode_id::VARCHAR AS episode_id, 'front' AS camera, frame_index, timestamp_sec, sha256(event_id::VARCHAR) AS image_sha256, true AS no_width FROM s",
    "parquet_frames": f"WITH {V.SAMPLES} SELECT episode_id, frame_index, 'front' AS camera, value FROM s",
    "jsonl_annotations": f"WITH {V.SAMPLES} SELECT event_id::VARCHAR AS event_id, episode_id::VARCHAR AS episode_id, mode AS event_type, 'verified' AS status, start_frame AS start_frame_index, end_frame AS end_frame_index_inclusive, 'front' AS cameras FROM an",
    "jsonl_slices": f"""WITH {V.SAMPLES}, {episodes.SLICES} SELECT episode_id || '_' || slice_index AS slice_group_id, episode_id::VARCHAR AS episode_id, slice_index * 86400.0::DOUBLE AS start_sec,
  (slice_index + 1) * 86400.0::DOUBLE AS end_sec, f0 AS start_frame_index, f1 AS end_frame_index_exclusive, mf AS midpoint_frame_index FROM sr""",
    "jsonl_bad_lines": """SELECT '{"a": 1' AS line, count(*) AS n FROM documents WHERE doc_id % 3 = 0""",
    "samples_csv": f"""WITH {V.SAMPLES} SELECT printf('%04d', episode_id::INT) AS episode_id, frame_index, frame_index::DOUBLE AS timestamp_sec, round((value + 1) - (k - 1), 6) AS gap, 'f.png' AS front_image FROM s WHERE frame_index < 20""",
    "manifest_csv": "SELECT n_nationkey::VARCHAR AS episode_id, n_nationkey % 2 = 0 AS technical_valid, CASE WHEN n_nationkey % 3 <> 0 THEN '失败 ' || n_name END AS notes FROM nation",
    "plan_csv": f"WITH {curation.PLAN} SELECT * FROM p",
    "bound_sources": "SELECT sha256(string_agg(r_name || chr(10), '' ORDER BY r_name)) AS sha256, sum(length(r_name) + 1)::BIGINT AS size_bytes FROM region",
    "split_page_files": r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) SELECT 'd' || doc_id AS source_id, count(*) AS n_pages,
  sum(length(trim(regexp_replace(t, '[\x09-\x0D\x1C-\x20]+', ' ', 'g'))))::BIGINT AS chars FROM p GROUP BY doc_id""",
    "template_upsert": """SELECT n_nationkey, CASE WHEN n_nationkey < 15 AND (n_nationkey % 2 = 0 OR n_nationkey <= 4) THEN 'old' ELSE 'new' END AS text,
  CASE WHEN n_nationkey < 15 AND n_nationkey % 2 = 0 THEN true ELSE false END AS edited FROM nation""",
    "png_sizes": "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN doc_id + 1 END AS width_px, CASE WHEN doc_id % 5 <> 0 THEN doc_id * 2 + 3 END AS height_px FROM documents",
    "tokenize_cjk": f"""WITH h AS (SELECT doc_id, {HAN} AS han FROM documents), c AS (SELECT doc_id, han, list_transform(range(1, length(han) + 1), lambda i: han[i]) AS chars, list_transform(range(1, length(han)), lambda i: substring(han, i, 2)) AS pairs FROM h)
SELECT doc_id, array_to_string(list_concat(list_concat(['ab1', 'v' || (doc_id % 10) || '.2', 'end'], chars), pairs), '|') AS tokens, 'ab1v' || (doc_id % 10) || '.2' || han || 'end' AS compact FROM c""",
    "strict_answers": """SELECT doc_id, CASE WHEN doc_id % 5 <> 0 AND (doc_id % 3 = 0 OR doc_id % 7 <> 0) THEN 'a' || doc_id END AS answer, CASE WHEN doc_id % 5 <> 0 AND (doc_id % 3 = 0 OR doc_id % 7 <> 0) THEN doc_id % 2 = 0 END AS abstain FROM documents""",
    "resolved_citations": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE '2,' || (doc_id % 2) END AS pages FROM documents",
    "stored_paths": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '.bin' ELSE '/other/' || source || '.bin' END AS stored, CASE WHEN doc_id % 2 = 0 THEN '/data/root/' ELSE '/other/' END || source || '.bin' AS resolved FROM documents""",
    "joint_maps": "SELECT doc_id, round(doc_id / 7.0::DOUBLE, 6) AS wrist, doc_id::DOUBLE AS gripper, true AS close, greatest(2.0::DOUBLE - doc_id / 7.0::DOUBLE, doc_id / 7.0::DOUBLE - 5.0::DOUBLE, 0) AS distance FROM documents",
}
