"""Review packs: pages, index, manifest and their checks."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tracelode.operators import review_pages as P
from tracelode.operators import reviews as W
from tracelode.plans import packs
from tracelode.sources import images

STATUS = "episode_id string, source_status string, source_overall_pass boolean, source_failed_checks array<string>"


def _cases(spark, *ids):
    audit = spark.createDataFrame(
        [(i, False, "fell <b>", ["drop", "late"], "operation_anomaly") for i in ids], "episode_id string, task_success boolean, failure_reason string, observed_failure_modes array<string>, audit_category string"
    )
    return W.review_cases(audit, "m", "p")


def _frames(spark, *rows):
    schema = "episode_id string, frame_index int, timestamp_sec double, reasons array<string>, metrics map<string,double>, observation array<double>, action array<double>, tracking_error array<double>, front binary, wrist binary"
    return spark.createDataFrame(list(rows), schema)


def test_packs(spark):
    picture = images.png(np.zeros((2, 2), np.uint8))
    frames = _frames(
        spark, ("e", 9, 0.9, ["b"], {}, [1.0], [None], [], picture, None), ("e", 2, 0.2, ["<a>"], {"z": 1.0, "a": 0.5}, [1.0], [2.0], [1.0], None, None), ("other", 1, 0.1, [], None, [], [], [], None, None),
    )
    audit = spark.createDataFrame([("e", "ok", True, []), ("none", None, None, None), ("left", "ok", True, [])], STATUS)
    got = {r.episode_id: r for r in P.packs(_cases(spark, "e", "none"), audit, frames, ["j"], images=True).collect()}
    assert set(got) == {"e", "none"}
    e = got["e"]
    assert (e.frames, e.selected_frame_count, e.event_count, e.observed_failure_modes, e.all_draft, e.all_unset) == ([2, 9], 2, 2, ["drop", "late"], True, True)
    assert "fell &lt;b&gt;" in e.html and "Picked by: &lt;a&gt;" in e.html and "a=0.50000; z=1.00000" in e.html and "Metrics: none" in e.html
    assert "<td>1.0000</td><td>2.0000</td><td>1.0000</td>" in e.html and "<td>1.0000</td><td>-</td><td>-</td>" in e.html
    assert e.html.count("data:image/png;base64,") == 1 and e.html.index("frame-2") < e.html.index("frame-9")
    assert got["none"].frames == [] and got["none"].html.endswith("</body></html>")
    bound = spark.createDataFrame([("e", "bound", False, ["age"])], STATUS)
    assert P.packs(_cases(spark, "e"), audit, frames, ["j"], bound).first().source_failed_checks == ["age"]


def test_packs_refuse(spark):
    audit = spark.createDataFrame([("e", "ok", True, [])], STATUS)
    with pytest.raises(Exception, match="no source audit"):
        P.packs(_cases(spark, "x"), audit, _frames(spark), ["j"]).collect()
    with pytest.raises(Exception, match="two review cases"):
        P.packs(_cases(spark, "e", "e"), audit, _frames(spark), ["j"]).collect()


def test_empty_and_written(spark, tmp_path):
    audit = spark.createDataFrame([("a", "ok", True, []), ("b", "ok", True, [])], STATUS)
    none = P.packs(_cases(spark, "a").limit(0), audit, _frames(spark), ["j"])
    assert P.manifest(none).select("pack_count", "event_count", "multi_event_count", "all_unset").first() == (0, 0, 0, True)
    rows = P.packs(_cases(spark, "b", "a"), audit, _frames(spark), ["j"])
    P.write_pack(rows, f"file://{tmp_path}")
    assert spark.read.text(f"file://{tmp_path}/pages/episode_id=a").count() == 1
    text = "".join(f.read_text() for f in sorted((tmp_path / "index").glob("part-*")))
    assert text.startswith("<!doctype html>") and text.rstrip().endswith("</html>") and text.index(">a</a>") < text.index(">b</a>")


def test_whole_tables_have_cards(spark):
    assert packs.review_packs(spark, SMALL).agg(F.max("selected_frame_count")).first()[0] > 0
