"""Review packs as rows: an episode's frames, checks and page in one row, an index in lines, a manifest in one row.

Pages are built by column functions, so they are written like any other text
column. A page holds the frames that selection capped, never a whole episode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reviews import all_diagnoses_unset, all_events_draft, observed_failure_modes

#: Fixed value: what a pack does not claim.
NON_CLAIMS = ("frames are picked for review and are no verified boundaries", "peaks of motion and of state or action are aids and no causal labels", "no causal diagnosis is assigned")
PAGE_HEAD = '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>'


def escape(c: Column) -> Column:
    """Text that is safe in HTML, in quotes too; null is empty."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def _number(c: Column, digits: int) -> Column:
    return F.when(c.isNull(), F.lit("-")).otherwise(F.format_string(f"%.{digits}f", c.cast("double")))


def _cells(tag: str, cells: Sequence[Column]) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>")) for c in cells], F.lit("</tr>"))


def metric_list(metrics: Column) -> Column:
    """A map of numbers as 'name=value' in order of names; 'none' if it is empty."""
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(metrics)), lambda e: F.concat(escape(e["key"]), F.lit("="), _number(e["value"], 5))), "; ")
    return F.when(F.coalesce(F.size(metrics), F.lit(0)) > 0, listed).otherwise(F.lit("none"))


def frame_card(joints: Sequence[str], images: bool = False) -> Column:
    """A frame (frame_index, timestamp_sec, reasons, metrics, observation, action, tracking_error) as a block of HTML.

    images: front and wrist hold PNG files, which go into the page itself.
    """
    rows = [_cells("td", [F.lit(j), *[_number(F.get(s, F.lit(k)), 4) for s in ("observation", "action", "tracking_error")]]) for k, j in enumerate(joints)]
    shown = [
        F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<img alt="{c}" src="data:image/png;base64,'), F.base64(c), F.lit('">'))).otherwise(F.lit("")) for c in (("front", "wrist") if images else ())
    ]
    return F.concat(
        F.lit('<section id="frame-'), F.col("frame_index").cast("string"), F.lit('"><h2>Frame '), F.col("frame_index").cast("string"), F.lit(" at "), _number(F.col("timestamp_sec"), 6), F.lit(" s</h2><p>Picked by: "),
        escape(F.array_join("reasons", ", ")), F.lit("</p><p>Metrics: "), metric_list(F.col("metrics")), F.lit("</p>"), *shown, F.lit("<table>"),
        _cells("th", [F.lit(c) for c in ("joint", "observation", "action", "tracking error")]), *rows, F.lit("</table></section>"),
    )


def episode_page(facts: dict[str, Column]) -> Column:
    """A whole page from an episode's events and cards (array<string> in frame order); facts are listed under their names."""
    listed = [F.concat(F.lit(f"<dt>{name}</dt><dd>"), escape(c), F.lit("</dd>")) for name, c in facts.items()]
    events = F.array_join(F.transform("events", lambda e: F.concat(F.lit("<li>"), escape(e["event_id"]), F.lit(": "), escape(e["observed_failure_mode"]), F.lit("</li>"))), "")
    name = escape(F.col("episode_id"))
    return F.concat(
        F.lit(f"{PAGE_HEAD}Review of "), name, F.lit("</title></head><body><h1>Review of "), name, F.lit("</h1><p>Find an interval for each event on its own; the label at the source is no diagnosis.</p><dl>"), *listed,
        F.lit("</dl><ul>"), events, F.lit("</ul>"), F.array_join("cards", ""), F.lit("</body></html>"),
    )


def packs(cases: DataFrame, audit: DataFrame, frames: DataFrame, joints: Sequence[str], bindings: DataFrame | None = None, images: bool = False) -> DataFrame:
    """One row for each case: its counts, its frames and its page.

    cases: ``reviews.review_cases``. audit: (episode_id, source_status,
    source_overall_pass, source_failed_checks), one row an episode; a case
    without one is an error, and so is an episode with two cases. bindings: the
    same columns, which go before the audit's where an episode has any. frames:
    the picked frames with the columns of ``frame_card``; a case without frames
    has an empty list. Audit rows without a case are left out.
    """
    status = ("source_status", "source_overall_pass", "source_failed_checks")
    own = cases.join(audit.select("episode_id", F.struct(*status).alias("_audit")), "episode_id", "left")
    known = F.col("_audit")
    if bindings is not None:
        own = own.join(bindings.select("episode_id", F.struct(*status).alias("_bound")), "episode_id", "left")
        known = F.when(F.col("_bound").isNotNull() & known.isNotNull(), F.col("_bound")).otherwise(known)
    card = F.struct("frame_index", frame_card(joints, images).alias("card"))
    picked = frames.join(cases.select("episode_id").distinct(), "episode_id", "left_semi").groupBy("episode_id").agg(F.array_sort(F.collect_list(card)).alias("_picked"))
    missing = F.raise_error(F.concat(F.lit("no source audit of episode "), F.col("episode_id").cast("string")))
    own = own.join(picked, "episode_id", "left").withColumn("_known", F.when(F.col("_audit").isNull(), missing.cast(own.schema["_audit"].dataType)).otherwise(known))
    own = own.select(*cases.columns, F.col("_known.*"), F.coalesce("_picked", F.array().cast(picked.schema["_picked"].dataType)).alias("_picked"))
    facts = {
        "task success": F.col("task_success"), "failure reason": F.col("original_failure_reason"), "source status": F.col("source_status"), "source passed": F.col("source_overall_pass"),
        "failed checks": F.when(F.size("source_failed_checks") > 0, F.array_join("source_failed_checks", ", ")).otherwise("none"), "frames": F.size("_picked"),
    }
    out = own.withColumn("cards", F.transform("_picked", lambda x: x["card"])).withColumn("html", episode_page(facts))
    rows = out.select(
        "episode_id", "original_failure_reason", observed_failure_modes(F.col("events")).alias("observed_failure_modes"), F.size("events").alias("event_count"),
        F.transform("_picked", lambda x: x["frame_index"]).alias("frames"), F.size("_picked").alias("selected_frame_count"), *status, all_events_draft(F.col("events")).alias("all_draft"),
        all_diagnoses_unset(F.col("events")).alias("all_unset"), "html",
    )
    twice = cases.groupBy("episode_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    bad = F.raise_error(F.concat(F.lit("two review cases of episode "), F.col("episode_id").cast("string"))).cast("boolean")
    return rows.join(twice, "episode_id", "left").where(F.when(F.col("_n").isNull(), True).otherwise(bad)).drop("_n")


def index_lines(rows: DataFrame) -> DataFrame:
    """(part, episode_id, line): the index page line by line; in order of part and episode_id it is one file, however many episodes there are."""
    link = F.concat(F.lit('<a href="'), escape(F.url_encode(F.col("episode_id").cast("string"))), F.lit('/review.html">'), escape(F.col("episode_id")), F.lit("</a>"))
    cells = [link, escape(F.col("original_failure_reason")), escape(F.array_join("observed_failure_modes", ", ")), F.col("event_count").cast("string"), F.col("selected_frame_count").cast("string"), escape(F.col("source_status"))]
    body = rows.select(F.lit(1).alias("part"), "episode_id", _cells("td", cells).alias("line"))
    head = "<tr>" + "".join(f"<th>{c}</th>" for c in ("episode", "failure reason", "observed modes", "events", "frames", "source status")) + "</tr>"
    ends = rows.sparkSession.createDataFrame([(0, f"{PAGE_HEAD}Reviews</title></head><body><h1>Reviews</h1><table>{head}"), (2, "</table></body></html>")], "part int, line string")
    return ends.select("part", F.lit(None).cast(rows.schema["episode_id"].dataType).alias("episode_id"), "line").unionByName(body)


def manifest(rows: DataFrame) -> DataFrame:
    """One row: pack_count, event_count, multi_event_count, all_unset, non_claims. Without packs the counts are 0 and all_unset is true."""
    return rows.agg(
        F.count(F.lit(1)).alias("pack_count"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("event_count"), F.count_if(F.col("event_count") > 1).alias("multi_event_count"),
        F.coalesce(F.every("all_unset"), F.lit(True)).alias("all_unset"),
    ).withColumn("non_claims", F.array(*[F.lit(x) for x in NON_CLAIMS]))


def write_pack(rows: DataFrame, path: str) -> None:
    """``packs``' pages as text below path/pages, a folder for each episode, and the index as one sorted text table below path/index."""
    rows.select("episode_id", "html").write.mode("overwrite").partitionBy("episode_id").text(f"{path}/pages")
    index_lines(rows).orderBy("part", "episode_id").select("line").write.mode("overwrite").text(f"{path}/index")
