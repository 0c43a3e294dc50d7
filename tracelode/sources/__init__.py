"""Readers and writers: typed JSON lines, whole JSON, sample CSVs, manifests in other encodings, binary files, pages of documents."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import page_columns

#: The joints in order, and the schemas of the stored tables.
JOINTS = ("shoulder_pan", "shoulder_lift", "elbow_flex", "wrist_flex", "wrist_roll", "gripper")
SIGNALS = ("observation", "action", "tracking_error")
PAGE = "source_id string, page_number int, text string, text_sha256 string, char_count long"
VISUAL_PAGE = "source_id string, page_number int, image_path string, image_sha256 string, width_px int, height_px int, render_dpi int"
FRAME = (
    "episode_id string, camera string, frame_index long, timestamp_sec double, sample_timestamp_ns long, source_timestamp_ns long, source_age_ms double, "
    "camera_sequence long, image_relpath string, image_sha256 string, width_px int, height_px int"
)
ANNOTATION = (
    "event_id string, episode_id string, event_type string, description string, status string, start_frame_index long, end_frame_index_inclusive long, evidence_cameras array<string>, notes string"
)
GROUNDED_CASE = "case_id string, question string, expected_answerable boolean, source_id string, gold_pages array<int>, required_fact_groups array<array<string>>, absence_terms array<string>, tags array<string>"
RETRIEVAL_CASE = "case_id string, query string, document_gold_pages array<int>, expected_robot_joints array<string>, expected_robot_signals array<string>"
MANIFEST = (
    "source_id string, source_type string, local_path string, sha256 string, size_bytes long, mime_type string, origin_uri string, added_at timestamp, page_count int, width_px int, height_px int, metadata map<string,string>"
)
SLICE = (
    "slice_group_id string, episode_id string, start_sec double, end_sec double, start_frame_index long, end_frame_index_exclusive long, midpoint_target_sec double, midpoint_frame_index long, "
    "midpoint_timestamp_sec double, midpoint_error_ms double, cameras array<struct<camera:string,frame_index:long,timestamp_sec:double>>"
)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one; a temporary one only where the master is local and none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tracelode-")
    return f"{root.rstrip('/')}/tracelode-io-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed JSON lines; blank lines do not count, a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of lines that are no JSON object; blank lines are none."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return lines.where((F.trim("line") != "") & (F.json_object_keys("line").isNull()))


def read_json(spark: SparkSession, path: str, schema: str | None = None, version: str | None = None) -> DataFrame:
    """Whole-file JSON objects; another schema_version than the given one is an error."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(path)
    if version is None:
        return df
    same = F.when(F.col("schema_version") == version, True).otherwise(F.raise_error(F.lit(f"schema_version is not {version}")).cast("boolean"))
    return df.where(same)


def sample_schema() -> T.StructType:
    text = ("front_image", "wrist_image")
    whole = ("frame_index", "sample_timestamp_ns", "elapsed_ns", "front_sequence", "front_source_timestamp_ns", "front_age_ms", "front_image", "wrist_sequence", "wrist_source_timestamp_ns", "wrist_age_ms", "wrist_image")
    fields = [T.StructField(n, T.StringType() if n in text else T.DoubleType() if n.endswith("age_ms") else T.LongType()) for n in whole]
    return T.StructType(fields + [T.StructField(f"{s}_{j}", T.DoubleType()) for s in SIGNALS for j in JOINTS])


def read_samples(spark: SparkSession, path: str, verify_tracking_error: bool = True) -> DataFrame:
    """samples.csv files, one folder an episode: (episode_id, frame_index, timestamp_sec, the signals as arrays, camera columns).

    Signals must be finite, and tracking_error |action - observation| within
    1e-9; columns are read by the header's names.
    """
    raw = spark.read.schema(sample_schema()).option("header", True).option("enforceSchema", False).csv(path)
    raw = raw.withColumn("episode_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    arrays = {s: F.array(*[F.col(f"{s}_{j}") for j in JOINTS]) for s in SIGNALS}
    df = raw.select("episode_id", "frame_index", (F.col("elapsed_ns") / 1e9).alias("timestamp_sec"), *[c.alias(s) for s, c in arrays.items()], "front_image", "wrist_image", "front_age_ms", "wrist_age_ms")
    fine = F.lit(True)
    for s in SIGNALS:
        fine = fine & F.forall(s, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if verify_tracking_error:
        gap = F.zip_with(F.col("action"), F.col("observation"), lambda a, o: F.abs(a - o))
        fine = fine & F.forall(F.zip_with(F.col("tracking_error"), gap, lambda t, g: F.abs(t - g) <= 1e-9), lambda x: x)
    return df.where(F.when(fine, True).otherwise(F.raise_error(F.lit("a sample breaks the signal contract")).cast("boolean")))


def read_manifest_csv(spark: SparkSession, path: str, encoding: str = "gb18030") -> DataFrame:
    """A training manifest in another encoding. Spark reads such files through Java's charsets if it is told to."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return spark.read.option("header", True).option("encoding", encoding).csv(path)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def bind_sources(spark: SparkSession, path: str) -> DataFrame:
    """Provenance of files: path, sha256, size_bytes, modified."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def split_pages(documents: DataFrame, pages_of: Callable[[bytes], list[str]], nfkc: bool = True) -> DataFrame:
    """(source_id, page_number from 1, text, text_sha256, char_count) from (source_id, content) by a pluggable page reader."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(s, n, t) for s, c in zip(f["source_id"], f["content"], strict=True) for n, t in enumerate(pages_of(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["source_id", "page_number", "text"])

    out = documents.select("source_id", "content").mapInPandas(run, "source_id string, page_number int, text string")
    return out.withColumns(page_columns(F.col("text"), nfkc))


def image_size(content) -> F.Column:
    """(width, height) from the header of a PNG file; null for others. No image is decoded."""
    png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(png, F.struct(number(17).alias("width_px"), number(21).alias("height_px")))


def write_jsonl(df: DataFrame, path: str, one_file: bool = False) -> None:
    """JSON lines in UTF-8, null fields kept. ``one_file`` is for small exports."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, list_columns: tuple[str, ...] = ()) -> None:
    """CSV with a header, lists joined by a bar and nulls as empty text."""
    out = df.withColumns({c: F.concat_ws("|", c) for c in list_columns})
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_frames(df: DataFrame, path: str) -> None:
    """Frame records as Parquet, a folder for each episode."""
    df.repartition("episode_id").sortWithinPartitions("episode_id", "frame_index", "camera").write.mode("overwrite").partitionBy("episode_id").parquet(path)


#: The columns of the collection plan in order.
PLAN = "plan_row_id string, pair_group_id string, slot_index int, slot_role string, planned_physical_cause string, planned_intervention_type string, repeat_slot boolean, benchmark_target string"


def write_plan(plan: DataFrame, path: str) -> None:
    """The collection plan as CSV in plan order, the same bytes for the same plan."""
    names = [c.split()[0] for c in PLAN.split(", ")]
    plan.select(*names).orderBy("plan_row_id").coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)  # 90 rows by its contract


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """A collection plan with its types; a header with other columns, or a value of another type, fails the read."""
    return spark.read.schema(PLAN).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def resolve_path(path, root: str):
    """A stored path as an absolute one: relative to the root unless it is absolute already."""
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def upsert(existing: DataFrame, new: DataFrame, key: str, edited: str) -> DataFrame:
    """Rows of ``new`` that are absent are added; existing rows stay, but those not edited take the new values."""
    old, fresh = existing.alias("old"), new.alias("new")
    both = old.join(fresh, key, "full_outer")
    keep = F.col(f"old.{edited}") | F.col(f"new.{edited}").isNull()
    return both.select(key, *[F.when(F.coalesce(keep, F.lit(False)), F.col(f"old.{c}")).otherwise(F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}"))).alias(c) for c in new.columns if c != key])
