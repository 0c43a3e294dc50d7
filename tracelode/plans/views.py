"""The engine's inputs read from the relational tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import timeseries as TS


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages: the number of a page is its doc_id, counted from 1, so no source is ever numbered in one task."""
    return table(spark, d, "documents").select(F.col("source").alias("source_id"), (F.col("doc_id") + 1).alias("page_number"), "doc_id", "text", "lang")


def queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark")


def gold(spark: SparkSession, d: str) -> DataFrame:
    """Pages that hold a query's whole text."""
    from ..operators.scan import containing

    return containing(pages(spark, d), queries(spark, d))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Episodes of events: (episode_id, frame_index, timestamp_sec, the signals as arrays of two, event columns)."""
    w = Window.partitionBy("user_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double")).withColumn("us", micros)
    rows = e.select(
        F.col("user_id").alias("episode_id"), (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("int").alias("frame_index"),
        ((F.col("us") - F.min("us").over(w)) / F.lit(1e6)).alias("timestamp_sec"), "event_id", "event_type", "value", "k",
    )
    a, o = F.array("k", F.col("k") * 2.0 - F.col("value")), F.array("value", F.col("value") * 0.5 + F.col("k"))
    return rows.withColumn("observation", o).withColumn("action", a).withColumn("tracking_error", F.zip_with("action", "observation", lambda x, y: F.abs(x - y)))


def frame_counts(s: DataFrame) -> DataFrame:
    return s.groupBy("episode_id").agg(F.count(F.lit(1)).cast("int").alias("n_frames"))


def annotated(s: DataFrame) -> DataFrame:
    """Error events as intervals of two frames on both sides, cut to the episode."""
    e = s.where("event_type = 'error'").join(frame_counts(s), "episode_id")
    return e.select(
        "event_id", "episode_id", F.concat(F.lit("mode"), (F.col("event_id") % 3).cast("string")).alias("mode"), F.greatest(F.lit(0), F.col("frame_index") - 2).alias("start_frame"),
        F.least(F.col("n_frames") - 1, F.col("frame_index") + 2).alias("end_frame"), F.col("timestamp_sec").alias("center_sec"),
    )


DAY = 86400.0
SAMPLES = """
ev AS (SELECT *, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, epoch_us(ts) AS us FROM events),
s AS (SELECT user_id AS episode_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS frame_index,
  (us - min(us) OVER (PARTITION BY user_id)) / 1e6::DOUBLE AS timestamp_sec, event_id, event_type, value, k,
  value AS o1, value * 0.5::DOUBLE + k AS o2, k AS a1, k * 2.0::DOUBLE - value AS a2 FROM ev),
n AS (SELECT episode_id, count(*)::INT AS n_frames FROM s GROUP BY episode_id),
gap AS (SELECT *, abs(a1 - o1) AS t1, abs(a2 - o2) AS t2 FROM s),
lagged AS (SELECT *, lag(o1) OVER w AS po1, lag(o2) OVER w AS po2, lag(a1) OVER w AS pa1, lag(a2) OVER w AS pa2 FROM gap
  WINDOW w AS (PARTITION BY episode_id ORDER BY frame_index)),
ch AS (SELECT *, CASE WHEN po1 IS NULL THEN 0.0::DOUBLE ELSE sqrt(((o1-po1)*(o1-po1) + (o2-po2)*(o2-po2)) / 2) END AS state_change_rms,
  CASE WHEN pa1 IS NULL THEN 0.0::DOUBLE ELSE sqrt(((a1-pa1)*(a1-pa1) + (a2-pa2)*(a2-pa2)) / 2) END AS action_change_rms,
  sqrt((t1*t1 + t2*t2) / 2) AS tracking_gap_rms FROM lagged),
sc AS (SELECT *, greatest(state_change_rms, action_change_rms) AS fused FROM ch),
an AS (SELECT event_id, s.episode_id, 'mode' || (event_id % 3) AS mode, greatest(0, frame_index - 2) AS start_frame,
  least(n_frames - 1, frame_index + 2) AS end_frame, timestamp_sec AS center_sec FROM s JOIN n ON s.episode_id = n.episode_id WHERE event_type = 'error')
"""
TOKEN = r"regexp_extract_all(lower(text), '[a-z0-9]+(?:[._/+\-][a-z0-9]+)*')"
PAGES = "pg AS (SELECT source AS source_id, doc_id + 1 AS page_number, doc_id, text, lang FROM documents)"
BM25 = f"""{PAGES},
tok AS (SELECT source_id, page_number, {TOKEN} AS tokens FROM pg),
st AS (SELECT count(*) AS n, avg(len(tokens)) AS avg_len FROM tok),
q AS (SELECT item_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (SELECT item_id, {TOKEN} AS t FROM benchmark)),
tf AS (SELECT source_id, page_number, dl, term, count(*) AS tf FROM (SELECT source_id, page_number, len(tokens) AS dl, unnest(tokens) AS term FROM tok)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wt AS (SELECT tf.*, df.df, ln(1.0::DOUBLE + (n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) AS idf, ln(1.0::DOUBLE + (n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) *
  ((tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_len))) AS weight FROM tf JOIN df ON tf.term = df.term, st),
sco AS (SELECT item_id, source_id, page_number, list_reduce(list(weight ORDER BY pos), lambda a, x: a + x) AS score
  FROM q JOIN wt ON q.term = wt.term GROUP BY item_id, source_id, page_number),
bm AS (SELECT item_id, source_id, page_number, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source_id, page_number) AS rank FROM sco) WHERE rank <= 5)"""
LEX = f"""qt AS (SELECT item_id, list_distinct({TOKEN}) AS qd FROM benchmark),
lex AS (SELECT item_id, source_id, page_number, len(list_intersect(qd, tokens)) / len(qd)::DOUBLE AS score FROM qt, tok),
ln_ AS (SELECT item_id, source_id, page_number, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source_id, page_number) AS rank FROM lex) WHERE rank <= 5)"""
GOLD = "gold AS (SELECT item_id, source_id, page_number FROM pg JOIN benchmark b ON contains(pg.text, b.text))"


def lexical_hits(spark: SparkSession, d: str) -> DataFrame:
    """A second ranked list for fusion: the share of a query's tokens that a page has."""
    from ..operators.scan import best_pages

    return best_pages(pages(spark, d), queries(spark, d), 5, shares=True, with_zeros=True)


def peaks_of(s: DataFrame) -> DataFrame:
    return TS.peaks(TS.change_scores(s), "fused_state_action_score", 3, 5)
