"""Audit classes, frequency tables, hash-ranked splits, summaries by episode, and comparisons of rebuilt tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CATEGORIES = ("clean_reference_candidate", "operation_anomaly", "demo_quality_only", "technical_exclusion", "manual_review_required")


def parse_bool(c: Column) -> Column:
    """true/1/yes and false/0/no in any case; anything else is an error."""
    v = F.lower(F.trim(c.cast("string")))
    return F.when(v.isin("true", "1", "yes"), True).when(v.isin("false", "0", "no"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(v, F.lit("null")))).cast("boolean"))


def optional_text(c: Column) -> Column:
    """Trimmed; blank and 'nan' are null."""
    v = F.trim(c)
    return F.when((v != "") & (F.lower(v) != "nan"), v)


def classify(rows: DataFrame, technical_markers: Sequence[str], anomaly_reasons: Mapping[str, Sequence[str]], quality_reasons: Sequence[str]) -> DataFrame:
    """Adds audit_category, observed_failure_modes, diagnostic_eligible and exclusion_reason; the first rule that fits counts."""
    reason = F.col("failure_reason")
    technical = ~F.col("technical_valid")
    for m in technical_markers:
        technical = technical | F.coalesce(F.contains(reason, F.lit(m)), F.lit(False))
    modes = F.create_map(*[x for k, v in anomaly_reasons.items() for x in (F.lit(k), F.array(*[F.lit(m) for m in v]))]) if anomaly_reasons else None
    anomaly = F.coalesce(reason.isin(*anomaly_reasons), F.lit(False)) if anomaly_reasons else F.lit(False)
    quality = F.coalesce(reason.isin(*quality_reasons), F.lit(False)) if quality_reasons else F.lit(False)
    category = (
        F.when(technical, "technical_exclusion").when(anomaly, "operation_anomaly").when(quality | (~F.col("demo_quality_valid") & reason.isNull()), "demo_quality_only")
        .when(reason.isNull(), "clean_reference_candidate").otherwise("manual_review_required")
    )
    found = F.when(anomaly & ~technical, modes[reason] if modes is not None else None)
    return rows.withColumns(
        {
            "audit_category": category, "observed_failure_modes": F.coalesce(found, F.array().cast("array<string>")), "diagnostic_eligible": ~technical,
            "exclusion_reason": F.when(technical, F.coalesce(reason, F.lit("technical_valid=False"))),
        }
    )


def frequency(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(attribute, value, n) of each column in one pass; arrays count each of their members."""
    kinds = dict(rows.dtypes)
    parts = []
    for c in columns:
        values = F.col(c) if kinds[c].startswith("array") else F.array(F.col(c))
        parts.append(F.struct(F.lit(c).alias("attribute"), values.cast("array<string>").alias("vs")))
    one = rows.select(F.explode(F.array(*parts)).alias("p")).select("p.attribute", F.explode("p.vs").alias("value"))
    return one.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))


def split_digest(seed: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def stratified_split(rows: DataFrame, stratum: str, key: str, seed: str, held_out: Mapping[str, int]) -> DataFrame:
    """Adds rank_digest and split: the first n of each stratum by (digest, key) are held out.

    n must be smaller than the stratum, or it is an error. Only the first n of a
    stratum in each task are sorted; what goes back to the rows is one bound and
    one count for each stratum. Rows with equal keys are on one side.
    """
    marked = rows.withColumn("rank_digest", split_digest(seed, F.col(stratum), F.col(key)))
    wanted = {k: v for k, v in held_out.items() if v > 0}
    if not wanted:
        return marked.withColumn("split", F.lit("development"))
    n = F.create_map(*[F.lit(x) for k, v in wanted.items() for x in (k, v)])[F.col(stratum)]
    w = Window.partitionBy(stratum).orderBy("rank_digest", key)
    some = marked.where(F.col(stratum).isin(*wanted)).select(stratum, "rank_digest", key).withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= max(wanted.values()))
    bound = some.where(F.col("_at") <= n).groupBy(F.col(stratum).alias("_of")).agg(F.max(F.struct("rank_digest", key)).alias("_bound"))
    sizes = rows.where(F.col(stratum).isin(*wanted)).groupBy(F.col(stratum).alias("_of")).agg(F.count(F.lit(1)).alias("_population"))
    out = marked.join(F.broadcast(bound.join(sizes, "_of")), F.col(stratum) == F.col("_of"), "left")  # a row for each stratum that is held out
    bad = n >= F.col("_population")
    first = F.coalesce(F.struct("rank_digest", key) <= F.col("_bound"), F.lit(False))
    split = F.when(bad, F.raise_error(F.lit("a stratum has too few rows to hold out")).cast("string")).when(first, "held_out").otherwise("development")
    return out.withColumn("split", split).drop("_of", "_bound", "_population")


def group_split(rows: DataFrame, group: str, seed: str, held_out_groups: int) -> DataFrame:
    """Adds rank_digest and split so that every group is on one side: the first groups by (digest, group) are held out.

    Only the first groups of each task are sorted. A null group is a group.
    """
    digest = split_digest(seed, F.col(group))
    named = rows.withColumn("rank_digest", digest)
    first = rows.select(F.col(group).alias("_group")).distinct().withColumn("_digest", split_digest(seed, F.col("_group"))).orderBy("_digest", "_group").limit(held_out_groups)
    out = named.join(first.select("_group", F.lit(True).alias("_held")), F.col(group).eqNullSafe(F.col("_group")), "left")
    return out.withColumn("split", F.when(F.col("_held"), "held_out").otherwise("development")).drop("_group", "_held")


def split_counts(assigned: DataFrame, stratum: str) -> DataFrame:
    """Counts by split and stratum with all totals; totals have null keys."""
    return assigned.cube("split", stratum).agg(F.count(F.lit(1)).alias("n"))


def event_summary(events: DataFrame) -> DataFrame:
    """(episode_id, n_events, event_ids, dispositions): ids and distinct dispositions in order."""
    return events.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.array_sort(F.collect_list("event_id")).alias("event_ids"), F.array_sort(F.collect_set("review_disposition")).alias("dispositions")
    )


def gold_counts_by_split(assigned: DataFrame, events: DataFrame) -> DataFrame:
    """(split, n_events, n_verified): events without an assigned episode are an error."""
    rows = events.join(assigned.select("episode_id", "split"), "episode_id", "left")
    split = F.when(F.col("split").isNull(), F.raise_error(F.lit("an event's episode has no split"))).otherwise(F.col("split"))
    return rows.withColumn("split", split).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum((F.col("review_disposition") == "verified").cast("int")).alias("n_verified")
    )


def load_gold(events: DataFrame, allowed: DataFrame) -> DataFrame:
    """The gold rows of allowed episodes. The semi-join is below every use of the interval columns, so no other row's are read into results."""
    return events.join(allowed.select("episode_id"), "episode_id", "left_semi")


def integrate_gold(source: DataFrame, review: DataFrame) -> DataFrame:
    """Source and review joined on event_id; an event on one side alone is an error. Columns of both, with the disposition from the review's fields.

    verified needs an interval and a reviewer; unresolved must have no interval.
    """
    s, r = source.withColumn("_s", F.lit(True)), review.withColumn("_r", F.lit(True))
    both = s.join(r, "event_id", "full_outer")
    whole = F.col("_s").isNotNull() & F.col("_r").isNotNull()
    known = F.col("start_frame").isNotNull() & F.col("end_frame").isNotNull()
    none = F.col("start_frame").isNull() & F.col("end_frame").isNull()
    disposition = (
        F.when(~whole, F.raise_error(F.lit("an event is on one side alone")))
        .when(known & (F.col("start_frame") <= F.col("end_frame")) & (F.length(F.trim("reviewer")) > 0), "verified")
        .when(none & (F.length(F.trim("review_notes")) > 0), "reviewed_unresolved").otherwise(F.raise_error(F.lit("a review is neither verified nor unresolved")))
    )
    return both.withColumn("review_disposition", disposition).drop("_s", "_r")


def recompute_diff(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows on one side alone with the side they are on; empty if the tables agree, repeats included."""
    b = rebuilt.select(*stored.columns)
    return stored.exceptAll(b).withColumn("side", F.lit("stored")).unionByName(b.exceptAll(stored).withColumn("side", F.lit("rebuilt")))
