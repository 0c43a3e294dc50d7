"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Every source gets a target number of words. A document of a source with target
t and S words is wanted t / S times. The whole part is certain: that many
copies are taken outright. For the rest each document has an inclusion
probability p (the fractional part) and a random number u; documents are ranked
by the Pareto variable, random odds over inclusion odds, (u / (1-u)) / (p / (1-p)),
and the front of that order is taken until the words that are left to take are
reached. The last places go to documents that fit into what is still missing:
the next few of each size class in the order, larger ones first. While others
still fit, the order goes on over all of them, so that what is missing in the
end is less than any document that is left.

The order is never sorted as a whole. The front ends where the Pareto variable
is about 1, so documents are counted in buckets of q / (1+q); buckets before
the end are taken whole and only the bucket in which the front ends is ordered.
A source that holds a third of all rows is thus no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, fresh, table, word_count

#: The weights dealt to the sources in order, the share of all words, the most copies.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BUCKETS = 4096
#: What is still missing after the front of the order is first filled from this many documents of each size class (by powers of two).
LAST_PLACES = 16
SEED = "mix-1"
#: Tables with a row for each source are broadcast up to this many rows; beyond, Spark shuffles both sides.
SMALL_ROWS = 50_000


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) with ``target`` added: weighted shares, each at most ``most`` times its source.

    For up to ``SMALL_ROWS`` sources (one row each): its windows are one task.
    ``wide_targets`` gives the same targets for any number. The excess of capped sources goes to the others by weight: with the sources
    in order of cap over weight, level l is right for the first source that it
    does not cap, and every target is min(cap, level * weight).
    """
    i = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(i, F.lit(len(weights))) + 1).cast("int"))
    before = Window.orderBy("ratio", "cap", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", "cap", F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        sources.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn(
            "level",
            (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            / F.sum("weight").over(rest),
        )
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
        .withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")))
        .select("source", "source_size", "target")
    )


def _before(scratch: Scratch, df: DataFrame, order: list[Column], names: list[str]) -> DataFrame:
    """The rows with ``<name>_before``: the sum of each column over all rows before in a total order.

    Ranges of the order are written out; the sums of whole ranges (a row for
    each partition) are broadcast and added to the sums within the range.
    """
    cut = scratch.keep(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    per = cut.groupBy("range").agg(*[F.sum(n).alias(n) for n in names])
    ranges_before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("range", *[F.coalesce(F.sum(n).over(ranges_before), F.lit(0)).alias(f"{n}_start") for n in names])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"{n}_before": F.col(f"{n}_start") + F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in names}
    return cut.join(F.broadcast(starts), "range").withColumns(sums).drop("range", *[f"{n}_start" for n in names])


def wide_targets(scratch: Scratch, sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``targets`` for sources that are many (hosts, say): both orders are cut into ranges, and no task or driver holds all sources."""
    placed = _before(scratch, sources.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], ["one"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("one_before"), F.lit(len(weights))) + 1).cast("int"))
    capped = (
        placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
        .select("source", "source_size", "weight", "cap", "ratio")
    )
    rows = _before(scratch, capped, [F.col("ratio").asc(), F.col("cap").asc(), F.col("source").asc_nulls_last()], ["cap", "weight"])
    size, weighed = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    if size is None:
        return sources.withColumn("target", F.lit(None).cast("double"))
    own = (F.lit(float(size)) * F.lit(float(share)) - F.col("cap_before")) / (F.lit(weighed) - F.col("weight_before"))
    level = rows.agg(F.max(F.when(own <= F.col("ratio"), own))).first()[0]
    target = F.coalesce(F.least(F.col("cap"), F.lit(level).cast("double") * F.col("weight")), F.col("cap"))
    return rows.select("source", "source_size", target.alias("target"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast if ``rows``, the table's counted size, is within the bound, so that the many rows of one source are not shuffled to it."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def random_unit(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of md5 of the parts joined by a bar; a null part is empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def take(spark: SparkSession, items: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """Decide for each item (key, source, size and any more columns; rows may repeat) how much of it is taken.

    Adds copy (1.. among equal rows), source_size, target and copies (how often
    the row is taken). Null and empty sources are sources of their own; items
    of size 0 are taken with the certain copies alone. The same rows give the
    same mix however they are partitioned.
    """
    scratch = Scratch(spark)
    names = items.columns
    # equal rows get numbers, so that each has its own random number
    rows = scratch.keep(
        items.groupBy(*names).agg(F.count(F.lit(1)).alias("times"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")
    )
    sizes = scratch.keep(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    n_sources = sizes.count()
    goals = targets(sizes, weights, share, most) if n_sources <= SMALL_ROWS else wide_targets(scratch, sizes, weights, share, most)
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = scratch.keep(
        goals.withColumn("sure", F.floor(wanted).cast("long"))
        .withColumn("p", wanted - F.floor(wanted))
        .withColumn("left", F.col("target") - F.col("sure") * F.col("source_size"))
    )
    u = random_unit(F.lit(seed), F.col("key"), F.col("copy"))
    ranked = (
        rows.join(_small(goals, n_sources), rows["source"].eqNullSafe(goals["source"])).drop(goals["source"])
        .withColumn("q", F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))))
        .withColumn("bucket", F.floor(F.lit(float(BUCKETS)) * F.col("q") / (1 + F.col("q"))))
    )
    ranked = scratch.keep(ranked)
    scratch.drop(rows)
    placed = _front(ranked, names, n_sources)
    chosen = scratch.keep(placed.withColumn("row", F.monotonically_increasing_id()))  # written once, so that it names a row for good
    gaps = scratch.keep(
        chosen.groupBy("source").agg((F.first("left") - F.sum(F.when(F.col("chosen"), F.col("size")).otherwise(0))).cast("double").alias("left"))
    )
    in_class = Window.partitionBy("source", "kind").orderBy("q", F.col("key").asc_nulls_first(), "copy")
    spare = (
        chosen.where("q is not null and not chosen and size > 0").select("source", "size", "q", "bucket", "key", "copy", "row", F.floor(F.log2("size")).alias("kind"))
    )
    spare = scratch.keep(spare)
    first = None
    taken: list[DataFrame] = []
    # the first of each class, larger ones first; while others still fit, the order goes on over those and is filled up again
    while True:
        few = scratch.keep(spare.withColumn("n", F.row_number().over(in_class)).where(F.col("n") <= LAST_PLACES))
        first = few.select("row", F.lit(True).alias("early")) if first is None else first
        listed = few.groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("neg"), "q", "key", "copy", "row"))).alias("xs"))
        filled = listed.join(gaps, listed["source"].eqNullSafe(gaps["source"])).select(F.explode(_fill(F.col("xs"), F.col("left"))["got"]["row"]).alias("row"))
        spare, gaps = _without(scratch, spare, gaps, got := scratch.keep(filled), n_sources)
        taken.append(got)
        room = _with_left(spare, gaps, n_sources).where(F.col("size") <= F.col("left"))
        if room.isEmpty():
            break
        # at most half of what is left: each pass then halves it or takes them all; if all are larger, one more fits, the first in order
        halves = room.groupBy("source").agg((F.min("size") <= F.first("left") / 2).alias("small"))
        room = room.join(_small(halves, n_sources), room["source"].eqNullSafe(halves["source"])).drop(halves["source"])
        room = scratch.keep(room.where(~F.col("small") | (F.col("size") <= F.col("left") / 2)))
        got = scratch.keep(_front(room, ["key", "source", "row"], n_sources).where("chosen").select("row"))
        spare, gaps = _without(scratch, spare, gaps, got, n_sources)
        taken.append(got)
    # nothing fits now: one more that overshoots if that ends nearer, the smallest; of equal sizes the last of those that were listed first
    over = _with_left(spare, gaps, n_sources).where((F.col("size") > F.col("left")) & (F.col("size") - F.col("left") < F.col("left")))
    over = over.join(first, "row", "left")
    rank = F.struct(-F.col("size"), F.coalesce("early", F.lit(False)), "q", "key", "copy", "row")
    taken.append(over.groupBy("source").agg(F.max(rank)["row"].alias("row")).select("row"))
    last = taken[0]
    for more in taken[1:]:
        last = last.unionByName(more)
    last = scratch.keep(last.select(F.col("row").alias("taken")))
    chosen = chosen.join(_small(last, last.count()), F.col("row") == F.col("taken"), "left").withColumn("chosen", F.col("chosen") | F.col("taken").isNotNull())
    return chosen.select(
        *[F.col(f"`{c}`") for c in names], "copy", "source_size", "target", (F.col("sure") + F.col("chosen").cast("int")).alias("copies")
    )


def _front(rows: DataFrame, names: list[str], n_sources: int) -> DataFrame:
    """``rows`` (source, size, q, bucket, left, ...) with ``chosen``: the items of each source in the order of q up to the first that does not fit ``left``."""
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        rows.where("q is not null").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        .withColumn("before", F.coalesce(F.sum("words").over(by_bucket), F.lit(0)))
        .where("before <= left and before + words > left")
        .select(F.col("source").alias("s"), F.col("bucket").alias("end"), "before")
    )
    # no bucket ends the front where all that is left fits: then every bucket is before the end
    placed = rows.join(_small(ends, n_sources), rows["source"].eqNullSafe(ends["s"]), "left").drop("s")
    inside = placed.where("bucket = end")
    in_bucket = Window.partitionBy("source", "bucket").orderBy("q", F.col("key").asc_nulls_first(), *[F.col(f"`{c}`") for c in names if c not in ("key", "source")], "copy")
    inside = inside.withColumn("chosen", (F.col("before") + F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0))) <= F.col("left"))
    outside = placed.where("q is null or end is null or bucket <> end").withColumn(
        "chosen", F.col("q").isNotNull() & (F.col("end").isNull() | (F.col("bucket") < F.col("end")))
    )
    return inside.unionByName(outside).drop("before", "end")


def _with_left(spare: DataFrame, gaps: DataFrame, n_sources: int) -> DataFrame:
    return spare.join(_small(gaps, n_sources), spare["source"].eqNullSafe(gaps["source"])).drop(gaps["source"])


def _without(scratch: Scratch, spare: DataFrame, gaps: DataFrame, got: DataFrame, n_sources: int) -> tuple[DataFrame, DataFrame]:
    """Spare items without the rows ``got``, and what is left of each source after them."""
    got = _small(got, got.count())
    used = spare.join(got, "row", "left_semi").groupBy(F.col("source").alias("s")).agg(F.sum("size").alias("used"))
    rest = gaps.join(used, gaps["source"].eqNullSafe(used["s"]), "left").select("source", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"))
    return scratch.keep(spare.join(got, "row", "left_anti")), scratch.keep(rest)


def _fill(xs: Column, gap: Column) -> Column:
    """Of spare items in falling order of size, those that still fit, one after the other."""
    start = F.struct(gap.cast("double").alias("gap"), F.filter(xs, lambda x: F.lit(False)).alias("got"))

    def step(a: Column, x: Column) -> Column:
        fits = -x["neg"] <= a["gap"]
        return F.when(fits, F.struct((a["gap"] + x["neg"]).alias("gap"), F.concat(a["got"], F.array(x)).alias("got"))).otherwise(a)

    return F.aggregate(xs, start, step)


def mix_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with the columns of ``docs``.

    Documents are told apart by (doc_id, source, text); a row that repeats is
    taken as often as its copies are together. Other columns may hold anything.
    """
    key, own, size, source, times = fresh(docs, "key", "own_key", "size", "mix_source", "times")
    digest = docs.select(
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text")).alias("key"),
        F.col("source"), word_count(F.col("text")).alias("size"),
    )
    taken = take(spark, digest, **options).groupBy("key", "source").agg(F.sum("copies").alias(times)).select(
        F.col("key").alias(key), F.col("source").alias(source), times
    )
    marked = docs.withColumn(own, F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text")))
    once = marked.dropDuplicates([own, "source"])
    return (
        once.join(taken, (F.col(own) == F.col(key)) & F.col("source").eqNullSafe(F.col(source)))
        .where(F.col(times) > 0)
        .withColumn(size, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    docs = table(spark, sf_dir, "documents")
    items = docs.select(F.col("doc_id").alias("key"), "source", word_count(F.col("text")).alias("size"))
    out = take(spark, items)
    return out.select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


OP2_SQL = f"""
WITH items AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM items GROUP BY source),
weighed AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)]::DOUBLE AS weight FROM sized),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / sum(weight) OVER r AS lvl, cap / weight AS ratio
  FROM weighed
  WINDOW b AS (ORDER BY cap / weight, cap, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         r AS (ORDER BY cap / weight, cap, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
goals AS (
  SELECT source, source_size, coalesce(least(cap, max(CASE WHEN lvl <= ratio THEN lvl END) OVER () * weight), cap) AS target FROM levels),
ranked AS (
  SELECT i.*, g.source_size, g.target, floor(g.target / g.source_size)::BIGINT AS sure,
    g.target / g.source_size - floor(g.target / g.source_size) AS p,
    (('0x' || substr(md5('{SEED}|' || doc_id || '|1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM items i JOIN goals g ON i.source IS NOT DISTINCT FROM g.source),
ordered AS (
  SELECT *, target - sure * source_size AS rest,
    CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM ranked),
front AS (
  SELECT *, coalesce(q IS NOT NULL AND sum(size) OVER (PARTITION BY source ORDER BY q, doc_id) <= rest, false) AS chosen FROM ordered),
gaps AS (SELECT *, rest - sum(CASE WHEN chosen THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM front),
few AS (SELECT source, gap, size, q, doc_id FROM gaps WHERE q IS NOT NULL AND NOT chosen AND size > 0
  QUALIFY row_number() OVER (PARTITION BY source, floor(log2(size)) ORDER BY q, doc_id) <= {LAST_PLACES}),
listed AS (SELECT source, max(gap) AS gap, list({{'size': size, 'id': doc_id}} ORDER BY size DESC, q, doc_id) AS xs FROM few GROUP BY source),
fits AS (SELECT source, xs, list_reduce(xs, lambda a, x: CASE WHEN x.size <= a.gap THEN {{'gap': a.gap - x.size, 'got': list_append(a.got, x.id)}} ELSE a END, {{'gap': gap, 'got': []::BIGINT[]}}) AS a FROM listed),
lasts AS (SELECT source AS s, list_concat(a.got, list_transform(list_filter(xs, lambda x: x.size > a.gap AND x.size - a.gap < a.gap AND NOT list_contains(a.got, x.id))[-1:], lambda x: x.id)) AS ids FROM fits)
SELECT doc_id, size, source_size, target, ((sure + CASE WHEN chosen OR coalesce(list_contains(ids, doc_id), false) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM gaps LEFT JOIN lasts ON source IS NOT DISTINCT FROM s
"""
