"""Sharding: a two-pass external shuffle in DataFrame functions only.

Pass 1 scatters the records uniformly over many small cells with a seeded
hash.  Pass 2 brings each cell together, permutes it by Fisher-Yates and deals
it out.  A uniform scatter followed by a uniform permutation of every cell is a
uniform permutation of the corpus, and no task ever holds more than one cell at
a time.  A record's place in the whole order is its cell's offset plus its
place in the cell; shard = place mod n and slot = place div n, so the shards'
row counts are at most one apart (the ``rows`` law).

Equal rows hash alike, so they are counted first (with Spark's map-side
partial aggregation) and numbered; the number is part of the hash.  A third of
all rows being copies of one row therefore spreads like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import fresh, table

#: Rows and bytes in a cell, on average, whichever gives more cells. A cell is what one Fisher-Yates pass holds; the
#: pass copies the cell's numbers once for each of its rows.
CELL_ROWS, CELL_BYTES = 256, 32 << 20
#: Cells are numbered within this many blocks at most, so offsets need no global sort.
BLOCKS = 4096


def fisher_yates(n: Column, seed: Column) -> Column:
    """A permutation of 0..n-1 as array<int>: for i from n-1 down to 1 swap i with a seeded j in [0, i]."""

    def swap(a: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(seed, i), i + 1).cast("int")
        swapped = F.concat(
            F.slice(a, F.lit(1), j),
            F.slice(a, i + 1, F.lit(1)),
            F.slice(a, j + 2, i - j - 1),
            F.slice(a, j + 1, F.lit(1)),
            F.slice(a, i + 2, n - i - 1),
        )
        return F.when(j < i, swapped).otherwise(a)

    steps = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.sequence(F.lit(0), n - 1), swap)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: texts and binaries by their length, other columns of one value as 8, nested ones by their text."""
    total = F.lit(8).cast("long")
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType | T.BinaryType):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
            total = total + F.coalesce(F.octet_length(c.cast("string")), F.lit(0))
        else:
            total = total + 8
    return total


def shard_records(df: DataFrame, n_shards: int = 8, seed: int = 20_240, cell_rows: int = CELL_ROWS, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """All rows of ``df`` in a seeded random order, dealt to shards 0..n_shards-1.

    Adds ``shard`` int and ``slot`` long (gapless from 0 in each shard). If the
    frame has columns of those names, the added ones get a leading underscore.
    Nulls in any column, empty and very long texts are ordinary values; equal
    rows are all kept and spread like different ones; an empty frame gives an
    empty frame. The order depends on the rows and the seed alone, not on how
    the input is partitioned. A cell holds about ``cell_rows`` rows or
    ``cell_bytes`` bytes, whichever is less, so long texts make more cells; one
    row is the least that a cell can hold. Map columns cannot be compared and are refused by
    Spark.
    """
    if n_shards < 1 or cell_rows < 1 or cell_bytes < 1:
        raise ValueError("n_shards, cell_rows and cell_bytes must be at least 1")
    names = df.columns
    shard, slot, times, copy, mix, cell, block, n, rows, place, start, row = fresh(
        df, "shard", "slot", "times", "copy", "mix", "cell", "block", "n", "rows", "place", "start", "row"
    )
    total, size = df.select(row_bytes(df).alias("b")).agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    n_cells = max(1, -(-total // cell_rows), -(-size // cell_bytes))
    per_block = -(-n_cells // BLOCKS)
    dealt = (
        df.groupBy(*names)
        .agg(F.count(F.lit(1)).alias(times))
        .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
        .withColumn(mix, F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in names], F.col(copy)))
        .withColumn(cell, F.pmod(F.col(mix), F.lit(n_cells)))
    )
    sizes = dealt.groupBy(cell).agg(F.count(F.lit(1)).alias(n)).withColumn(block, F.expr(f"`{cell}` div {per_block}"))
    # the window without partitions runs over the blocks, BLOCKS rows at most
    blocks = sizes.groupBy(block).agg(F.sum(n).alias(rows)).withColumn(
        place, F.sum(rows).over(Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    )
    before = F.sum(n).over(Window.partitionBy(block).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1))
    offsets = (
        sizes.withColumn(start, F.coalesce(before, F.lit(0)))
        .join(F.broadcast(blocks.select(block, F.coalesce(F.col(place), F.lit(0)).alias(place))), block)
        .select(cell, (F.col(start) + F.col(place)).alias(start))
    )
    # the order inside a cell before its permutation must not depend on arrival
    held = dealt.groupBy(cell).agg(
        F.sort_array(F.collect_list(F.struct(F.col(mix), F.col(copy), F.struct(*[F.col(f"`{c}`") for c in names]).alias(row)))).alias(rows)
    )
    order = fisher_yates(F.size(rows), F.xxhash64(F.lit(seed + 1), F.col(cell)))
    out = (
        held.join(offsets, cell)
        .select(start, rows, F.posexplode(order).alias(place, n))
        .select(F.element_at(rows, F.col(n) + 1)[row].alias(row), (F.col(start) + F.col(place)).alias(place))
    )
    return out.select(
        f"`{row}`.*", F.pmod(F.col(place), F.lit(n_shards)).cast("int").alias(shard), F.expr(f"`{place}` div {n_shards}").alias(slot)
    )


def write_shards(df: DataFrame, path: str, n_shards: int = 8, seed: int = 20_240) -> None:
    """Write the shuffled records below ``path``, a folder for each shard, each file in slot order."""
    out = shard_records(df, n_shards, seed)
    shard, slot = out.columns[-2:]
    parts = max(n_shards, df.sparkSession.sparkContext.defaultParallelism)
    out.repartitionByRange(parts, shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under the ``rows`` law.

    A null text has size 1 and the checksum of the empty text; a null doc_id is
    an ordinary value.
    """
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
    )
    return shard_records(docs, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
