"""Removal of byte strings that repeat, by sparse prefix doubling in Spark.

A suffix array ranks all positions by their first k bytes, and doubles k with
the ranks of position p and p + k. Here only the threshold counts: which
positions share their first 200 bytes with another. Four things keep that far
below a row for every byte:

* Ranks start at half the threshold, 100 bytes, as 64-bit hashes, and only at
  positions that are picked by content: of any 101 neighbouring 100-byte
  windows (those inside one 200-byte string) the one with the least hash. Equal
  200-byte strings pick the same place, so a repeated string always shows as two
  picked positions with equal rank. About 2 in 101 positions are picked.
* A picked position whose rank is unique is done: no string that picks it
  repeats. Spark groups the ranks and only shared ones go on.
* The strings that pick a position are neighbours and form a run. Runs are
  compared whole by the hash of all their bytes: equal runs repeat in every
  position. Only where runs of one rank differ (at the ends of a repeat) are
  they cut: first into blocks of eight positions, which are ranked by the bytes
  that all eight strings hold and compared whole in the same way, and only where
  blocks of one rank differ into single positions, ranked by the pair of ranks
  of p and p + 100, which is the doubling past the threshold. Of equal runs, and
  of equal blocks, one member takes part.
* Texts that occur more than once are found by a count: every string of theirs
  repeats, so they lose all, and their copies are looked at once a task.

Texts are read in pieces of a fixed number of positions, so memory does not grow
with a text's length beyond the text itself. Hashes stand for strings: a text is
known by 64 bits, a run or block is compared by 128 and a position by 96.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .neardup import FILTER_BITS, bit_filter, in_filter
from .tokens import Rolling, mix

THRESHOLD = 200
#: Positions that are ranked together after the runs.
BLOCK = 8
#: Positions of a text that are worked on at once.
PIECE = 1 << 17


def pieces(raw: bytes, threshold: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) of the pieces of a text: each holds PIECE starts at most, with the bytes of their strings."""
    n = len(raw) - threshold + 1
    whole = np.frombuffer(raw, np.uint8)
    for a in range(0, n, PIECE):
        yield a, whole[a : min(a + PIECE, n) + threshold - 1]


def picked_runs(raw: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rank, run hash, place, first, last): the picked places and the runs of starts that pick them.

    A start p picks the least window hash (of its upper 32 bits; the first of
    equal ones) among the half-threshold windows inside its threshold bytes.
    """
    half = threshold // 2
    n = len(raw) - threshold + 1
    rolling = Rolling(raw)
    windows = rolling.windows(half)
    span = threshold - half + 1
    value = (windows & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(windows), dtype=np.uint64)
    whole = -(-len(value) // span) * span
    grid = np.full(whole, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(value)] = value
    grid = grid.reshape(-1, span)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    pick = (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.r_[0, np.flatnonzero(np.diff(pick)) + 1]
    last = np.r_[first[1:] - 1, n - 1]
    place = pick[first]
    run = rolling.slices(first, last + threshold) ^ ((place - first).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return windows[place].view(np.int64), run.view(np.int64), place, first, last


def _slots(hashes: np.ndarray) -> np.ndarray:
    """Places in the filter, from the low bits: the high bits of a picked rank are small, for it is a minimum."""
    return hashes & (FILTER_BITS - 1)


def _slot(column: str) -> Column:
    return F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1))


RUNS = "rank long, run long, text_id long, first int, last int, lead int"


def _each_once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """(text_id, bytes) of each text of a task, copies once."""
    seen: set[int] = set()
    for batch in batches:
        for k, one in enumerate(batch.column("text_id").to_pylist()):
            if one not in seen:
                seen.add(one)
                yield one, batch.column("text")[k].as_py()


def _rows(parts: Iterator[list[np.ndarray]], names: list[str], types: list[pa.DataType], size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``size`` rows from lists of columns."""
    held: list[list[np.ndarray]] = []
    n = 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def _ranks(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (list(picked_runs(piece, threshold)[:2]) for _, raw in _each_once(batches) for _, piece in pieces(raw, threshold))
        return _rows(parts, ["rank", "run"], [pa.int64()] * 2)

    return run


def _shared_runs(bits, threshold: int):
    """The runs whose rank passes the filter of shared ranks."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for one, raw in _each_once(batches):
            for at, piece in pieces(raw, threshold):
                rank, whole, place, first, last = picked_runs(piece, threshold)
                keep = in_filter(bits.value, _slots(rank))
                if keep.any():
                    yield [x[keep] for x in (rank, whole, np.full(len(rank), one), first + at, last + at, place - first)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(parts(batches), [x.split()[0] for x in RUNS.split(", ")], [pa.int64()] * 3 + [pa.int32()] * 3)

    return run


def _listed(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """(text_id, offset, bytes, columns of the listed spans less the offset) for each piece that holds a listed span's start."""
    for batch in batches:
        spans = batch.column("spans")
        for k, one in enumerate(batch.column("text_id").to_pylist()):
            columns = [f.to_numpy() for f in spans[k].values.flatten()]
            for at, piece in pieces(batch.column("text")[k].as_py(), threshold):
                own = (columns[0] >= at) & (columns[0] < at + PIECE)  # a span lies in one piece
                if own.any():
                    yield one, at, piece, [columns[0][own] - at, columns[1][own] - at, *(c[own] for c in columns[2:])]


BLOCKS = "rank long, run long, text_id long, first int, last int"


def _blocks(threshold: int):
    """The blocks of the listed runs: aligned to the run's place, ranked by the bytes common to all strings of a whole block."""
    size_of = min(BLOCK, threshold // 2)
    core = threshold - size_of + 1

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for one, at, piece, (first, last, lead) in _listed(batches, threshold):
            place = (first + lead).astype(np.int64)
            low, high = (place - last) // size_of, (place - first) // size_of
            size = high - low + 1
            owner = np.repeat(np.arange(len(first)), size)
            block = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[owner]
            tail = place[owner] - block * size_of
            start, end = np.maximum(first[owner], tail - size_of + 1).astype(np.int64), np.minimum(last[owner], tail).astype(np.int64)
            rolling = Rolling(piece)
            whole = rolling.slices(start, end + threshold) ^ ((tail - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
            yield [rolling.slices(tail, tail + core).view(np.int64), whole.view(np.int64), np.full(len(start), one), start + at, end + at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(parts(batches), [x.split()[0] for x in BLOCKS.split(", ")], [pa.int64()] * 3 + [pa.int32()] * 2)

    return run


PLACES = "pair long, check int, text_id long, first int"


def _positions(threshold: int):
    """For each start of the listed blocks, the ranks of its two halves as 96 bits."""
    half = threshold // 2

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for one, at, piece, (first, last) in _listed(batches, threshold):
            size = last.astype(np.int64) - first + 1
            p = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            rolling = Rolling(piece)
            left, right = rolling.slices(p, p + half), rolling.slices(p + half, p + threshold)
            yield [mix(left * np.uint64(3) + right).view(np.int64), (right.view(np.int64) >> 32).astype(np.int32), np.full(len(p), one), p + at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(parts(batches), [x.split()[0] for x in PLACES.split(", ")], [pa.int64(), pa.int32(), pa.int64(), pa.int32()])

    return run


def _cut(threshold: int, with_removed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, one in enumerate(batch.column("text_id").to_pylist()):
                raw = memoryview(batch.column("text")[k].as_py())
                first, last = (f.to_numpy().astype(np.int64) for f in batch.column("spans")[k].values.flatten())
                order = np.argsort(first, kind="stable")
                first, last = first[order], np.maximum.accumulate(last[order] + threshold)
                new = np.r_[True, first[1:] > last[:-1]]
                starts, ends = first[new], last[np.r_[np.flatnonzero(new)[1:] - 1, len(first) - 1]]
                digest = hashlib.sha256()
                for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(raw)], strict=True):
                    digest.update(raw[a:b])
                removed = pa.array([np.stack([starts, ends], axis=1).tolist() if with_removed else None], pa.list_(pa.list_(pa.int64())))
                columns = [pa.array([one]), pa.array([int((ends - starts).sum())]), pa.array([len(starts)]), pa.array([digest.hexdigest()]), removed]
                yield pa.RecordBatch.from_arrays(columns, names=["text_id", "n_removed", "n_spans", "kept_sha256", "removed"])

    return run


CUT = "text_id long, n_removed long, n_spans long, kept_sha256 string, removed array<array<long>>"


def _kinds(scratch: Scratch, rows: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """(kinds, open): a row for each (rank, run) with its count and one member; the members of ranks with more than one kind."""
    member = F.struct("text_id", "first", "last", *more)
    kinds = scratch.keep(rows.groupBy("rank", "run").agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("one")))
    mixed = kinds.groupBy("rank").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("rank")
    return kinds, kinds.join(mixed, "rank").select("one.*")


def repeated_bytes(spark: SparkSession, docs: DataFrame, threshold: int = THRESHOLD, with_removed: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (start, end of each maximal run) for every row.

    Removed is each byte covered by a string of ``threshold`` bytes (an even
    number) that starts anywhere else too, in the same document or another;
    strings are judged on the input. A null text is an empty one; texts under
    the threshold lose nothing. Two equal rows repeat each other. Null and
    equal doc_ids are given back as they are; other columns are ignored. A very
    long text is read in pieces. Without ``with_removed`` that column is null.
    """
    if threshold < 2 or threshold % 2:
        raise ValueError("the threshold must be an even number of bytes")
    scratch, spark_bits = Scratch(spark), spark.sparkContext.broadcast
    raw = F.coalesce("text", F.lit(""))
    known = docs.select("doc_id", F.xxhash64(raw).alias("text_id"), F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("own_sha256"))
    texts = docs.where(F.octet_length("text") >= threshold).select(F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_id"))
    copies = texts.groupBy("text_id").agg(F.count(F.lit(1)).alias("n"), F.first(F.octet_length("text")).cast("long").alias("n_removed")).where("n > 1")
    copies = scratch.keep(copies.select("text_id", "n_removed"))

    def only(ids: DataFrame) -> DataFrame:
        """The texts whose id is listed, each once, with ``ids``' columns; only texts that pass a filter are shuffled."""
        bits = spark_bits(bit_filter(ids.select(_slot("text_id").alias("slot"))))

        def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                own = batch.column("text_id").to_numpy()
                keep = in_filter(bits.value, _slots(own))
                for k in np.flatnonzero(keep).tolist():
                    keep[k] = int(own[k]) not in seen
                    seen.add(int(own[k]))
                if keep.any():
                    yield batch.filter(pa.array(keep))

        return texts.mapInArrow(picked, "text binary, text_id long").join(ids, "text_id").dropDuplicates(["text_id"])

    def by_text(spans: DataFrame) -> DataFrame:
        return scratch.keep(spans.groupBy("text_id").agg(F.collect_set(F.struct(*[c for c in spans.columns if c != "text_id"])).alias("spans")))

    # a rank is shared if two runs have it, or one run of a text that has copies (counted apart)
    ranks = texts.mapInArrow(_ranks(threshold), "rank long, run long").groupBy("rank").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = spark_bits(bit_filter(ranks.select(_slot("rank").alias("slot"))))
    found = scratch.keep(texts.mapInArrow(_shared_runs(shared, threshold), RUNS))
    kinds, open_ = _kinds(scratch, found, "lead")
    whole = found.join(kinds.where("n > 1").select("rank", "run"), ["rank", "run"]).select("text_id", "first", "last")

    # where runs of one rank differ: blocks, then single positions
    listed = by_text(open_)
    blocks = scratch.keep(only(listed).select("text", "text_id", "spans").mapInArrow(_blocks(threshold), BLOCKS))
    alike, open_blocks = _kinds(scratch, blocks)
    even = blocks.join(alike.where("n > 1").select("rank", "run"), ["rank", "run"]).select("text_id", "first", "last")
    some = by_text(open_blocks)
    places = scratch.keep(only(some).select("text", "text_id", "spans").mapInArrow(_positions(threshold), PLACES))
    twice = places.groupBy("pair", "check").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    single = places.join(twice, ["pair", "check"]).select("text_id", "first", F.col("first").alias("last"))

    spans = by_text(whole.unionByName(even).unionByName(single).join(copies, "text_id", "left_anti"))
    scratch.drop(found, kinds, listed, blocks, alike, some, places)
    cut = scratch.keep(only(spans).select("text", "text_id", "spans").mapInArrow(_cut(threshold, with_removed), CUT))
    nothing = hashlib.sha256(b"").hexdigest()
    every = F.array(F.array(F.lit(0).cast("long"), F.col("n_removed"))) if with_removed else F.lit(None).cast("array<array<long>>")
    gone = copies.select("text_id", "n_removed", F.lit(1).cast("long").alias("n_spans"), F.lit(nothing).alias("kept_sha256"), every.alias("removed"))
    changed = cut.unionByName(gone)
    none = F.array().cast("array<array<long>>") if with_removed else F.lit(None).cast("array<array<long>>")
    return known.join(changed, "text_id", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "own_sha256").alias("kept_sha256"), F.coalesce("removed", none).alias("removed"),
    )


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_bytes(spark, table(spark, sf_dir, "documents"), with_removed=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
