"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over a run of words: hashes are taken over the
words at its ones, and the words at its zeros may differ. Every place of every
benchmark item is hashed under each mask. Documents are streamed past that
table; where a hash agrees, the item is laid over the document at that offset,
word by word, and the longest run in which at least 80 % of the words agree is
taken. Hits with a run of at least 13 words (or all of a shorter item) are
overlaps. Words are lower-cased (A-Z) and end at ASCII white space and
punctuation.

A benchmark of up to ``BLOCK_BYTES`` bytes of text, which is checked, goes to
every task as one index. A larger one is never sent whole: its seeds are a table,
documents' seeds that may be in it (by a filter of fixed size) are joined with it
on the hash, and the candidates are verified beside their texts, which travel
once each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .neardup import FILTER_BITS, bit_filter, in_filter
from .tokens import mix, word_hashes

#: The masks.
MASKS = ("11111", "1101011", "110010111", "10110101001")
MIN_WORDS = 13
MIN_ITEM_WORDS = 5
PERCENT = 80
#: Bytes of benchmark text that every task may hold as an index; the index takes about 25 times as much.
BLOCK_BYTES = 4 << 20
_FILTER_BITS = 22

OVERLAP = "item_id long, doc_start long, item_start long, n_words long, n_equal long"
FOUND = f"doc_id long, text_id long, {OVERLAP}"


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash under the mask at every place where it fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, int(mask, 2), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out = mix(out * np.uint64(3) + words[k : k + n])
    return out


def longest_run(equal: np.ndarray, percent: int = PERCENT) -> tuple[int, int]:
    """(start, end) of the longest run in which at least ``percent`` of the places are equal; of equal runs the first."""
    sums = np.r_[0, np.cumsum(np.where(equal, 100 - percent, -percent))]
    lowest = np.minimum.accumulate(sums)  # the first place at which a sum this low was seen starts the run
    starts = np.flatnonzero(np.r_[True, lowest[1:] < lowest[:-1]])
    # for each end, the earliest start with a sum that is not higher
    at = starts[np.minimum(np.searchsorted(-sums[starts], -sums, side="left"), len(starts) - 1)]
    length = np.where(sums[at] <= sums, np.arange(len(sums)) - at, 0)
    end = int(length.argmax())
    return end - int(length[end]), end


class Block:
    """A part of the benchmark as one array of words with its seeds in sorted order."""

    def __init__(self, items: list[tuple[int | None, str | None]], min_words: int, percent: int, min_item_words: int = MIN_ITEM_WORDS):
        self.min_words, self.percent = min_words, percent
        kept = [(k, w) for k, text in items if len(w := word_hashes(text, passages=True)) >= min_item_words]
        self.ids, self.words = [k for k, _ in kept], [w for _, w in kept]
        hashes, owners, places = [], [], []
        for k, w in enumerate(self.words):
            for mask in MASKS:
                h = seed_hashes(w, mask)
                hashes.append(h)
                owners.append(np.full(len(h), k))
                places.append(np.arange(len(h)))
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.owners, self.places = (np.concatenate(x)[order] if hashes else np.zeros(0, int) for x in (owners, places))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def overlaps(self, words: np.ndarray) -> Iterator[tuple]:
        """(item_id, doc_start, item_start, n_words, n_equal) of each item that overlaps, at each offset."""
        diagonals = set()
        for mask in MASKS:
            h = seed_hashes(words, mask)
            at = np.flatnonzero(self.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            for p, a, b in zip(at[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                diagonals.update((int(o), p - int(q)) for o, q in zip(self.owners[a:b], self.places[a:b], strict=True))
        for owner, shift in sorted(diagonals):
            found = verify(words, self.words[owner], shift, self.min_words, self.percent)
            if found:
                yield self.ids[owner], *found


def verify(words: np.ndarray, item: np.ndarray, shift: int, min_words: int, percent: int) -> tuple[int, int, int, int] | None:
    """(doc_start, item_start, n_words, n_equal) of the longest run where the item lies over the words at an offset; None if it is too short."""
    a, b = max(0, -shift), min(len(item), len(words) - shift)
    equal = item[a:b] == words[a + shift : b + shift]
    start, end = longest_run(equal, percent)
    if end - start < min(min_words, len(item)):
        return None
    return a + start + shift, a + start, end - start, int(equal[start:end].sum())


def _search(block):
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, one, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_id").to_pylist(), batch.column("text"), strict=True):
                rows += [(doc, one, *hit) for hit in block.value.overlaps(word_hashes(text.as_py(), passages=True))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return run


def _seeds(bits=None, min_item_words: int = 0):
    """(hash, owner, place) of the seeds of texts of enough words; with a filter, of those that pass it, each text of a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for owner, text in zip(batch.column("owner").to_pylist(), batch.column("text"), strict=True):
                if owner in seen:
                    continue
                seen.add(owner)
                words = word_hashes(text.as_py(), passages=True)
                if len(words) < min_item_words:
                    continue
                for mask in MASKS:
                    h = seed_hashes(words, mask).view(np.int64)
                    at = np.arange(len(h)) if bits is None else np.flatnonzero(in_filter(bits.value, h & (FILTER_BITS - 1)))
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(np.full(len(at), owner)), pa.array(at)], names=["hash", "owner", "place"])

    return run


def _verified(min_words: int, percent: int):
    """Overlaps from rows sorted by text_id: a text's own rows come before its candidates (item_id, item_text, shifts)."""
    names = ["text_id", *(x.split()[0] for x in OVERLAP.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words = None, None
        for batch in batches:
            rows = []
            for one, text, item, item_text, shifts in zip(*(batch.column(c) for c in ("text_id", "text", "item_id", "item_text", "shifts")), strict=True):
                if text.is_valid:
                    if at != one.as_py():
                        at, words = one.as_py(), word_hashes(text.as_py(), passages=True)
                    continue
                other = word_hashes(item_text.as_py(), passages=True)
                for shift in sorted(shifts.as_py()):
                    found = verify(words, other, shift, min_words, percent)
                    if found:
                        rows.append((at, item.as_py(), *found))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return run


def _joined(spark: SparkSession, docs: DataFrame, items: DataFrame, min_words: int, percent: int, min_item_words: int) -> DataFrame:
    """The rows of ``_overlaps`` by a join of seeds, for a benchmark of any size."""
    scratch = Scratch(spark)
    items = scratch.keep(items.select(F.xxhash64("item_id", "text").alias("owner"), "item_id", "text"))
    seed_rows = "hash long, owner long, place long"
    seeds = scratch.keep(items.select("owner", "text").mapInArrow(_seeds(None, min_item_words), seed_rows))
    slot = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = spark.sparkContext.broadcast(bit_filter(seeds.select(slot.alias("slot"))))
    texts = docs.where("text is not null").select(F.xxhash64("text").alias("owner"), "text")
    own = texts.mapInArrow(_seeds(bits), seed_rows).select("hash", F.col("owner").alias("text_id"), F.col("place").alias("at"))
    hits = own.join(seeds, "hash").select("text_id", F.col("owner").alias("item"), (F.col("at") - F.col("place")).alias("shift"))
    pairs = scratch.keep(hits.groupBy("text_id", "item").agg(F.collect_set("shift").alias("shifts")))
    some = spark.sparkContext.broadcast(bit_filter(pairs.select(F.col("text_id").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("slot"))))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column("owner").to_numpy()
            keep = in_filter(some.value, ids & (FILTER_BITS - 1))
            for k in np.flatnonzero(keep).tolist():
                keep[k] = int(ids[k]) not in seen
                seen.add(int(ids[k]))
            if keep.any():
                yield batch.filter(pa.array(keep))

    wanted = texts.mapInArrow(picked, "owner long, text string").select(F.col("owner").alias("text_id"), "text", F.lit(0).alias("kind"))
    named = pairs.join(items.select(F.col("owner").alias("item"), "item_id", F.col("text").alias("item_text")), "item").select("text_id", "item_id", "item_text", "shifts", F.lit(1).alias("kind"))
    both = wanted.unionByName(named, allowMissingColumns=True).select("text_id", "kind", "text", "item_id", "item_text", "shifts")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = both.repartition(parts, "text_id").sortWithinPartitions("text_id", "kind").mapInArrow(_verified(min_words, percent), f"text_id long, {OVERLAP}")
    return docs.select("doc_id", F.xxhash64("text").alias("text_id")).join(scratch.keep(found), "text_id").select(*[x.split()[0] for x in FOUND.split(", ")])


def _overlaps(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES, min_item_words: int = MIN_ITEM_WORDS
) -> DataFrame:
    items = benchmark.select("item_id", "text").distinct()
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > block_bytes:
        return _joined(spark, docs, items.where("text is not null"), min_words, percent, min_item_words)
    rows = sorted(((r["item_id"], r["text"]) for r in items.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    block = spark.sparkContext.broadcast(Block(rows, min_words, percent, min_item_words))
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_id")).mapInArrow(_search(block), FOUND)


def overlaps(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, n_words, n_equal: every overlap of a document with an item, at each offset.

    Starts count words. An item of fewer than ``min_words`` (13) words must be
    covered whole; items of fewer than ``min_item_words`` (5) are no evidence and
    match nothing. Null and empty texts match nothing; null ids are given back as
    null. Equal rows of documents give equal results, one for each row; equal
    rows of the benchmark count once. Very long texts are searched whole. Other
    columns are ignored. Without documents or items the result is empty.
    """
    return _overlaps(spark, docs, benchmark, **options).drop("text_id")


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, n_overlaps, n_words (of the longest) and n_equal: a row for each document and item that overlap."""
    longest = F.max(F.struct("n_words", "n_equal"))
    return (
        overlaps(spark, docs, benchmark, **options).groupBy("doc_id", "item_id")
        .agg(F.count(F.lit(1)).alias("n_overlaps"), longest.alias("longest"))
        .select("doc_id", "item_id", "n_overlaps", "longest.n_words", "longest.n_equal")
    )


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that overlap with no item, with all their columns. A document is known by its text, so null and repeated ids take nothing else with them."""
    found = Scratch(spark).keep(_overlaps(spark, docs, benchmark, **options).select(F.col("text_id").alias("_text")).distinct())
    return docs.join(found, F.xxhash64(docs["text"]) == found["_text"], "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents of the whole table, with the items found in them."""
    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
