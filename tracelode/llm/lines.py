"""Line dedup by hashes: range-partitioned, sorted, streamed; the result is a keep bitmap for each document.

No text is moved to compare lines. Every line of 40 code points or more becomes
a row of a 128-bit hash, its document and its position. The rows are
range-partitioned by (hash, document, position) and sorted in that order, the
largest doc_id first, so one pass over a partition sees the first occurrence of
a line before the others. A line that is everywhere fills several partitions:
the ranges cut through it, because the document is part of the sort key. What a
partition must know of a group that began before it is worked out from one
small summary row for each partition.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

MIN_CHARS = 40
MIN_DOCS = 5
#: What is stripped from a line, and how A-Z is lower-cased.
STRIPPED = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
NULL_ID = -(2**63)


def line_key(line: bytes) -> bytes:
    return line.strip(STRIPPED).translate(LOWER)


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


ROWS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32())])


def _line_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if len(raw) < min_chars:
                    continue
                text_hash, doc = _signed(xxhash.xxh3_64_intdigest(raw)), NULL_ID if doc is None else doc
                for pos, line in enumerate(raw.split(b"\n")):
                    if len(line) >= min_chars and _long_enough(key := line_key(line), min_chars):
                        h = xxhash.xxh3_128_intdigest(key)
                        for col, x in zip(cols, (_signed(h >> 64), _signed(h & (2**64 - 1)), doc, text_hash, pos), strict=True):
                            col.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ROWS, strict=True)], schema=ROWS)

    return run


def _by_part(fn):
    """fn(part, chunks) for each partition number in the stream; chunks are column arrays in sorted order."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
        for batch in batches:
            if batch.num_rows:
                cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("h1", "h2", "doc", "text_hash", "pos", "part")]
                cuts = [0, *(np.flatnonzero(np.diff(cols[5])) + 1).tolist(), batch.num_rows]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    yield int(cols[5][a]), [c[a:b] for c in cols[:5]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in itertools.groupby(chunks(batches), key=lambda x: x[0]):
            yield from fn(part, (cols for _, cols in group))

    return run


def _groups(h1: np.ndarray, h2: np.ndarray) -> list[int]:
    """Where the runs of equal hashes begin, and the end."""
    return [0, *(np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1).tolist(), len(h1)]


def _summary(part: int, chunks: Iterator[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """One row: the first and the last group of the partition, with their documents.

    Groups are (h1, h2); documents are sorted in a group, so a count of changes
    counts them. A group that fills the partition is both first and last.
    """
    first: list | None = None  # [h1, h2, first doc, last doc, docs]
    now: list | None = None
    for h1, h2, doc, *_ in chunks:
        cuts = _groups(h1, h2)
        for k in sorted({0, 1, len(cuts) - 3, len(cuts) - 2} & set(range(len(cuts) - 1))):  # only the outer groups matter
            a, b = cuts[k], cuts[k + 1]
            d = doc[a:b]
            docs = int((d[1:] != d[:-1]).sum()) + 1
            if now is not None and (int(h1[a]), int(h2[a])) == (now[0], now[1]):
                now[4] += docs - (int(d[0]) == now[3])
                now[3] = int(d[-1])
            else:
                first = first or now
                now = [int(h1[a]), int(h2[a]), int(d[0]), int(d[-1]), docs]
    first = first or now
    names = [f"{w}_{c}" for w in ("first", "last") for c in ("h1", "h2", "from", "to", "docs")]
    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32())} | {n: pa.array([x], pa.int64()) for n, x in zip(names, [*first, *now], strict=True)})


SUMMARY = "part int, " + ", ".join(f"{w}_{c} long" for w in ("first", "last") for c in ("h1", "h2", "from", "to", "docs"))


def _joined(summaries: list) -> dict[int, tuple]:
    """For each partition: what came before of its first group (docs, largest doc, last doc) and what follows of its last."""
    out: dict[int, list] = {s.part: [0, None, None, 0] for s in summaries}
    carry = None  # (h1, h2), docs, largest, last doc
    for s in summaries:
        key = (s.first_h1, s.first_h2)
        if carry and carry[0] == key:
            out[s.part][:3] = carry[1:]
        if (s.last_h1, s.last_h2) == key and carry and carry[0] == key:
            carry = (key, carry[1] + s.first_docs - (s.first_from == carry[3]), carry[2], s.last_to)
        else:
            carry = ((s.last_h1, s.last_h2), s.last_docs, s.last_from, s.last_to)
    after = None  # (h1, h2), docs, first doc
    for s in reversed(summaries):
        key = (s.last_h1, s.last_h2)
        if after and after[0] == key:
            out[s.part][3] = after[1] - (after[2] == s.last_to)
        if (s.first_h1, s.first_h2) == key and after and after[0] == key:
            after = (key, after[1] + s.last_docs - (after[2] == s.last_to), s.first_from)
        else:
            after = ((s.first_h1, s.first_h2), s.first_docs, s.first_from)
    return {k: tuple(v) for k, v in out.items()}


DROPS = pa.schema([("doc", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32())])


def _stream(around, min_docs: int):
    """Stream the sorted rows of a partition; yield those that are dropped. Of a group with fewer than min_docs documents so far, its rows are held."""

    def run(part: int, chunks: Iterator[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        *before, after = around.value[part]
        group, docs, largest, last, held = None, *before, []

        def batch(rows: list[list[np.ndarray]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(o), f.type) for o, f in zip(zip(*rows, strict=True), DROPS, strict=True)], schema=DROPS)

        for h1, h2, doc, text_hash, pos in chunks:
            out = []
            cuts = _groups(h1, h2)
            for a, b in zip(cuts, cuts[1:], strict=False):
                key = (h1[a], h2[a])
                if key != group:
                    if group is not None:
                        docs, largest, last = 0, None, None
                    group, held = key, []
                d = doc[a:b]
                docs += int((d[1:] != d[:-1]).sum()) + (last is None or d[0] != last)
                largest, last = d[0] if largest is None else largest, d[-1]
                drop = d != largest
                if drop.any():
                    held.append([x[a:b][drop] for x in (doc, text_hash, pos)])
                if held and docs >= min_docs:
                    out += held
                    held = []
            if out:
                yield batch(out)
        if held and docs + after >= min_docs:  # the last group, which goes on in the next partition
            yield batch(held)

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_dropped, bitmaps, digests = [], [], [], []
        for text, drops in zip(batch.column("text"), batch.column("drops"), strict=True):
            lines = (text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")
            keep = np.ones(len(lines), bool)
            if drops.is_valid:
                keep[drops.values.to_numpy()] = False
            n_lines.append(len(lines))
            n_dropped.append(int(len(lines) - keep.sum()))
            bitmaps.append(zlib.compress(np.packbits(keep).tobytes()))
            kept = [x for x, k in zip(lines, keep, strict=True) if k] if n_dropped[-1] else lines
            digests.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
        arrays = [batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(bitmaps, pa.binary()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_lines", "n_dropped", "keep_bitmap", "kept_sha256"])


def dedup_lines(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep_bitmap (zlib of packed bits, a bit for each line), kept_sha256 for every row.

    A line's key is the line stripped of ASCII white space and with A-Z in lower
    case. Keys of ``min_chars`` code points or more that are in ``min_docs``
    documents or more lose their lines everywhere but in the largest doc_id.
    Documents are told apart by doc_id; a null doc_id is one document, smaller
    than any other. Rows with equal doc_id all count as that document, and all
    keep their lines if it is the largest. A null or empty text is one empty
    line; a very long text is one row a line until its bitmap is made. No rows, no
    result rows. Other columns are ignored.
    """
    scratch = Scratch(spark)
    # written first: the ranges are sampled from the table, and no line is hashed twice
    rows = scratch.keep(docs.select("doc_id", "text").mapInArrow(_line_rows(min_chars), "h1 long, h2 long, doc long, text_hash long, pos int"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", F.col("doc").desc(), "text_hash", "pos"]
    held = scratch.keep(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    )
    scratch.drop(rows)
    whole = _read_whole(spark, held)
    summaries = whole.mapInArrow(_by_part(_summary), SUMMARY).orderBy("part").collect()  # one small row for each partition
    around = spark.sparkContext.broadcast(_joined(summaries))
    drops = whole.mapInArrow(_by_part(_stream(around, min_docs)), "doc long, text_hash long, pos int")
    by_doc = drops.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("drops"))
    hashed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"))
    hashed = hashed.mapInArrow(_with_hash, "doc_id long, text string, doc long, text_hash long")
    joined = hashed.join(by_doc, ["doc", "text_hash"], "left").select("doc_id", "text", "drops")
    return joined.mapInArrow(_bitmaps, "doc_id long, n_lines long, n_dropped long, keep_bitmap binary, kept_sha256 string")


def _with_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [_signed(xxhash.xxh3_64_intdigest((t.as_py() or "").encode("utf-8", "surrogatepass"))) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.int64())], names=[*batch.schema.names, "text_hash"])


def _read_whole(spark: SparkSession, held: DataFrame) -> DataFrame:
    """The sorted table with every written partition whole in one task, however its files are split on reading."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return held.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "h1", "h2", F.col("doc").desc(), "text_hash", "pos")


def apply_bitmap(text: str | None, bitmap: bytes) -> str:
    """The text with the lines that the bitmap keeps."""
    lines = (text or "").split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)]
    return "\n".join(x for x, k in zip(lines, keep, strict=True) if k)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
dups AS (
  SELECT key, max(doc_id) AS last_id FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, coalesce(k.doc_id <> d.last_id, false) AS dropped FROM keyed k LEFT JOIN dups d ON k.key = d.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
