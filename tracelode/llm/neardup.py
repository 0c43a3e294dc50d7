"""MinHash near-dedup by a multi-index Hamming join.

1. A document is a set of word shingles; documents with equal sets form a class,
   and from here on a class is one node, however many copies it has.
2. A node's signature has 64 minimum hashes of 16 bits each. Nodes whose
   signatures differ in at most 25 symbols are candidates; at a similarity of
   0.8 the difference is 12.8 on average with a deviation of 3.2.
3. The signature is cut into 13 chunks. By the pigeonhole principle two
   signatures with at most 25 differences have a chunk with one at most. For
   each chunk the allowed errors are enumerated: a key for every symbol left
   out. Two nodes under the threshold thus share one of 64 keys for certain.
4. In each group of a key every node is first held against two of its members,
   which is linear in the group: the one whose keys are shared most, which is
   the text that the others were made from, and one that the key picks by hash.
   Links are confirmed on the full sets and joined to components. Only where the
   nodes around a hub are still more than one component are they searched:
   pairs of different components under the distance are confirmed on their sets
   inside the task, and only links that tie components leave it. A hub with more
   nodes than a block is first cut into groups that share a rare item, which no
   link can do without. No link between components is lost, and no group becomes
   rows for all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table
from .graph import components
from .tokens import mix, shingles, word_hashes

SYMBOLS = 64
CHUNKS = 13
DISTANCE = 25
#: Members of a group compared at once; larger groups are cut into such blocks.
BLOCK = 1024
#: Bits of the filter that says which documents' sets are needed. Its size is fixed; where it fills up, more sets travel.
FILTER_BITS = 1 << 24

_CUTS = [round(k * SYMBOLS / CHUNKS) for k in range(CHUNKS + 1)]
_SEEDS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def signature(items: np.ndarray) -> np.ndarray:
    """The lowest 16 bits of each of 64 minimum hashes of a set."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(items), 1 << 14):
        part = items[a : a + (1 << 14)]
        for k in range(SYMBOLS):
            least[k] = min(least[k], ((part ^ _SEEDS[k]) * (_SEEDS[k] | np.uint64(1))).min())
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def _set_of(text: str | None, n: int) -> tuple[np.ndarray, int]:
    items = shingles(word_hashes(text), n)
    return items, xxhash.xxh3_64_intdigest(items.tobytes()) - 2**63


def _digests(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, nodes, signatures = batch.column("doc_id"), [], [], []
            for text in batch.column("text"):
                items, node = _set_of(text.as_py(), n)
                sizes.append(len(items))
                nodes.append(node if len(items) else None)
                signatures.append(signature(items).tobytes() if len(items) else None)
            arrays = [ids, batch.column("mark"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "mark", "n_shingles", "node", "signature"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each node and key: a chunk without one of its symbols."""
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes = batch.column("node")
        symbols = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, SYMBOLS).astype(np.uint64)
        for c in range(CHUNKS):
            for out in range(_CUTS[c], _CUTS[c + 1]):
                key = np.full(len(symbols), out + 1, np.uint64)
                for k in range(_CUTS[c], _CUTS[c + 1]):
                    if k != out:
                        key = mix(key * np.uint64(3) + symbols[:, k] + np.uint64(1))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), nodes], names=["key", "node"])


def _slot(*columns) -> F.Column:
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))


def bit_filter(slots: DataFrame) -> np.ndarray:
    """Which of FILTER_BITS slots occur, as packed bits: a table of fixed size (2 MB), gathered by Spark's bitmap aggregates."""
    column = F.col(slots.columns[0]) + 1  # Spark's buckets begin with the value 1
    rows = slots.groupBy(F.bitmap_bucket_number(column).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) << 12
        out[at : at + (1 << 12)] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_filter(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7) & 1).astype(bool)


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, items = [], []
            for text in batch.column("text"):
                found, node = _set_of(text.as_py(), n)
                nodes.append(node)
                items.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(items, pa.list_(pa.int64()))], names=["node", "items"])

    return run


def _needed(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, items) for the wanted nodes: from one document of each, which a fixed-size filter picks before anything is hashed."""
    owners = nodes.join(wanted, "node").select("owner")
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(owners.select(_slot("owner").alias("slot"))))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = in_filter(bits.value, batch.column("slot").to_numpy(zero_copy_only=False))
            if keep.any():
                yield pa.RecordBatch.from_arrays([batch.column("text").filter(pa.array(keep))], names=["text"])

    texts = docs.select("text", _slot("doc_id").alias("slot")).mapInArrow(picked, "text string")
    return texts.mapInArrow(_sets(n), "node long, items array<long>").dropDuplicates(["node"])


def _confirm(scratch: Scratch, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    both = F.size(F.array_intersect("items_a", "items_b"))
    small, large = F.least(F.size("items_a"), F.size("items_b")), F.greatest(F.size("items_a"), F.size("items_b"))
    found = (
        pairs.join(left, "a").join(right, "b").where(small * 100 >= large * percent)
        .withColumn("both", both).where(F.col("both") * 100 >= (F.size("items_a") + F.size("items_b") - F.col("both")) * percent)
    )
    return scratch.keep(found.select("a", "b"))


def _blocks(percent: int):
    """Links between components in each sorted group (hub, item, i, j), between nodes of its blocks i and j.

    Pairs under the signature distance and near enough in size are confirmed
    here on their full sets, so that no pair leaves the task. A link is given
    back only if it ties components that no earlier link of the group tied.
    """

    def group_links(t: pa.Table) -> Iterator[pa.RecordBatch]:
        i, j, block, node, root = (t.column(c).to_numpy() for c in ("i", "j", "block", "node", "root"))
        symbols = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        lists = t.column("items").combine_chunks()
        starts, size = lists.offsets.to_numpy().astype(np.int64)[:-1], np.diff(lists.offsets.to_numpy()).astype(np.int64)
        ids = np.unique(lists.values.to_numpy(), return_inverse=True)[1]
        starts -= starts[0]
        flag = np.zeros(int(ids.max()) + 1, bool)
        tied: dict[int, int] = {}

        def find(r: int) -> int:
            while (up := tied.get(r, r)) != r:
                r = up
            return r

        out: tuple[list, list] = ([], [])
        right = np.flatnonzero(block == j)
        for x in np.flatnonzero(block == i).tolist():
            few, many = np.minimum(size[x], size[right]), np.maximum(size[x], size[right])
            other = right[(few * 100 >= many * percent) & (root[right] != root[x]) & ((i[0] != j[0]) | (node[right] > node[x]))]
            if len(other):
                other = other[(symbols[other] != symbols[x]).sum(axis=1) <= DISTANCE]
            other = np.array([y for y in other.tolist() if find(int(root[y])) != find(int(root[x]))], np.int64)
            if not len(other):
                continue
            own = ids[starts[x] : starts[x] + size[x]]
            flag[own] = True
            cuts = np.cumsum(size[other]) - size[other]
            at = np.repeat(starts[other] - cuts, size[other]) + np.arange(size[other].sum())
            both = np.add.reduceat(flag[ids[at]].astype(np.int64), cuts)
            flag[own] = False
            for y in other[both * 100 >= (size[x] + size[other] - both) * percent].tolist():
                p, q = find(int(root[x])), find(int(root[y]))
                if p != q:
                    tied[p] = q
                    out[0].append(min(node[x], node[y]))
                    out[1].append(max(node[x], node[y]))
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("hub", "item", "i", "j")]
            change = np.zeros(batch.num_rows - 1, bool)
            for c in cols:
                change |= c[1:] != c[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                this = tuple(int(c[a]) for c in cols)
                if this != group:
                    if held:
                        yield from group_links(pa.Table.from_batches(held))
                    group, held = this, []
                held.append(batch.slice(a, b - a))
        if held:
            yield from group_links(pa.Table.from_batches(held))

    return run


def _by_rare_items(scratch: Scratch, around: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(hub, item, node, root, n): the nodes around large hubs in groups that share one of their rarest items.

    Order the items of a hub's nodes by how many of them have each. Two sets
    that are linked share an item among the first of both, counted to
    size - ceil(percent of size) + 1: were all shared items behind, fewer than
    the least overlap would be left. So pairs need be compared only in these
    groups, and what all nodes of a hub have in common (the reason why it is
    large) makes no group. Groups of one component are done, and of groups with
    the same nodes (told by a 64-bit hash and their number) one is searched. The rows are one
    for each item of a set, whatever the hub's size.
    """
    held = scratch.keep(around.select("hub", "node", "root").join(sets, "node").select("hub", "node", "root", F.size("items").alias("size"), F.explode("items").alias("item")))
    often = held.groupBy("hub", "item").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    w = Window.partitionBy("hub", "node").orderBy(F.coalesce("n", F.lit(1)), "item")
    first = F.col("size") - F.floor((F.col("size") * percent + 99) / 100) + 1
    rare = held.join(often, ["hub", "item"], "left").withColumn("at", F.row_number().over(w)).where((F.col("at") <= first) & F.col("n").isNotNull()).select("hub", "item", "node", "root")
    rare = scratch.keep(rare)
    groups = rare.groupBy("hub", "item").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("who")).where("r1 <> r2")
    once = groups.groupBy("hub", "n", "who").agg(F.min("item").alias("item"))  # items that the same nodes share make one group
    return rare.join(once.select("hub", "item", "n"), ["hub", "item"])


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    A document's set holds its distinct runs of ``words`` words (lower-cased
    A-Z, split at ASCII white space); with fewer words, the whole sequence is
    its one member; with none it is empty and linked with nothing. Documents
    are linked if 100 * intersection >= percent * union; component_id is the
    least doc_id that can be reached. A null doc_id counts as smaller than any
    other and is given back as null. Rows with equal doc_id and equal text are
    copies like any others; all rows with the least doc_id are kept. Other
    columns are ignored. Sets are told apart by 64-bit hashes of 64-bit
    shingle hashes.
    """
    return with_components(spark, docs, words, percent).select("doc_id", "n_shingles", "component_id", "kept")


def text_mark() -> F.Column:
    """Tells texts of equal doc_id apart."""
    return F.xxhash64("text")


def with_components(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``near_duplicates`` with ``mark`` (of the text) and ``root``, which names a component where ids are null or repeat; null for an empty set."""
    scratch = Scratch(spark)
    plain = docs.select("doc_id", "text", text_mark().alias("mark"))
    digests = scratch.keep(plain.mapInArrow(_digests(words), "doc_id long, mark long, n_shingles long, node long, signature binary"))
    nodes = scratch.keep(digests.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id"))["doc_id"].alias("owner"), F.first("signature").alias("signature")))
    keys = scratch.keep(nodes.select("node", "signature").mapInArrow(_keys, "key long, node long"))
    groups = scratch.keep(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = scratch.keep(keys.join(groups, "key"))
    scratch.drop(keys, groups)
    # the text that others were copied from shares its keys with more nodes than its copies do
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = members.join(weight, "node")
    hubs = weighed.groupBy("key").agg(
        F.max(F.struct("weight", "node"))["node"].alias("hub"), F.min(F.struct(F.xxhash64("key", "node").alias("h"), "node"))["node"].alias("other")
    )
    with_hubs = members.join(hubs, "key")
    spokes = with_hubs.select("node", F.col("hub").alias("to")).unionByName(with_hubs.select("node", F.col("other").alias("to"))).where("node <> to")
    around = scratch.keep(with_hubs.select("hub", "node").distinct())
    pairs = scratch.keep(spokes.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct())
    paired = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    links = _confirm(scratch, pairs, scratch.keep(_needed(plain, nodes, paired, words)), percent)
    roots = components(scratch, links)

    # all pairs that share a key share its hub; hubs whose nodes are not one component yet are searched block by block
    labelled = around.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = labelled.groupBy("hub").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("n")).where("r1 <> r2").select("hub", "n")
    open_ = scratch.keep(labelled.join(mixed, "hub"))
    if not open_.isEmpty():
        sets = scratch.keep(_needed(plain, nodes, open_.select("node").distinct(), words))
        members = open_.where(F.col("n") <= BLOCK).select("hub", F.lit(0).cast("long").alias("item"), "node", "root", "n")
        members = members.unionByName(_by_rare_items(scratch, open_.where(F.col("n") > BLOCK), sets, percent))
        cut, other = F.ceil(F.col("n") / BLOCK).cast("int"), F.col("other")
        compared = (
            members.withColumn("cut", cut).withColumn("block", F.pmod(F.xxhash64("node"), F.col("cut")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
            .join(nodes.select("node", "signature"), "node").join(sets, "node")
            .select("hub", "item", F.least("block", other).alias("i"), F.greatest("block", other).alias("j"), "block", "node", "root", "signature", "items")
        )
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        keys = ("hub", "item", "i", "j")
        extra = compared.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_blocks(percent), "a long, b long")
        ties = roots.select(F.col("root").alias("a"), F.col("node").alias("b"))
        roots = components(scratch, ties.unionByName(extra))

    named = nodes.select("node", "owner").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min(F.struct("owner"))["owner"].alias("component"))  # in a struct null is the least
    component = named.join(least, "root").select("node", "root", "component")
    out = digests.select("doc_id", "mark", "n_shingles", "node").join(component, "node", "left")
    found = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "mark", "root", "n_shingles", found.alias("component_id"), F.col("doc_id").eqNullSafe(found).alias("kept"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), words=2, percent=80)


OP7_SQL = r"""
WITH RECURSIVE toks AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM toks),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id
    AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) * 100 >= (a.n + b.n - count(*)) * 80),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.c AS component_id, s.doc_id = c.c AS kept FROM sets s JOIN comp c ON s.doc_id = c.x
"""
