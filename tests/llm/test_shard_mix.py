import math
import random

import pytest
from conftest import SMALL
from parity import connect, same
from pyspark.sql import functions as F

from tracelode.llm import mix, shard

SCHEMA = "doc_id long, text string, source string, shard string"


def _rows(n=300):
    r = random.Random(1)
    rows = [(k, "w " * r.randrange(30), f"s{k % 4}", "x") for k in range(n)]
    return rows + [(None, None, None, None), (7, "", "", "y"), *[(5, "same", "s0", "z")] * 120]


def test_rows_law(spark):
    got = shard.shard_records(spark.createDataFrame(_rows(), SCHEMA), 8, cell_rows=16).collect()
    assert len(got) == 422
    slots = {}
    for r in got:
        slots.setdefault(r["_shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(map(str, (tuple(r)[:4] for r in got))) == sorted(map(str, _rows()))


def test_order_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    a, b = (sorted(map(str, shard.shard_records(df.repartition(n), 3).collect())) for n in (1, 9))
    assert a == b
    assert a != sorted(map(str, shard.shard_records(df, 3, seed=2).collect()))


def test_fisher_yates_is_a_fair_permutation(spark):
    rows = spark.range(3000).select(shard.fisher_yates(F.lit(4), F.col("id")).alias("p")).collect()
    counts = [[0] * 4 for _ in range(4)]
    for r in rows:
        assert sorted(r.p) == [0, 1, 2, 3]
        for k, v in enumerate(r.p):
            counts[k][v] += 1
    assert all(650 < c < 850 for row in counts for c in row)


def test_empty_and_one(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    assert shard.shard_records(df.where("false"), 8).count() == 0
    assert shard.shard_records(df.limit(1), 8).first()["slot"] == 0
    with pytest.raises(ValueError):
        shard.shard_records(df, 0)


def test_written_shards(spark, tmp_path):
    shard.write_shards(spark.createDataFrame([(k, str(k)) for k in range(50)], "doc_id long, text string"), f"file://{tmp_path}/out", 4)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 50


def test_query1(spark):
    got = shard.op1_sharding(spark, SMALL).collect()
    assert len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_query1_against_plain_python(spark):
    """Every column of every row: size, checksum, law, and shards with gapless slots whose row counts are at most one apart."""
    import zlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = shard.op1_sharding(spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    slots = {}
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_cells_are_bounded_by_bytes(spark):
    rows = [(k, "x" * 200_000, [str(k)], 1.5) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tags array<string>, w double")
    assert df.select(shard.row_bytes(df).alias("b")).agg(F.min("b")).first()[0] >= 200_000
    got = shard.shard_records(df, 4, cell_bytes=1_000_000).collect()
    assert sorted(r.doc_id for r in got) == list(range(40)) and len({(r.shard, r.slot) for r in got}) == 40


def test_query2_against_sql(spark):
    same(mix.op2_mixing(spark, SMALL), connect(SMALL), mix.OP2_SQL)


def _fill(sizes, weights, share=1.5, most=2.0):
    """Share by weight, cap, share the excess again, until none is above."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / total > most * sizes[k]]
        if not over:
            for k in open_:
                out[k] = left * weights[k] / total
            break
        for k in over:
            out[k] = most * sizes[k]
            left -= out[k]
            open_.discard(k)
    return out


def test_targets_against_brute_force(spark):
    r = random.Random(3)
    for _ in range(4):
        sizes = [r.choice([0, 5, 100, 1000, r.randrange(5000)]) for _ in range(7)]
        names = [f"s{k}" for k in range(6)] + [None]
        got = {x.source: x.target for x in mix.targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")).collect()}
        want = _fill(sizes, [(5, 2, 1)[k % 3] for k in range(7)])
        assert all(math.isclose(got[n], w, abs_tol=1e-6) for n, w in zip(names, want, strict=True))


def test_wide_targets_equal_targets(spark):
    from tracelode.llm.common import Scratch

    r = random.Random(5)
    rows = [(f"host{k}", r.choice([0, 7, 7, 1000, r.randrange(10**6)])) for k in range(3000)] + [(None, 500), ("", 40)]
    df = spark.createDataFrame(rows, "source string, source_size long").repartition(5)
    scratch = Scratch(spark)
    for some in (df, df.where("source is null"), df.where("source_size = 0"), df.where("source_size = 7"), df.where("false")):
        assert sorted(map(str, mix.wide_targets(scratch, some).collect())) == sorted(map(str, mix.targets(some).collect()))


def test_mix_of_many_sources(spark, monkeypatch):
    r = random.Random(6)
    df = spark.createDataFrame([(k, f"s{k % 60}" if k % 7 else None, r.choice([0, 1, 5, 40])) for k in range(900)], "key long, source string, size long")
    want = sorted(map(str, mix.take(spark, df).collect()))
    monkeypatch.setattr(mix, "SMALL_ROWS", 3)
    assert sorted(map(str, mix.take(spark, df).collect())) == want


def test_mix_edges(spark):
    r = random.Random(2)
    rows = [(k, f"s{k % 5}" if k % 7 else None, r.choice([0, 1, 5, 40, 400])) for k in range(400)] + [(9, "s1", 3)] * 200
    df = spark.createDataFrame(rows, "key long, source string, size long")
    got = mix.take(spark, df).collect()
    assert len(got) == 600 and all(0 <= x.copies <= 2 for x in got)
    by = {}
    for x in got:
        t = by.setdefault(x.source, [x.target, 0])
        t[1] += x.copies * x.size
    assert all(abs(t - taken) <= 200 for t, taken in by.values())  # half of the smallest size that is left
    again = mix.take(spark, df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mix.take(spark, df.where("false")).count() == 0


def test_mixed_documents(spark):
    docs = spark.createDataFrame([(k, f"word {k} " * (k % 9), "en", f"s{k % 3}", k) for k in range(90)] + [(None, None, None, None, None)], "doc_id long, text string, lang string, source string, size long")
    out = mix.mix_documents(spark, docs)
    assert out.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert max(counts.values()) <= 2


def test_mixed_documents_with_clashing_columns(spark):
    names = ["doc_id", "text", "source", "key", "key_", "_key", "own_key", "mix_source", "times", "copy"]
    rows = [(k, f"word {k} " * (1 + k % 9), f"s{k % 3}", *[f"{c}{k}" for c in names[3:]]) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names[2:]))
    plain = mix.mix_documents(spark, docs.select("doc_id", "text", "source"))
    out = mix.mix_documents(spark, docs)
    assert out.columns == names
    got = out.collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in plain.collect())
    assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in names[3:])
    assert mix.mix_documents(spark, docs.where("false")).count() == 0


def test_mix_with_one_document_that_holds_much_of_its_source(spark):
    r = random.Random(6)
    for seed in ("a", "b"):
        # p is about 0.5: the front of a source stops at a long document
        rows = [(k, "s" if k % 2 else None, r.randrange(300, 500)) for k in range(4000)] + [(5000 + k, "s" if k % 2 else None, 400_000) for k in range(6)]
        got = mix.take(spark, spark.createDataFrame(rows, "key long, source string, size long"), weights=(1,), share=0.5, seed=seed).collect()
        assert len(got) == len(rows)
        for s in ("s", None):
            own = [x for x in got if x.source == s]
            miss = own[0].target - sum(x.copies * x.size for x in own)
            left = [x.size for x in own if x.copies == 0]
            assert miss < min(left) and abs(miss) <= min(left) / 2 + 1, (seed, s, miss)
