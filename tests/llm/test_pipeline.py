from conftest import SMALL
from pyspark.sql import functions as F
from test_neardup_decontam import _components

import corpus_pipeline as P
from tracelode.llm import decontam, mix


def test_stages(spark):
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix_sources", "sharding"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "1234 5678 !!", "en", "src0", 12), (10**6 + 1, None, None, None, None)], docs.schema)
    docs = docs.unionByName(extra)
    kept = P.STAGES[0][1](spark, docs, SMALL).cache()
    assert kept.columns == docs.columns and {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in kept.select("doc_id").collect()} == {10**6, 10**6 + 1}

    deduped = P.STAGES[1][1](spark, kept, SMALL).cache()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(r.doc_id for r in deduped.collect()) == sorted(x[0] for x in _components(rows, 5) if x[3])

    clean = P.STAGES[2][1](spark, deduped, SMALL).cache()
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert clean.columns == docs.columns and not any(i in r.text for r in clean.collect() for i in items)
    bad = {r.doc_id for r in decontam.contaminated(spark, deduped, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in deduped.collect()} - {r.doc_id for r in clean.collect()} == bad

    mixed = P.STAGES[3][1](spark, clean, SMALL).cache()
    assert mixed.columns == docs.columns
    items = clean.select(F.col("doc_id").alias("key"), "source", mix.word_count(F.col("text")).alias("size"))
    want = {r.key: r.copies for r in mix.take(spark, items).collect() if r.copies}
    by_source = {}
    for r in mixed.collect():
        by_source[r.source] = by_source.get(r.source, 0) + len(r.text.split())
    goals = {r.source: r.target for r in mix.take(spark, items).collect()}
    largest = {s: max(len(r.text.split()) for r in clean.collect() if r.source == s) for s in goals}
    assert all(abs(by_source.get(s, 0) - t) <= largest[s] for s, t in goals.items()) and want

    out = P.STAGES[4][1](spark, mixed, SMALL).collect()
    assert len(out) == mixed.count() and {r.shard for r in out} == set(range(8))


def _tables(spark, folder, rows, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_run_against_the_stages_one_by_one(spark):
    """run() gives what the stages give one after the other: the mix's copies of what is left, all in gapless shards."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    left = docs
    for _, stage in P.STAGES[:-1]:
        left = stage(spark, left, SMALL).cache()
    out = P.run(spark, SMALL).collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted((r.doc_id, r.text) for r in left.collect())
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_run_on_edge_rows(spark, tmp_path):
    """Null, shared and repeated ids, null, empty and very long texts, copies and a benchmark passage: what stays is known by text."""
    def text(k, n=60):
        return " ".join(f"the house w{k}x{j} and" for j in range(n))

    item = text(77, 20)
    texts = [(None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (7, text(4)), (8, text(4)), (9, None), (10, ""), (11, "12 34"), (7, text(5) + " " + item), (12, text(6, 20_000)), (None, text(1))]
    texts += [(100 + k, text(100 + k)) for k in range(30)]
    docs = _tables(spark, tmp_path, [(i, t, "en", "s1" if k % 2 else None, 1) for k, (i, t) in enumerate(texts)], [(1, item), (2, None), (None, "x")])
    left = docs
    for _, stage in P.STAGES[:3]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns
    want = {t for _, t in texts if t and any(c.isalpha() for c in t) and item not in t}
    got = [r.text for r in left.collect()]
    assert sorted(got) == sorted(want)
    out = P.run(spark, str(tmp_path)).collect()
    assert {r.text for r in out} <= want and len({(r.shard, r.slot) for r in out}) == len(out) > 0


def test_run_without_rows(spark, tmp_path):
    _tables(spark, tmp_path, [], [])
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stages_with_extra_columns(spark, tmp_path):
    rows = [(k, " ".join(f"word{k} tree{j}" for j in range(40)), "en", "s", 5, "x", k) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, mark string, p int").withColumnRenamed("p", "root")
    docs = docs.withColumn("id", F.lit(1)).withColumn("_kept", F.lit(2))
    spark.createDataFrame([(1, "no such words are in here at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in P.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "mark", "root", "id", "_kept"]
    assert docs.count() > 0


def test_language_stage_rejects_unlearned_scripts(spark):
    rows = [(k, "the house and the tree stand by the river " * 3, "en") for k in range(40)]
    rows += [(50, "\u0434\u043e\u043c \u0438 \u043b\u0435\u0441 " * 12, None), (51, "a tree", None), (52, "\u4e2d" * 10, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id for r in P.language_id(spark, docs, SMALL).collect()}
    assert got == {r[0] for r in rows} - {50}


def test_near_dedup_with_null_and_repeated_ids(spark):
    def text(k):
        return " ".join(f"w{k}x{j}" for j in range(60))

    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (7, text(3)), (7, text(4)), (7, text(4)), (3, text(5)), (9, text(5) + " more"), (9, text(6)), (None, text(7)), (8, text(7))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = P.near_dedup(spark, docs, SMALL)
    assert out.columns == docs.columns
    want = [(None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (3, text(5)), (9, text(6)), (None, text(7))]
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, want))
