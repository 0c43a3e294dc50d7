import random

from conftest import SMALL
from parity import connect, same

from tracelode.llm import common, decontam, graph, neardup


def test_query7_against_sql(spark):
    same(neardup.op7_minhash_near_dedup(spark, SMALL), connect(SMALL), neardup.OP7_SQL)


def _sets(text, n):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    m = min(n, len(words))
    return {tuple(words[k : k + m]) for k in range(len(words) - m + 1)} if words else set()


def _components(rows, n, percent=80):
    ids = [-(2**63) if d is None else d for d, _ in rows]
    sets, up = [_sets(t, n) for _, t in rows], list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[find(a)] = find(b)
    least = {}
    for k, d in enumerate(ids):
        least[find(k)] = min(least.get(find(k), d), d)
    return [(d, len(s), None if least[find(k)] == -(2**63) else least[find(k)], i == least[find(k)]) for k, ((d, _), s, i) in enumerate(zip(rows, sets, ids, strict=True))]


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(11)
    base = [f"w{r.randrange(400)}" for _ in range(120)]
    rows = [(None, "only here and null"), (900, None), (901, "  \n"), (902, "one"), (903, "ONE"), (904, "two words"), (904, "two words")]
    for k in range(160):
        words = list(base)
        for _ in range(r.randrange(14)):
            words[r.randrange(len(words))] = f"x{r.randrange(5000)}"
        rows.append((k, " ".join(words[r.randrange(8) :])))
    rows += [(1000 + k, " ".join(f"y{r.randrange(50)}" for _ in range(30))) for k in range(30)] + [(2000 + k, " ".join(base)) for k in range(40)]
    df = spark.createDataFrame([(*x, "e") for x in rows], "doc_id long, text string, node string")
    for n in (2, 5):
        got = [tuple(x) for x in neardup.near_duplicates(spark, df, n).collect()]
        assert sorted(map(str, got)) == sorted(map(str, _components(rows, n)))
    assert neardup.near_duplicates(spark, df.where("false")).count() == 0


def test_blocks_find_links_that_hubs_miss(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    r = random.Random(4)
    chain, rows = [f"c{k}" for k in range(100)], []
    for k in range(40):  # each is like the one before and unlike most
        for _ in range(6):
            chain[r.randrange(100)] = f"n{r.randrange(10**6)}"
        rows.append((k, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(x) for x in neardup.near_duplicates(spark, df, 1).collect()]
    assert sorted(map(str, got)) == sorted(map(str, _components(rows, 1)))


def test_large_hubs_by_rare_items(spark, monkeypatch):
    """Many texts with one long passage in common: one hub whose nodes are linked in pairs and small groups only."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    r = random.Random(8)
    common_part = [f"c{k}" for k in range(60)]
    rows = []
    for k in range(90):
        own = [f"o{k}_{j}" for j in range(22)]
        for copy in range(r.choice([1, 1, 2, 3])):
            words = common_part + [w if r.random() > 0.06 * copy else f"n{r.randrange(10**6)}" for w in own]
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(x) for x in neardup.near_duplicates(spark, df, 1).collect()]
    want = _components(rows, 1)
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({x[2] for x in want}) > 40


def test_recall_at_the_bound():
    """Pairs of similarity 0.80 to 0.82: nearly all have signatures within the distance (README gives the figure)."""
    import numpy as np

    r = np.random.default_rng(5)
    seen = found = 0
    for _ in range(1500):
        n = int(r.integers(100, 400))
        both = int(np.ceil(0.8 / 1.8 * 2 * n))
        items = r.integers(0, 2**63, 2 * n - both, dtype=np.int64).view(np.uint64)
        a, b = items[:n], items[n - both :]
        assert 0.8 <= both / (2 * n - both) < 0.82
        seen += 1
        found += int((neardup.signature(np.sort(a)) != neardup.signature(np.sort(b))).sum()) <= neardup.DISTANCE
    print("recall at the bound", found / seen)
    assert found / seen >= 0.998


def test_very_long_near_copies(spark):
    r = random.Random(3)
    long = [f"w{r.randrange(10**6)}" for _ in range(40_000)]
    near = list(long)
    for k in range(0, 40_000, 50):
        near[k] = "q"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(reversed(long))), (4, " ".join(long[:20_000]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(spark, df, 2).collect()}
    want = {d: (n, c) for d, n, c, _ in _components(rows, 2)}
    assert got == want and got[2][1] == 1 and got[3][1] == 3


def test_signature_keys_are_complete():
    import numpy as np

    r = random.Random(1)
    for _ in range(50):  # 25 differences leave a chunk with one at most
        spots = set(r.sample(range(neardup.SYMBOLS), neardup.DISTANCE))
        cuts = neardup._CUTS
        assert min(sum(k in spots for k in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)) <= 1
    assert (neardup.signature(np.arange(5, dtype=np.uint64)) == neardup.signature(np.arange(5, dtype=np.uint64))).all()


def test_components(spark):
    scratch = common.Scratch(spark)
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 150)] + [(5, 5)]
    got = {x.node: x.root for x in graph.components(scratch, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {k: 100 for k in range(101, 150)}
    assert graph.components(scratch, spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark):
    r = random.Random(9)
    items = [(k, " ".join(f"b{r.randrange(60)}" for _ in range(30))) for k in range(8)] + [(50, "too few words"), (51, None), (52, "")]
    far = items[1][1].split()
    far[4], far[11], far[20] = "q", "q", "q"
    rows = [
        (1, "before " + items[0][1].upper().replace(" ", ", ") + " after"), (2, "x " + " ".join(far) + " y"), (3, " ".join(items[2][1].split()[5:20])), (4, " ".join(items[3][1].split()[:9])),
        (5, " ".join(f"b{r.randrange(60)}" for _ in range(2000))), (6, None), (7, ""), (None, items[4][1]), (1, "clean"), (8, items[5][1] + " gap " + items[5][1]),
    ]
    docs, bench = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 0), (2, 1), (3, 2), (None, 4), (8, 5)}
    for block_bytes in (1_000_000, 60):
        got = decontam.contaminated(spark, docs, bench, block_bytes=block_bytes).collect()
        assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want)
    assert next(x for x in got if x.doc_id == 8).n_overlaps == 2 and next(x for x in got if x.doc_id == 2).n_equal == 27
    for block_bytes in (10**6, 60):
        assert sorted(x.doc_id for x in decontam.clean(spark, docs, bench, block_bytes=block_bytes).collect()) == [1, 4, 5, 6, 7]
    assert decontam.contaminated(spark, docs, bench.where("false")).count() == 0 == decontam.contaminated(spark, docs.where("false"), bench).count()


def test_longest_run_against_brute_force():
    import numpy as np

    r = random.Random(2)
    for _ in range(300):
        x = np.array([r.random() < 0.7 for _ in range(r.randrange(1, 25))])
        best = max((b - a for a in range(len(x) + 1) for b in range(a, len(x) + 1) if b == a or 100 * x[a:b].sum() >= 80 * (b - a)), default=0)
        a, b = decontam.longest_run(x)
        assert b - a == best and (b == a or 100 * x[a:b].sum() >= 80 * (b - a))


def _plain_overlaps(rows, items, min_words=13, percent=80, least=5):
    """(doc_id, item_id) by laying every item over every text at every offset, without seeds."""

    def words(t):
        low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        return "".join(" " if c.isascii() and not c.isalnum() else c for c in low).split(" ")

    out = set()
    for item_id, item in items:
        b = [w for w in words(item) if w]
        if len(b) < least:
            continue
        need = min(min_words, len(b))
        for doc_id, text in rows:
            a = [w for w in words(text) if w]
            for shift in range(-len(b) + 1, len(a)):
                same = [b[k] == a[k + shift] for k in range(max(0, -shift), min(len(b), len(a) - shift))]
                if sum(same) * 2 < need:
                    continue
                sums = [0]
                for x in same:
                    sums.append(sums[-1] + (100 - percent if x else -percent))
                if any(sums[e] >= sums[f] for f in range(len(sums)) for e in range(f + need, len(sums))):
                    out.add((doc_id, item_id))
    return out


def test_decontamination_against_brute_force(spark):
    r = random.Random(21)
    items = [(k, " ".join(f"b{r.randrange(90)}" for _ in range(r.randrange(4, 40)))) for k in range(25)]
    rows = []
    for k in range(120):
        text = [f"b{r.randrange(90)}" for _ in range(r.randrange(60))]
        if k % 2:
            own = r.choice(items)[1].split()
            a = r.randrange(len(own))
            piece = own[a : a + r.randrange(1, 40)]
            for _ in range(r.randrange(5)):
                piece[r.randrange(len(piece))] = "q"
            text[10:10] = piece
        rows.append((k, r.choice([" ", ", ", " - "]).join(text)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = _plain_overlaps(rows, items)
    for block_bytes in (10**6, 100):
        got = {(x.doc_id, x.item_id) for x in decontam.contaminated(spark, docs, bench, block_bytes=block_bytes).collect()}
        assert got == want and len(want) > 10


def test_query8_against_brute_force(spark):
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if len(x.text.split()) < 400]
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()][:12]
    got = {(x.doc_id, x.item_id) for x in decontam.op8_decontamination(spark, SMALL).collect()}
    known, ids = {d for d, _ in docs}, {i for i, _ in items}
    assert {(d, i) for d, i in got if d in known and i in ids} == _plain_overlaps(docs, items)


def test_query8_against_containment(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").toPandas()
    want = {(d.doc_id, i.item_id) for d in docs.itertuples() for i in items.itertuples() if i.text in d.text}
    assert want <= {(x.doc_id, x.item_id) for x in decontam.op8_decontamination(spark, SMALL).collect()}
