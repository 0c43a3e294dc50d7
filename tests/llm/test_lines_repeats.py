import hashlib
import random

from conftest import SMALL
from parity import connect, same

from tracelode.llm import lines, repeats


def test_query5_against_sql(spark):
    same(lines.op5_line_dedup(spark, SMALL), connect(SMALL), lines.OP5_SQL)


def _lines(rows, min_chars=40, min_docs=5):
    where = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            where.setdefault(key, set()).add(-(2**63) if doc is None else doc)
    out = []
    for doc, text in rows:
        d = -(2**63) if doc is None else doc
        kept = []
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            if len(key) < min_chars or len(where[key]) < min_docs or d == max(where[key]):
                kept.append(line)
        n = (text or "").count("\n") + 1
        out.append((doc, n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_lines_against_brute_force(spark):
    r = random.Random(5)
    hot, pool = "A line that is in very many of the documents here", [f"shared line number {k} which is long enough, É" * 1 for k in range(12)]
    rows = []
    for k in range(240):
        text = [r.choice([hot, f" {hot.upper()}\t", r.choice(pool), f"own line of document {k} that no other one has", "short"]) for _ in range(r.randrange(6))]
        rows.append((k if k % 50 else None, "\n".join(text)))
    rows += [(3, None), (4, ""), (5, hot), (5, hot), (999, "\n".join([hot] * 500)), (998, "\n".join(f"line of a very long text, which is number {j % 700}" for j in range(20_000)))]
    rows += [(700 + k, "line of a very long text, which is number 5") for k in range(5)]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "doc_id long, text string, drops string")
    got = lines.dedup_lines(spark, df)
    assert sorted(map(str, (tuple(x) for x in got.drop("keep_bitmap").collect()))) == sorted(map(str, _lines(rows)))
    big = next(x for x in got.collect() if x.doc_id == 999)
    assert lines.apply_bitmap("\n".join([hot] * 500), big.keep_bitmap) == "\n".join([hot] * 500)
    assert lines.dedup_lines(spark, df.where("false")).count() == 0


def _repeats(texts, n):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for raw in raws:
        for k in range(len(raw) - n + 1):
            seen[raw[k : k + n]] = seen.get(raw[k : k + n], 0) + 1
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - n + 1):
            if seen[raw[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        spans = sum(1 for k in range(len(raw)) if gone[k] and (not k or not gone[k - 1]))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return out


def test_repeats_against_brute_force(spark):
    r = random.Random(7)
    passage = "".join(r.choice("abcé ") for _ in range(90))
    texts = [None, "", "a" * 100, "ab" * 60, "short", "abc" * 3, passage]
    for _ in range(60):
        own = "".join(r.choice("abcdefgh ") for _ in range(r.randrange(80)))
        a = r.randrange(60)
        texts.append(own[:20] + passage[a : a + r.randrange(60)] + own[20:])
    texts += [texts[20]] * 30
    for n in (4, 8, 20):
        df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, first int")
        got = [tuple(x)[1:] for x in repeats.repeated_bytes(spark, df, n).drop("removed").orderBy("doc_id").collect()]
        assert got == _repeats(texts, n)
    assert repeats.repeated_bytes(spark, df.where("false")).count() == 0


def test_repeats_in_very_long_texts(spark):
    """Texts of more than one piece, with passages over the seams and exact copies."""
    r = random.Random(11)
    long = "".join(r.choice("abcdefgh é") for _ in range(300_000))
    seam = repeats.PIECE
    texts = [long, long[seam - 700 : seam + 500], "x" * 50 + long[2 * seam - 100 : 2 * seam + 99] + "y" * 400, long[10:210] + "z" * 150, long[::-1], long[::-1], "z" * 149 + "q"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = repeats.repeated_bytes(spark, df, 200).orderBy("doc_id").collect()
    assert [tuple(x)[1:5] for x in got] == _repeats(texts, 200)
    for x, text in zip(got, texts, strict=True):
        raw = text.encode()
        rest = b"".join(raw[a:b] for a, b in zip([0, *[e for _, e in x.removed]], [*[s for s, _ in x.removed], len(raw)], strict=True))
        assert hashlib.sha256(rest).hexdigest() == x.kept_sha256


def test_query10(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").select("text").toPandas()["text"].tolist()
    got = [tuple(x)[1:] for x in repeats.op10_repeated_bytes(spark, SMALL).orderBy("doc_id").collect()]
    assert got == _repeats(docs, 200)
