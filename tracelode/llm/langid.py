"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A
letter n-gram is bound from its letters' vectors, each rotated by its place and
multiplied element by element. A document's vector is the bundle (sum) of the
vectors of all its n-grams; a language's prototype is the bundle of its
training documents' unit vectors. A document gets the language whose prototype
has the largest cosine with it.

A run of characters that are no letters counts as one gap letter, so n-grams
see word ends. A whole text is used, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

DIM = 1024
NGRAM = 3
#: Training documents of a language, about; the classifier is fitted on such a sample.
TRAIN_DOCS = 5000
#: Languages whose prototypes are held against a text at once (4 KB each); more are taken in blocks.
LANGUAGE_BLOCK = 8192
UNKNOWN = "und"
GAP = 32
#: Documents, and code points, whose n-grams are counted together.
BATCH_DOCS = 64
BATCH_CHARS = 1 << 18
#: n-gram vectors made at once.
BATCH_GRAMS = 2048
#: Unit vectors are added as whole numbers of this fraction, so that sums do not depend on their order.
GRAIN = 1 << 20


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def letter_vectors(code_points: np.ndarray, dim: int) -> np.ndarray:
    """+1 and -1 for each code point: the bits of a mixed counter (the public splitmix64 finaliser)."""
    words = np.arange(dim // 64, dtype=np.uint64)
    x = (code_points.astype(np.uint64)[:, None] << np.uint64(24) | words) + np.uint64(1)
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.view(np.uint8), axis=1)
    return (bits.astype(np.int8) << 1) - 1


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters as code points, runs of others as one gap, a gap at both ends; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    mask = _is_letter()[points]
    if not mask.any():
        return np.zeros(0, np.uint32)
    out = np.where(mask, points, GAP)
    keep = mask.copy()
    keep[1:] |= mask[:-1]
    out = out[keep]
    lead, tail = [GAP] if out[0] != GAP else [], [GAP] if out[-1] != GAP else []
    return np.concatenate([np.array(lead, np.uint32), out, np.array(tail, np.uint32)])


def document_vectors(texts: list[str], dim: int = DIM) -> np.ndarray:
    """The unit vectors of texts; a zero row where a text has no letters."""
    parts = [letters_of(t) for t in texts]
    out = np.zeros((len(texts), dim), np.float32)
    sizes = np.array([len(p) for p in parts])
    if not sizes.sum():
        return out
    flat = np.concatenate(parts)
    alphabet, ids = np.unique(flat, return_inverse=True)
    ids, n = ids.astype(np.int64), len(alphabet)
    owner = np.repeat(np.arange(len(parts)), sizes)
    codes = ids[: len(ids) - NGRAM + 1].copy()
    for k in range(1, NGRAM):
        codes = codes * n + ids[k : len(ids) - NGRAM + 1 + k]
    inside = owner[: len(codes)] == owner[NGRAM - 1 :]
    found, counts = np.unique(owner[: len(codes)][inside] * n**NGRAM + codes[inside], return_counts=True)
    doc, gram = np.divmod(found, n**NGRAM)
    grams, column = np.unique(gram, return_inverse=True)
    order = np.argsort(column, kind="stable")
    doc, column, counts = doc[order], column[order], counts[order]
    base = letter_vectors(alphabet, dim)
    turned = [np.roll(base, NGRAM - 1 - k, axis=1) for k in range(NGRAM)]
    for a in range(0, len(grams), BATCH_GRAMS):
        part, vectors = grams[a : a + BATCH_GRAMS], None
        for k in range(NGRAM):
            rows = turned[k][part // n ** (NGRAM - 1 - k) % n]
            vectors = rows if vectors is None else vectors * rows
        lo, hi = np.searchsorted(column, [a, a + BATCH_GRAMS])
        weight = np.zeros((len(texts), len(part)), np.float32)
        weight[doc[lo:hi], column[lo:hi] - a] = counts[lo:hi]
        out += weight @ vectors.astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def _batches(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(place, texts) of runs of texts, null as empty; only one run is in Python at a time."""
    run: list[str] = []
    start, size = 0, 0
    for k in range(len(texts)):
        t = texts[k].as_py() or ""
        if run and (len(run) >= BATCH_DOCS or size + len(t) > BATCH_CHARS):
            yield start, run
            run, start, size = [], k, 0
        run.append(t)
        size += len(t)
    if run:
        yield start, run


def _bundle(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, part in _batches(batch.column("text")):
                units = np.rint(document_vectors(part, dim).astype(np.float64) * GRAIN).astype(np.int64)
                for lang, unit in zip(langs[at:], units, strict=False):
                    sums[lang] = sums.get(lang, 0) + unit
        for lang, total in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * dim, pa.string()), "i": pa.array(range(dim), pa.int32()), "v": pa.array(total, pa.int64())})

    return run


def held_out(doc_id: Column) -> Column:
    """Is crc32 of the doc_id as text 2 modulo 4? A null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def train(labelled: DataFrame, dim: int = DIM, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """The languages in order and their unit prototypes, from rows of (doc_id, text, lang).

    Rows without a lang or text are left out. Of a language with more documents
    than ``train_docs``, about that many are used, picked by a hash of doc_id.
    Any number of languages is learned; what reaches the driver is one vector
    of 4 KB for each, in blocks of ``LANGUAGE_BLOCK``.
    """
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("train")), F.lit(1 << 20)) / float(1 << 20)
    # a row for each language, a hundredth of the model that goes to every task anyway: broadcast, so that no text is shuffled by language
    sample = rows.join(F.broadcast(sizes), "lang").where(unit * F.col("n") < train_docs).select("text", "lang")
    sums = sample.mapInArrow(_bundle(dim), "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    wide = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("vs")).select("lang", F.col("vs.v").alias("v"))
    langs, vectors = [], []
    for r in wide.orderBy("lang").toLocalIterator():
        v = np.array(r["v"], np.float64)
        norm = np.linalg.norm(v)
        langs.append(r["lang"])
        vectors.append((v / norm if norm > 0 else v).astype(np.float32))
    order = sorted(range(len(langs)), key=langs.__getitem__)
    return [langs[k] for k in order], np.array([vectors[k] for k in order], np.float32).reshape(len(langs), dim)


def predict(texts: Column, model: tuple[list[str], np.ndarray], block: int = LANGUAGE_BLOCK) -> Column:
    """A struct of lang_pred and score (the cosine, 0 at least) for each text.

    A text that is null or has no letters is ``und`` with score 0, as is every
    text where nothing was learned. Of equal cosines the first language in
    order counts. More than ``block`` languages are taken in blocks, and the
    best of all blocks counts.
    """
    langs, prototypes = model
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cosine", T.DoubleType())])

    def scored_by(names: list[str], vectors: np.ndarray):
        def scored(column: pa.Array) -> pa.Array:
            found, scores, raw = [UNKNOWN] * len(column), np.zeros(len(column)), np.full(len(column), -2.0)
            for at, part in _batches(column) if names else ():
                own = document_vectors(part, vectors.shape[1])
                cosine = np.round((own @ vectors.T).astype(np.float64), 6)
                best = cosine.argmax(axis=1)
                for k in np.flatnonzero(own.any(axis=1)):
                    found[at + k], raw[at + k] = names[best[k]], cosine[k, best[k]]
                    scores[at + k] = min(1.0, max(0.0, raw[at + k]))
            return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(scores), pa.array(raw)], names=["lang_pred", "score", "cosine"])

        return F.arrow_udf(scored, kind)

    out = None
    for a in range(0, max(1, len(langs)), block):
        one = scored_by(langs[a : a + block], prototypes[a : a + block])(texts)
        out = one if out is None else F.when(one["cosine"] > out["cosine"], one).otherwise(out)
    return F.struct(out["lang_pred"].alias("lang_pred"), out["score"].alias("score"))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score of every row; other columns are ignored."""
    return docs.select("doc_id", predict(F.col("text"), model).alias("p")).select("doc_id", "p.lang_pred", "p.score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn on the documents that are not held out, predict all."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), model).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score"
    )
