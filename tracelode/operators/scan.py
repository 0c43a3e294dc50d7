"""Stated queries against all pages in one streaming pass.

The query side is counted first and goes to every task in blocks of bounded
bytes; pages stay where the scan put them, are tokenised once a pass, and each
task keeps only its best rows of a query (or the hits themselves), so nothing of
the size pages x terms x queries is ever shuffled. A last ranking in Spark
merges the tasks' lists.

Pages are (source_id, page_number, text); a null text is an empty one.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import CJK, LATIN, WHITE

PAGE = ["source_id", "page_number"]
#: Bytes of query text that are broadcast at once, and of terms that one automaton holds; more are taken in blocks, one pass for each.
QUERY_BYTES = 8 << 20
AUTOMATON_BYTES = 1 << 20
#: Pages whose scores are held at once in a task.
CHUNK = 2048
K1, B = 1.5, 0.75

_LATIN, _CJK, _WHITE = re.compile(LATIN), re.compile(CJK), re.compile(WHITE)


def tokens_of(text: str | None, nfkc: bool = True) -> list[str]:
    """The tokens of ``functions.text.tokenize_mixed``, for texts that are in Python already."""
    if not text:
        return []
    if nfkc and not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    out = _LATIN.findall(text)
    for run in _CJK.findall(text):
        out += run
        out += [run[k : k + 2] for k in range(len(run) - 1)]
    return out


def compact(text: str | None) -> str:
    """NFKC, lower case, no white space: ``functions.text.compact_text``."""
    text = text or ""
    return _WHITE.sub("", (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


def blocks(queries: DataFrame, text: str = "text", bound: int = QUERY_BYTES) -> Iterator[list[tuple]]:
    """The queries (item_id, text) in blocks of about ``bound`` bytes at most, dealt by a hash where there is more than one."""
    size = queries.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = 1 if size <= bound else -(-2 * size // bound)  # at half load, so that an uneven deal stays in the bound
    for k in range(n):
        part = queries if n == 1 else queries.where(F.pmod(F.xxhash64("item_id", text), F.lit(n)) == k)
        yield [(r["item_id"], r[text]) for r in part.select("item_id", text).collect()]


def _key(source, page) -> tuple:
    """Spark's ascending order of (source_id, page_number), nulls first."""
    return source is not None, source or "", page is not None, page or 0


def _chunks(batches: Iterable[pa.RecordBatch], vocabulary: dict[str, int]) -> Iterator[tuple[list[tuple], np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]]:
    """(keys, lengths, term -> (pages, counts)) of each run of pages, the terms cut down to the vocabulary."""
    for batch in batches:
        sources, pages, texts = (batch.column(c) for c in (*PAGE, "text"))
        for a in range(0, batch.num_rows, CHUNK):
            part = texts.slice(a, CHUNK).to_pylist()
            keys = list(zip(sources.slice(a, CHUNK).to_pylist(), pages.slice(a, CHUNK).to_pylist(), strict=True))
            lengths, rows, terms = np.zeros(len(part)), [], []
            for k, text in enumerate(part):
                found = tokens_of(text)
                lengths[k] = len(found)
                own = [vocabulary[t] for t in found if t in vocabulary]
                rows += [k] * len(own)
                terms += own
            pairs, counts = np.unique(np.array(terms, np.int64) << 32 | np.array(rows, np.int64), return_counts=True)
            term, row = pairs >> 32, pairs & 0xFFFFFFFF
            cuts = np.r_[0, np.flatnonzero(np.diff(term)) + 1, len(term)] if len(term) else np.zeros(1, np.int64)
            yield keys, lengths, {int(term[x]): (row[x:y], counts[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)}


class Plan:
    """A block of queries as sequences of term numbers, and how a page's terms count."""

    def __init__(self, rows: list[tuple], distinct: bool):
        texts = [(item, tokens_of(text)) for item, text in rows]
        self.items = [item for item, _ in texts]
        self.vocabulary = {t: k for k, t in enumerate(sorted({t for _, ts in texts for t in ts}))}
        self.terms = [[self.vocabulary[t] for t in (dict.fromkeys(ts) if distinct else ts)] for _, ts in texts]
        self.distinct = distinct
        self.idf: np.ndarray | None = None
        self.avg_len = 1.0

    def fit(self, pages: DataFrame) -> Plan:
        """Document frequencies of the block's terms and the mean length, counted in one pass over all pages."""
        vocabulary = self.vocabulary

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df, n, total = np.zeros(len(vocabulary), np.int64), 0, 0
            for keys, lengths, columns in _chunks(batches, vocabulary):
                n += len(keys)
                total += int(lengths.sum())
                for t, (rows, _) in columns.items():
                    df[t] += len(rows)
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, some]), pa.array(np.r_[n, total, df[some]])], names=["term", "n"])

        found = pages.select(*PAGE, "text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        counts = {r["term"]: r["n"] for r in found}
        n, total = counts.get(-2, 0), counts.get(-1, 0)
        self.avg_len = total / n if n else 1.0
        df = [counts.get(t, 0) for t in range(len(vocabulary))]
        self.idf = np.array([math.log(1.0 + (n - d + 0.5) / (d + 0.5)) for d in df])
        return self

    def scores(self, lengths: np.ndarray, columns: dict[int, tuple[np.ndarray, np.ndarray]], k1: float, b: float) -> Iterator[tuple[int, np.ndarray]]:
        """(query number, scores of the run's pages); sums are left folds in query order."""
        if self.idf is None:
            weights = {t: (rows, np.ones(len(rows))) for t, (rows, _) in columns.items()}
        else:
            weights = {
                t: (rows, self.idf[t] * ((tf * (k1 + 1)) / (tf + k1 * ((1 - b) + b * lengths[rows] / self.avg_len)))) for t, (rows, tf) in columns.items()
            }
        for q, terms in enumerate(self.terms):
            score = np.zeros(len(lengths))
            for t in terms:
                if t in weights:
                    rows, w = weights[t]
                    score[rows] += w
            yield q, score / max(1, len(terms)) if self.distinct else score


class Best:
    """The best ``top_k`` (score, key) of each query so far."""

    def __init__(self, top_k: int, zeros: bool):
        self.top_k, self.zeros = top_k, zeros
        self.held: dict[int, list[tuple]] = {}

    def add(self, q: int, score: np.ndarray, keys: list[tuple]) -> None:
        held = self.held.setdefault(q, [])
        least = held[-1][0] if len(held) == self.top_k else None
        worth = np.flatnonzero(score > 0 if not self.zeros else score >= 0)
        if least is not None:
            worth = worth[score[worth] >= -least]
        if len(worth) > self.top_k:
            bar = np.partition(score[worth], len(worth) - self.top_k)[len(worth) - self.top_k]
            worth = worth[score[worth] >= bar]
        if len(worth):
            held += [(-float(score[k]), _key(*keys[k]), keys[k]) for k in worth.tolist()]
            held.sort(key=lambda x: x[:2])
            del held[self.top_k :]


HITS = "item_id long, source_id string, page_number long, score double"


def best_pages(
    pages: DataFrame, queries: DataFrame, top_k: int, shares: bool = False, with_zeros: bool = False, k1: float = K1, b: float = B, bound: int = QUERY_BYTES
) -> DataFrame:
    """(item_id, source_id, page_number, score, rank): the best pages of each query by (-score, source_id, page_number).

    Scores are BM25, or with ``shares`` the share of a query's distinct tokens
    that the page has. Pages that score nothing are no hits unless
    ``with_zeros``. Queries without tokens score nothing anywhere. Scores of a
    query are sums in its own token order, so equal pages tie to the bit.
    """
    out = None
    for rows in blocks(queries, bound=bound):
        plan = Plan(rows, shares)
        if not shares:
            plan.fit(pages)
        sent = pages.sparkSession.sparkContext.broadcast(plan)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            plan, best = sent.value, Best(top_k, with_zeros)
            for keys, lengths, columns in _chunks(batches, plan.vocabulary):
                for q, score in plan.scores(lengths, columns, k1, b):
                    best.add(q, score, keys)
            found = [(plan.items[q], *key, -s) for q, held in best.held.items() for s, _, key in held]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.float64()), strict=True)], names=["item_id", *PAGE, "score"])

        part = pages.select(*PAGE, "text").mapInArrow(search, HITS)
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), *PAGE)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def ties(pages: DataFrame, queries: DataFrame, near: float = 1e-12, shares: bool = True, bound: int = QUERY_BYTES) -> DataFrame:
    """(item_id, top_score, n_exact, n_near) over all pages: how many score as much as the best one, and within ``near`` of it.

    Two passes: the best score of each query, then the counts, which each task
    makes by itself. Pages that score nothing count too.
    """
    out = None
    for rows in blocks(queries, bound=bound):
        plan = Plan(rows, shares)
        if not shares:
            plan.fit(pages)
        sent = pages.sparkSession.sparkContext.broadcast(plan)

        def tops(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            plan = sent.value
            top = np.full(len(plan.items), -1.0)
            for _, lengths, columns in _chunks(batches, plan.vocabulary):
                for q, score in plan.scores(lengths, columns, K1, B):
                    top[q] = max(top[q], score.max(initial=-1.0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(top))), pa.array(top)], names=["q", "top"])

        best = {r["q"]: r["top"] for r in pages.select(*PAGE, "text").mapInArrow(tops, "q long, top double").groupBy("q").agg(F.max("top").alias("top")).where("top >= 0").collect()}

        def count(batches: Iterator[pa.RecordBatch], sent=sent, best=best) -> Iterator[pa.RecordBatch]:
            plan = sent.value
            exact, close = np.zeros(len(plan.items), np.int64), np.zeros(len(plan.items), np.int64)
            for _, lengths, columns in _chunks(batches, plan.vocabulary):
                for q, score in plan.scores(lengths, columns, K1, B):
                    exact[q] += int((score == best[q]).sum())
                    close[q] += int((best[q] - score <= near).sum())
            some = np.flatnonzero(close)
            columns = [pa.array([plan.items[q] for q in some], pa.int64()), pa.array([best[q] for q in some], pa.float64()), pa.array(exact[some]), pa.array(close[some])]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "top_score", "n_exact", "n_near"])

        part = pages.select(*PAGE, "text").mapInArrow(count, "item_id long, top_score double, n_exact long, n_near long")
        part = part.groupBy("item_id", "top_score").agg(F.sum("n_exact").alias("n_exact"), F.sum("n_near").alias("n_near"))
        out = part if out is None else out.unionByName(part)
    return out


_AUTOMATA: dict[str, tuple] = {}


def _automaton(sent):
    """The automaton of a broadcast block of terms, built once in a worker."""
    import ahocorasick

    if sent.value[0] not in _AUTOMATA:
        _AUTOMATA.clear()
        found: dict[str, list] = {}
        for item, term in sent.value[1]:
            found.setdefault(term, []).append(item)
        machine = ahocorasick.Automaton()
        for term, items in found.items():
            if term:
                machine.add_word(term, items)
        if len(machine):
            machine.make_automaton()
        _AUTOMATA[sent.value[0]] = machine, found.get("", [])
    return _AUTOMATA[sent.value[0]]


def containing(pages: DataFrame, queries: DataFrame, fold: Callable[[str | None], str | None] | None = None, any_page: bool = False, bound: int = AUTOMATON_BYTES) -> DataFrame:
    """(item_id, source_id, page_number) of the pages that hold a query's whole text; with ``any_page`` only the item_ids that some page holds.

    A page is read once past an automaton of all terms, whatever their number.
    ``fold`` is applied to both sides. Null texts hold nothing and null queries
    are held nowhere; an empty query is held by every page that has a text.
    """
    fold = fold or (lambda t: t)
    out = None
    for rows in blocks(queries, bound=bound):
        terms = [(item, fold(text)) for item, text in rows if text is not None]
        sent = pages.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, terms))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            machine, everywhere = _automaton(sent)
            seen: set = set()
            for batch in batches:
                rows: list[tuple] = []
                for source, page, text in zip(*(batch.column(c).to_pylist() for c in (*PAGE, "text")), strict=True):
                    if text is None:
                        continue
                    items = set(everywhere)
                    if len(machine):
                        for _, found in machine.iter(fold(text)):
                            items.update(found)
                    rows += [(i, source, page) for i in items if not any_page or i not in seen]
                    if any_page:
                        seen |= items
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["item_id", *PAGE])

        part = pages.select(*PAGE, "text").mapInArrow(search, "item_id long, source_id string, page_number long")
        out = part if out is None else out.unionByName(part)
    return out.select("item_id").distinct() if any_page else out
