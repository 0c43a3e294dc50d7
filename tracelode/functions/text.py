"""Text functions: normalisation, mixed Latin/CJK tokens, digests, snippets, JSON objects in answers."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode white space, spelled out because Java's classes differ from it.
WHITE = "[\\t\\n\\x0b\\x0c\\r\\x1c-\\x20\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
#: Token patterns.
LATIN = "[a-z0-9]+(?:[._/+\\-][a-z0-9]+)*"
CJK = "[\\u4e00-\\u9fff]+"
_WHITE_RE = re.compile(WHITE)


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def collapse(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def normalize_text(text: Column, nfkc: bool = True) -> Column:
    """NFKC, then ``collapse``. Without ``nfkc`` everything stays in the JVM; use that for text known to be NFKC."""
    return collapse(_nfkc(text) if nfkc else text)


def compact_text(text: Column, nfkc: bool = True) -> Column:
    """NFKC, lower case, no white space at all."""
    return F.regexp_replace(F.lower(_nfkc(text) if nfkc else text), WHITE, "")


def tokenize_mixed(text: Column, nfkc: bool = True) -> Column:
    """Latin tokens in order, then for each CJK run its characters and its bigrams. Null gives no tokens."""
    norm = F.lower(normalize_text(F.coalesce(text, F.lit("")), nfkc))

    def grams(run: Column) -> Column:
        n = F.length(run)
        chars = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, F.lit(1)))
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.concat(chars, pairs)

    latin = F.regexp_extract_all(norm, F.lit(LATIN), F.lit(0))
    return F.concat(latin, F.flatten(F.transform(F.regexp_extract_all(norm, F.lit(CJK), F.lit(0)), grams)))


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def page_columns(text: Column, nfkc: bool = True) -> dict[str, Column]:
    """The derived columns of a page: normalised text, its digest, and its length in code points."""
    norm = normalize_text(text, nfkc)
    return {"text": norm, "text_sha256": sha256_text(norm), "char_count": F.length(norm).cast("long")}


def snippet(text: Column, query: str, context: int = 40) -> Column:
    """The first place of the query (any case) with ``context`` characters on both sides; null where it is not."""
    at = F.locate(query.lower(), F.lower(text))
    start = F.greatest(at - context, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + len(query) + context))


def json_object(text: Column) -> Column:
    """From the first opening to the last closing brace, without a code fence around it; null where there is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), "^```(?:json)?\\s*", ""), "\\s*```$", "")
    first, last = F.locate("{", bare), F.length(bare) - F.locate("}", F.reverse(bare)) + 1
    found = (first > 0) & (F.locate("}", bare) > 0) & (last >= first)
    return F.when(found, F.substring(bare, first, last - first + 1))


def parse_strict(text: Column, schema: str, keys: list[str]) -> Column:
    """The JSON object in an answer as a struct; null where it does not parse or its top keys are not exactly ``keys``."""
    raw = json_object(text)
    same = F.array_sort(F.json_object_keys(raw)) == F.array(*[F.lit(k) for k in sorted(keys)])
    return F.when(same, F.from_json(raw, schema))


def _folded(text: str | None) -> str:
    text = text or ""
    return _WHITE_RE.sub("", (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _covered(answers: pd.Series, groups: pd.Series) -> pd.Series:
    """Which groups have an alias in the answer; a function in Python, because both sides are folded to NFKC."""
    out = []
    for answer, own in zip(answers, groups, strict=True):
        text = _folded(answer)
        out.append(None if answer is None or own is None else [any(a is not None and _folded(a) in text for a in group) for group in own])
    return pd.Series(out, dtype=object)


def fact_group_covered(answer: Column, aliases: Column) -> Column:
    """Is any alias in the answer, both compacted? Null for a null answer."""
    return _covered(answer, F.array(aliases))[0]


def required_fact_coverage(answer: Column, groups: Column) -> Column:
    """The fraction of groups with an alias in the answer; 1 without groups, null for a null answer."""
    hit = F.size(F.filter(_covered(answer, groups), lambda g: g))
    return F.when(F.size(groups) == 0, F.lit(1.0)).otherwise(hit / F.size(groups))


def stored_path(path: Column, root: str) -> Column:
    """Relative to the root where it is below it."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)
