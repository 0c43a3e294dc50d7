import itertools
import random

import pytest
from conftest import CHECK, SMALL
from pyspark.sql import functions as F

from tracelode.llm import html, langid, license


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{CHECK}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in langid.op6_language_id(spark, CHECK).collect()]
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)


def test_languages_edges(spark):
    rows = [(k, "the house and the tree" if k % 2 else "das haus und der baum", "en" if k % 2 else "de", "x") for k in range(40)] + [(50, None, "en", "x"), (51, "text", None, "x"), (None, "the tree", "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.train(df)
    assert model[0] == ["de", "en"]
    texts = spark.createDataFrame([(1, "und das haus"), (2, "12 -- 3"), (3, None), (4, ""), (5, "the house " * 20000), (6, "的")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(texts, model).collect()}
    assert got[1].lang_pred == "de" and got[5].lang_pred == "en" and [got[k].lang_pred for k in (2, 3, 4)] == ["und"] * 3 and got[6].lang_pred in ("de", "en")
    assert {r.lang_pred for r in langid.identify(texts, langid.train(df.where("false"))).collect()} == {"und"}
    a, b = langid.train(df.repartition(5))[1], model[1]
    assert (a == b).all()


def _plain_vector(text, dim):
    """The bundle of all n-gram vectors, letter by letter: bits of the mixed counter, rotated by place and multiplied."""
    import numpy as np

    def letter(c):
        bits = []
        for w in range(dim // 64):
            x = ((c << 24 | w) + 1) * 0x9E3779B97F4A7C15 % 2**64
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
            x ^= x >> 31
            bits += [b >> (7 - k) & 1 for b in x.to_bytes(8, "little") for k in range(8)]
        return np.array([2 * b - 1 for b in bits])

    points, gap = [], True
    for ch in text.lower():
        if ch.isalpha():
            points += [32] * gap + [ord(ch)]
            gap = False
        else:
            gap = True
    total = np.zeros(dim)
    if not points:
        return total
    points.append(32)
    for k in range(len(points) - 2):
        total += np.roll(letter(points[k]), 2) * np.roll(letter(points[k + 1]), 1) * letter(points[k + 2])
    return total / np.linalg.norm(total)


def test_language_against_plain_vectors(spark):
    import numpy as np

    rows = [(1, "the house and the tree", "en"), (2, "a tree by the house", "en"), (3, "das haus und der baum", "de"), (4, "ein baum am haus", "de"), (5, "la casa y el \u00e1rbol", "es"), (6, "1 2", "fr"), (7, "", "it")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, prototypes = langid.train(df)
    want = {}
    for _, text, lang in rows:
        want[lang] = want.get(lang, 0) + _plain_vector(text, langid.DIM)
    assert langs == sorted(want)
    for k, lang in enumerate(langs):
        norm = np.linalg.norm(want[lang])
        assert np.allclose(prototypes[k], want[lang] / (norm or 1), atol=2e-3)
    texts = ["the tree", "haus", "una casa, \u00c1RBOL!", "x", "", None, "7"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (8192, 2):
        got = {r.doc_id: (r.p.lang_pred, r.p.score) for r in frame.select("doc_id", langid.predict(F.col("text"), (langs, prototypes), block).alias("p")).collect()}
        for k, text in enumerate(texts):
            own = _plain_vector(text or "", langid.DIM)
            if not own.any():
                assert got[k] == ("und", 0.0)
                continue
            cosine = np.round(prototypes @ own, 6)
            assert got[k][0] == langs[int(cosine.argmax())] and abs(got[k][1] - max(0.0, cosine.max())) < 2e-5


def test_more_languages_than_a_block(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(k, " ".join(letters[(k * 7 + j) % 26] * 2 + letters[(k // 26 + j) % 26] for j in range(6)), f"l{k:03d}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert len(model[0]) == 600
    got = df.limit(30).select("lang", langid.predict(F.col("text"), model, 100).alias("p")).collect()
    assert all(r.p.lang_pred == r.lang for r in got)


def test_batches_do_not_matter():
    texts = ["abc def", "", "ghi"] * 50
    a = langid.document_vectors(texts)
    assert abs(a[0] - langid.document_vectors(["abc def"])[0]).max() < 1e-6 and not a[1].any()


def test_license_lines(spark):
    rows = [
        (1, "Text.\nReleased under the MIT License."), (2, "Licensed under CC BY-NC 4.0.\n\nall RIGHTS reserved."), (3, "The license plate of the car was muddy."), (4, None), (5, ""),
        (None, "Licensed under the Apache License, Version 2.0."), (6, "x " * 50000 + "\nThis work is licensed under the GNU General Public License, version 3."), (7, "plain"),
        (8, "This project is licensed under the BSD license."), (8, "This project is licensed under the BSD license."),
    ]
    df = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, family string")
    got = license.scan_lines(spark, df).collect()
    found = sorted((str(r.doc_id), r.line, r.family) for r in got if r.confirmed)
    assert found == [("1", 1, "mit"), ("2", 0, "cc-by-nc"), ("2", 2, "reserved"), ("6", 1, "gpl"), ("8", 0, "bsd"), ("8", 0, "bsd"), ("None", 0, "apache")]
    assert not any(r.doc_id in (3, 7) for r in got)
    assert license.scan_lines(spark, df.where("false")).count() == 0


def _plain_scan(rows):
    """Every line of every row through the classifier and the templates, without gate, join or salt."""
    classes, weights, bias, bounds = license.model()
    out = []
    for doc, text in rows:
        for n, line in enumerate(text.split("\n") if text is not None else []):
            p = license._probabilities(weights, bias, line)
            family = license.decide(p, classes, bounds)
            if family == license.OTHER:
                continue
            grams = set(license._grams(line))
            sure = any(f == family and len(g & grams) >= license.CONFIRMED * len(g) for f, g in license._templates())
            out.append((doc, n, family, round(float(p[:-1].max()), 4), sure))
    return out


def test_license_against_plain_python(spark):
    docs = spark.read.parquet(f"{CHECK}/documents.parquet")
    got = [(r.doc_id, r.line, r.family, round(r.probability, 4), r.confirmed) for r in license.scan_lines(spark, docs).collect()]
    want = _plain_scan([(d.doc_id, d.text) for d in docs.collect()])
    assert sorted(got) == sorted(want) and want


def test_license_edge_lines(spark):
    notices = [t for ts in license.NOTICES.values() for t in ts] + [t for ts in license.CALIBRATION.values() for t in ts] + license.UNFAMILIAR + license.PROSE
    parts = [" ".join(t.split()[a:b]) for t in notices[:40] for a in range(len(t.split())) for b in range(a + 1, len(t.split()) + 1)]
    rows = [(1, None), (None, "Released under the MIT License."), (2, ""), (3, "\n".join(notices)), (3, "\n".join(notices)), (4, "word " * 30_000 + "MIT License"), (5, "\n".join(parts))]
    rows += [(k, "Licensed under CC BY 4.0.\nprose") for k in range(10, 200)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, raw int")
    got = sorted(((r.doc_id, r.line, r.family, r.confirmed), r.probability) for r in license.scan_lines(spark, df.na.fill(-1, ["doc_id"])).collect())
    want = sorted(((-1 if d is None else d, n, f, sure), p) for d, n, f, p, sure in _plain_scan(rows))
    assert [k for k, _ in got] == [k for k, _ in want] and all(abs(a - b) < 2e-4 for (_, a), (_, b) in zip(got, want, strict=True))
    assert license.scan_lines(spark, df.where("doc_id is null")).count() == 1
    assert license.scan_lines(spark, df.where("false")).count() == 0


#: Lines that are in no fit, no template and no calibration.
HELD_OUT_LINES = {
    "mit": ["Distributed under the MIT license terms.", "License: MIT", "free of charge, to any person obtaining a copy"],
    "apache": ["Provided under the Apache License 2.0.", "http://www.apache.org/licenses/LICENSE-2.0"],
    "gpl": ["Under the terms of the GNU General Public License version 2.", "GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "lgpl": ["This file is covered by the GNU Lesser General Public License."],
    "bsd": ["New BSD License", "Redistributions in binary form must reproduce the above copyright notice"],
    "mpl": ["under the Mozilla Public License, version 2.0"],
    "cc-by-sa": ["Content is licensed under CC BY-SA 3.0."],
    "cc-by-nc": ["Images are licensed under CC BY-NC 4.0."],
    "public-domain": ["The data are released into the public domain under CC0 1.0."],
    "reserved": ["Copyright 2021 the editors. All rights reserved."],
    "other": [
        "The driving license was in the car.", "Public rights of way cross the land.", "This is the source of the river.", "They reserved a room at the inn.", "Mit der Post kam ein Brief.", "The author wrote the code of honour.",
        "He made a copy of the key.", "The library is free to all.", "General terms apply to the sale.", "The version of the events that she told was new.",
    ],
}


def test_license_held_out_lines():
    classes, weights, bias, bounds = license.model()
    answers = [(f, license.decide(license._probabilities(weights, bias, t), classes, bounds)) for f, ts in HELD_OUT_LINES.items() for t in ts]
    named = [(f, got) for f, got in answers if got not in (license.OTHER, license.UNKNOWN)]
    known = [(f, got) for f, got in answers if f != license.OTHER]
    precision, recall = sum(f == got for f, got in named) / len(named), sum(f == got for f, got in known) / len(known)
    print("precision", precision, "recall", recall)
    assert precision >= 0.9 and recall >= 0.75
    assert all(got == license.OTHER for f, got in answers if f == license.OTHER)


def test_license_gate_loses_nothing():
    """A line without gate words has no weighted n-gram, so its score is that of an empty line."""
    _, weights, _, _ = license.model()
    gate = set(license.gate_words())
    assert all(gate & set(g.split()) for g in weights)


def test_license_notices():
    classes, weights, bias, bounds = license.model()
    assert all(license.decide(license._probabilities(weights, bias, t), classes, bounds) == f for f, ts in license.NOTICES.items() for t in ts)
    assert all(license.decide(license._probabilities(weights, bias, t), classes, bounds) == license.OTHER for t in license.COUNTEREXAMPLES + license.PROSE)


def test_license_query_has_all_documents(spark):
    assert license.op3_license_scan(spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_cut_against_brute_force():
    r = random.Random(3)
    for _ in range(200):
        n = r.randrange(1, 8)
        odds = [r.uniform(-2, 2) for _ in range(n)]
        edges = {(a, b): r.uniform(0, 1.5) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5}

        def cost(x, odds=odds, edges=edges):
            return sum(-o if o < 0 and s else o if o > 0 and not s else 0 for o, s in zip(odds, x, strict=True)) + sum(w for (a, b), w in edges.items() if x[a] != x[b])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(html.min_cut(odds, edges)) - best) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a}</style><script>var x="</p>";</script></head><body class="has-sidebar">
<header><a href=/>Site</a><p>Our slogan is here.</p></header><nav><ul><li><a href=/a>Home</a></li></ul></nav>
<div class="cookie-banner"><p>We use cookies on this site, as all do.</p></div>
<article><h1>Title &amp; more</h1><p>First para<b>graph</b> with <a href=/x>one link</a>,&nbsp;long enough to be read.<br>Next line.
<p>Second one, un&eacute;nclosed <i>and</i> fine.</p><div class="ad-slot"><p>Buy this thing now, it is cheap.</p></div><ul><li>point one of it</li><li>point two of it</li></ul><p>Last words of the article.</p></article>
<aside><p>Related reading that some would like to see.</p></aside><form><p>Leave your mail here, please do.</p><input name=q><button>Go</button></form>
<section id="comments"><div class="comment"><p>I am a reader and I say this is good.</p></div></section><footer><p>&copy; Someone. All rights reserved.</p></footer></body></html>"""


def test_page():
    assert html.main_text(PAGE) == (
        "Title & more First paragraph with one link, long enough to be read. Next line. Second one, unénclosed and fine. point one of it point two of it Last words of the article."
    )


@pytest.mark.parametrize("page", ["", None, "<", "<p", "<!-- open", "</div></p>", "<script>x", "<p class='", "<a b=\"c>d", "&amp", "<p>" * 3000])
def test_broken_pages(page):
    html.main_text(page)


def test_scripts_never_leak():
    for script in ('<script src="a.js" />var x=1;</script>', "<script src=/a/>var x=1;</script>", "<SCRIPT>if (a<b) x='</p>'</script >", "<style/>p{}</style>", "<textarea/>typed</textarea>", "<title/>head</title>"):
        assert html.main_text(f"<article><p>One sentence of the story.</p>{script}<p>And one more of it.</p></article>") == "One sentence of the story. And one more of it."


def test_class_names_inside_an_article():
    text = "It is told in these words what there is to tell."
    for part in ('<p class="story-header">%s</p>', '<div id="more-story"><p>%s</p></div>', '<section class="notice"><p>%s</p></section>', "<header><h2>%s</h2></header>"):
        page = f"<nav><a href=/>Home</a></nav><article><p>{text}</p>{part % 'Nothing of this may go.'}<p>{text}</p></article><footer><p>Imprint and contact.</p></footer>"
        assert html.main_text(page) == f"{text} Nothing of this may go. {text}"
    for part in ('<div class="ad">%s</div>', '<aside><p>%s</p></aside>', '<div class="related-links"><p>%s</p></div>', '<div class="comments"><p>%s</p></div>', "<form><p>%s</p></form>", '<div class="cookie-notice"><p>%s</p></div>', "<button>%s</button>"):
        page = f"<article><p>{text}</p>{part % 'All of this has to go.'}<p>{text}</p></article>"
        assert html.main_text(page) == f"{text} {text}"


#: Held-out pages, laid out unlike the training pages and the tables: (page, main text).
HELD_OUT = [
    (
        "<html><body id=top><div class='wrapper'><div class='site-logo'>Example</div><ul class='navigation'><li><a href=1>A</a></li><li><a href=2>B</a></li></ul>"
        "<div id='maincontent'><h1>On rivers</h1><div>Rivers run to the sea. <a href=x>Some</a> do not.</div><div>Those end in lakes, or in the sand.</div></div>"
        "<div class='rail'><h3>Trending</h3><p>Ten things that you did not know.</p></div><div id=copyright>Copyright by the makers of this page.</div></div></body></html>",
        "On rivers Rivers run to the sea. Some do not. Those end in lakes, or in the sand.",
    ),
    (
        "<body><div role=dialog><p>We value your privacy and ask for your consent.</p></div><main><h1>Bread</h1><ol><li>Mix flour and water.<li>Wait a day.</ol>"
        "<p>Then bake it &mdash; not too long.</p><div class=social>Follow us</div></main><section id=respond><h3>Reply</h3><p>What a fine bread, I have made it twice.</p></section></body>",
        "Bread Mix flour and water. Wait a day. Then bake it — not too long.",
    ),
    (
        "<body><table><tr><td class='toolbar'><a href=/>Start</a> | <a href=/n>News</a></td></tr><tr><td class='story'><p>An old layout of tables holds this text.</p>"
        "<p>It goes on in a second part.</p></td><td class='sponsor'><p>This space is paid for by a firm.</p></td></tr></table></body>",
        "An old layout of tables holds this text. It goes on in a second part.",
    ),
]


@pytest.mark.parametrize(("page", "text"), HELD_OUT)
def test_held_out_pages(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("unit", ["<b>", "</i>", '<a x="', "<p>x", "<div>x", "x</div>", "<script>", "<!--", "<", "&", "<p class=main>x</p><p class=ad>y</p>", "<a =", "<b><p>"])
def test_hostile_pages_take_linear_time(unit):
    import time

    html.classifier()
    page = unit * (1_000_000 // len(unit))
    began = time.process_time()
    html.main_text(page)
    html.main_text("<b>" * 100_000 + page[:500_000])
    assert time.process_time() - began < 8


def test_plain_text_page():
    text = "Only words stand here, and a good many of them, so they are the page."
    assert html.main_text(text) == text == html.main_text(f"<p>{text}")


def test_pages_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = html.extract_pages(df).collect()
    assert len(got) == 3 and got[0].n_chars == len(got[0].text) and [r.text for r in got if r.page_id is None] == [""]
    assert html.extract_pages(df.where("false")).count() == 0


def test_query9_against_the_article(spark):
    import html as H
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in html.op9_html_extraction(spark, SMALL).collect():
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        assert r.text == " ".join(H.unescape(re.sub(r"<(?!/?b>)[^>]+>", " ", body).replace("<b>", "").replace("</b>", "")).split())


def test_score_column_is_bounded(spark):
    got = langid.op6_language_id(spark, SMALL).agg(F.min("score"), F.max("score")).first()
    assert 0 <= got[0] <= got[1] <= 1
