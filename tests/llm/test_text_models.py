"""HTML text, URL rules, language, LM score, toxicity: fixtures, brute force, held-out accuracy."""

import math
import os
import random
import re
import subprocess
import sys
import time
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from geospan.llm import boosting, html_text, language_id, lm_score, toxicity, url_filter

# ---------------------------------------------------------------- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="site">Site name</header><nav><ul><li><a href="/x">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this the best site in the world for you.</div>
<article><h1>Title &amp; more</h1><p>The first   paragraph of
the <b>article</b> is here&nbsp;and it goes on.<br>Next line.</p><p>Short.</p>
<form><input name="q"><p>Search for it</p></form><aside>Related to this and that of the day</aside>
<p>The last &eacute; paragraph &#8212; it is the end of the article.</article>
<div id="comments"><p>I think that this is the best of all the comments in the world.</p></div>
<footer>&copy; The site</footer></body></html>"""


def test_html_main_text():
    assert html_text.main_text(PAGE) == "\n".join([
        "Title & more", "The first paragraph of the article is here and it goes on. Next line.", "Short.",
        "The last é paragraph — it is the end of the article."])
    plain = ("<div><a href=1>one</a> <a href=2>two</a></div><p>This is the text of a page that has no article "
             "in it at all.</p><p>And.</p><p>It is the other half of the text of this page and that is that.</p>")
    assert html_text.main_text(plain).count("\n") == 2 and "one" not in html_text.main_text(plain)
    assert html_text.main_text("") == "" and html_text.main_text("<p") == "" and html_text.main_text("</p></div>") == ""


STORY = "".join(f"<p>This is the paragraph {i} of the story, and it is as long as that of a paper with all of the news "
                "that was to be told in it, so that it has more than thirty words in the end.</p>" for i in range(4))


@pytest.mark.parametrize("page", [
    '<div style="overflow:hidden">@</div>', '<div data-hidden="false">@</div>', '<div title="hidden gems">@</div>',
    "<div title='a class=\"ad\" of' data-role=menu>@</div>", '<div class="no-sidebar">@</div>',
    '<main class="with-sidebar">@</main>', '<article id="related"><div class="social share">Share</div>@</article>',
    '<div class="no-sidebar"><div class="ad">It is an ad of the day and that is it.</div>@</div>',
    '<div>@</div><article class="card"><h3>One more</h3><p>It is the teaser of a story that is not on this page.</p></article>',
    '<div class="no-sidebar">@</div><article><p>It is the teaser of a story that is not here.</p></article>',
    '<article><p>It is the first half of the story.</p></article><div>@</div>'])
def test_html_keeps_the_story(page):
    text = html_text.main_text(f"<body>{page.replace('@', STORY)}</body>")
    assert all(f"paragraph {i} of" in text for i in range(4)) and "an ad" not in text and "Share" not in text


def test_html_hidden_and_boilerplate_stay_out():
    for out in ('<div hidden>@</div>', '<DIV HIDDEN>@</DIV>', '<div class="x" hidden="">@</div>',
                '<div aria-hidden="true">@</div>', '<div role="navigation">@</div>'):
        assert "paragraph" not in html_text.main_text(out.replace("@", STORY) + "<p>It is the text of the page itself.</p>")
    ad = '<div class="ad">It is an ad of the day and it is longer than that.</div>'
    assert html_text.main_text(ad + "<article><h1>Short.</h1></article>") == "Short."


COMMENT = "<p>I think that this is the best of all the stories that I have read in this paper, and so say all of us.</p>"


@pytest.mark.parametrize("name", ["comments", "comment-list", "commentlist", "reader-comments", "postComments", "sidebar",
                                  "cookie-banner", "cookies", "right sidebar", "ad", "ads-box", "advertisement", "site-nav"])
@pytest.mark.parametrize("page", ['<article>@</article><div class="%"></div>', '<div>@</div><section id="%"></section>',
                                  '<article>@<ol class="%"></ol></article>'])
def test_html_boilerplate_stays_out_however_long(page, name):
    text = html_text.main_text(page.replace("@", STORY[:STORY.index("</p>") + 4]).replace('%">', f'{name}">' + COMMENT * 12))
    assert "paragraph 0" in text and "I think" not in text


def generated_page(rng, i):
    """A page of known text: wrappers and boilerplate around an article, in one of several layouts."""
    def prose():
        return " ".join(rng.choices("the of and to in a is that for it was story paper river market early winter".split(), k=rng.randint(12, 60)))
    paragraphs = [prose().capitalize() + "." for _ in range(rng.randint(1, 6))]
    noise = ['<nav><a href="/">Home</a> <a href="/a">About the paper</a></nav>', f'<div class="sidebar"><p>{prose()}</p></div>',
             f'<aside>{prose()}</aside>', f'<form><p>{prose()}</p></form>', f'<footer><p>{prose()}</p></footer>',
             f'<section class="comments">{"".join(f"<p>{prose()}</p>" for _ in range(9))}</section>',
             f'<script>var a = "<p>{prose()}</p>";</script>', f'<!-- <p>{prose()}</p> -->', f'<div id="cookie-notice">{prose()}</div>']
    rng.shuffle(noise)
    body = "".join(f"<p>{' <b>'.join(p.split(' ', 1))}</b></p>\n" for p in paragraphs)
    body = [f"<article>{body}</article>", f'<div class="no-sidebar">{body}</div>', f"<main>{body}</main>", body][i % 4]
    return f"<html><body>{''.join(noise[:4])}{body}{''.join(noise[4:])}</body></html>", "\n".join(paragraphs)


def test_html_equals_the_text_of_generated_pages():
    rng = random.Random(21)
    for i in range(200):
        page, want = generated_page(rng, i)
        assert html_text.main_text(page) == want


@pytest.mark.parametrize("part", ['<a href="x ', "<p><span>", "<p>short</p>", "<svg>", "<!", "<!-", "</b", "<a title='<", "<div class=ad>a",
                                  "<", "&#", "</p>", "<b", '<i "', "<textarea>"])
def test_html_time_grows_with_the_length(part):
    page = part * (1_000_000 // len(part))
    if part in ("<p>short</p>", "<p><span>", "<div class=ad>a", "</p>", "<svg>", "<textarea>"):
        page = page[:300_000]  # hundreds of thousands of real tags
    start = time.monotonic()
    html_text.main_text("<p>It is the text of this page.</p>" + page)
    assert time.monotonic() - start < 8


def test_html_nearest_neighbours_and_ties():
    long_, link = "It is the text of the page and that of the paper too.", '<a href="x">one two three</a>'
    assert html_text.main_text(f"<p>{long_}</p><p>Tie</p><p>{link}</p>") == long_
    assert html_text.main_text(f"<p>{long_}</p><p>Near</p><p>Far</p><p>Out</p><p>{link}</p>").split("\n") == [long_, "Near"]
    assert "A caption" in html_text.main_text(f"<div><p>{long_}</p><figure><figcaption>A caption</figcaption></figure><p>{long_}</p></div>")


def test_extract_text_edge_cases(spark):
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (2, None, None, None), (None, "u", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract_text(pages).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, len(html_text.main_text(PAGE)), len(html_text.main_text(PAGE))]
    assert all(r.text is not None for r in got)
    assert html_text.extract_text(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- URLs

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/")]


def url_brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    fits = [r for _, r in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0]))
            and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules_equal_brute_force(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/1?x://y", "https://example.org/en/1", "http://org/",
            "http://borg/", "http://x.com/fr/a#b", "http://x.com/de", "http://x.com/de/?q", "ftp://a?b/c", "a://b://c/d"]
    urls += [f"https://s{i}.example.{t}/{p}/{i}" for i in range(60) for t in ("org", "com", "net") for p in ("de", "fr")]
    table = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for r in url_filter.judge_urls(table, RULES).collect():
        assert (r.host, r.path, r.rule) == url_brute(r.url)
        assert r.verdict == (dict((b, a) for a, b in RULES)[r.rule] if r.rule else
                             "block" if r.block_score >= 0.5 else "allow")
    assert url_filter.judge_urls(table.limit(0), RULES).count() == 0


# ---------------------------------------------------------------- trees and calibration

def test_boosting_learns_and_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)
    model = boosting.Boosted().fit(x[:2000], y[:2000])
    p = model.score(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.95
    at, value = boosting.isotonic(p, y[2000:])
    assert (np.diff(at) >= 0).all() and (np.diff(value) >= 0).all()
    assert boosting.Boosted().fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((1, 2)))[0] == pytest.approx(0.5)


# ---------------------------------------------------------------- language

EN, DE = ["the", "house", "with", "water", "river", "think", "other"], ["der", "haus", "mit", "wasser", "fluss", "denken"]


def test_language_held_out(docs):
    rng = random.Random(4)
    say = lambda words, n: " ".join(rng.choice(words) + rng.choice(["", "s", "er"]) for _ in range(n))
    rows = [(i, say((EN, DE)[i % 2], rng.randint(5, 400))) for i in range(200)]
    table = docs(rows).selectExpr("*", "if(doc_id % 2 = 0, 'en', 'de') as lang", "'x' as rejected_by")
    learned = language_id.train_dictionaries(table.filter("doc_id < 100"))
    got = {r.doc_id: r for r in language_id.identify(table.drop("lang"), learned).collect()}
    assert sum(got[i].lang_pred == ("en", "de")[i % 2] for i in range(100, 200)) >= 98
    assert all(0 <= r.lang_score <= 1 for r in got.values())
    odd = docs([(1, None), (2, ""), (3, "12 3!"), (4, "é")])
    assert {r.doc_id: r.lang_pred for r in language_id.identify(odd, learned).collect()}[4] in ("en", "de")
    assert [r.lang_pred for r in language_id.identify(odd.filter("doc_id < 4"), learned).collect()] == ["und"] * 3
    assert language_id.train_dictionaries(table.limit(0)) == {}
    assert [r.lang_pred for r in language_id.identify(odd, {}).collect()] == ["und"] * 4


def test_language_sample_survives_copies_and_headers(spark):
    header = "header of all texts " * 70  # longer than the stretch
    texts = spark.range(60).select(F.concat(F.lit(header), F.lit("body"), F.repeat(F.concat(F.lit(" b"), "id"), 2000)).alias("text"))
    copies = spark.range(30_000).select(F.lit("copied again").alias("text"))
    learned = language_id.train_dictionaries(texts.union(copies).withColumn("lang", F.lit("en")), max_docs=50)
    parts = learned["en"].decode().split("\n")
    assert len(parts) == 50 and sum(" b" in p for p in parts) > 25


# ---------------------------------------------------------------- LM

def test_lm_base_score_and_mass(docs):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(EN if i % 3 else DE).title() for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "never seen Words here"), (102, "never seen Words here")]
    table, taught = docs(rows), [r for r in rows if r[0] < 50]
    model = lm_score.train(table.filter("doc_id < 50"), shape=lm_score.Shape(head=5, exact=3, single=2, steps=4))
    count = Counter(w for _, t in taught for w in (t or "").lower().split())
    count["</end>"] = len(taught)
    n, v = sum(count.values()), len(count)
    got = lm_score.score_texts(table, model).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        tokens = (text[r.doc_id] or "").lower().split() + ["</end>"]
        want = sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens)
        assert r.base_score == pytest.approx(want) and r.n_tokens == len(tokens) and r.train_tokens == n
        assert r.n_known == sum(count[t] > 0 for t in tokens) and r.score < 0
    held = [r for r in got if 50 <= r.doc_id < 60]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    # In every class the shares of its words and of the unknown ones make up the whole.
    words = lm_score.Words(model.head, model.shape)
    shares = np.zeros(model.shape.classes)
    for w in [x for x in count if x != "</end>"]:
        _, _, k, _ = words.encode([w.encode()])
        shares[k[0]] += (count[w] + 1) / model.mass[k[0]]
    single = range(1, 1 + model.shape.single)
    assert all(shares[k] == pytest.approx(1) for k in single)
    assert all(shares[k] + 1 / model.mass[k] == pytest.approx(1) for k in range(1 + model.shape.single, len(shares)))
    empty = lm_score.train(table.limit(0), shape=lm_score.Shape(steps=1))
    assert lm_score.score_texts(table, empty).filter("isnan(score) or score is null").count() == 0


# ---------------------------------------------------------------- toxicity

def test_toxicity_held_out(spark, docs):
    rng = random.Random(3)
    mild = [f"mild{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(mild) for _ in range(rng.randint(10, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "loser", "gruselig" + rng.choice("abc")]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), "x"))
    table = docs(rows)
    known = spark.createDataFrame(labels, "doc_id long, toxic int, text string").filter("doc_id < 400")
    model = toxicity.train(table, known)
    got = {r.doc_id: r for r in toxicity.score_toxicity(table, model).collect()}
    assert all(got[i].toxic == int(i % 4 == 0) for i in range(400, 600))
    odd = toxicity.score_toxicity(docs([(1, None), (2, ""), (None, "x " * 50_000)]), model).collect()
    assert all(0 <= r.toxicity <= 1 for r in odd)
    nothing = toxicity.train(table, known.limit(0))
    assert toxicity.score_toxicity(table, nothing).filter("toxicity between 0 and 1").count() == 600


def test_toxicity_features():
    person, found = [2, 30, 31], [0, 7, 8, 24, 25, 36, 37]
    assert toxicity.count_near(found, person) == sum(any(abs(i - p) <= 5 for p in person) for i in found)
    assert toxicity.count_near([], person) == toxicity.count_near(found, []) == 0
    for text in ("", "plain", "ABC déÉÄ ΣΑΣ", "x" * 1000 + "Ö"):
        assert toxicity.count_capitals(text) == sum(map(str.isupper, text))
    features = toxicity.Features({"idiot": 2.0, "scumb*": 1.0})
    assert [features.weight(w) for w in ("Idiot", "1diot", "scumbags", "scum", "x", "idiots")] == [2, 2, 1, 0, 0, 0]


def test_models_unpickle_without_the_package():
    model = toxicity.ToxicityModel({"idiot": 1.0}, boosting.Boosted().fit(np.zeros((0, 2)), np.zeros(0)),
                                   boosting.isotonic(np.zeros(0), np.zeros(0)))
    code = ("import pickle, sys; m = pickle.load(sys.stdin.buffer); assert 'geospan' not in sys.modules; "
            "assert 0 <= m.scorer()(['you idiot'])[0] <= 1")
    subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(model), cwd="/", check=True,
                   env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
