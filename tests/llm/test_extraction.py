import itertools
import random
import re
from html import escape, unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import extraction as X
from claimlens.llm.dom import Paths, blocks
from claimlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages(spark):
    return [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def model(pages):
    return X.fit(X.labelled_pages(pages[:120]))


def article(html):
    """Headings and paragraphs of the given pages' one article, cut by hand."""
    parts = re.split("</?(?:h1|p)>", re.search("<article>(.*?)</article>", html, re.S).group(1))
    out = [" ".join(unescape(re.sub("<[^>]*>", " ", p)).split()) for p in parts]
    return "\n\n".join(p for p in out if p)


def texts(html):
    return [t for _, t, _ in blocks(html, Paths())]


@pytest.mark.parametrize("html, want", [
    ("", []),
    ("a &amp;&#101; &nosuch; b", ["a &e &nosuch; b"]),
    ("<p>one<p>two<b>x</b>y", ["one", "twoxy"]),
    ("<p><b>one.<br><p>two</p>", ["one.", "two"]),
    ("<p>a<br>b&nbsp;\n\t c", ["a b c"]),
    ("<!-- <p>no</p> --><p>yes<!--", ["yes"]),
    ("<script>var t='</p>';</script>a<style>p{}</style>b", ["ab"]),
    ("<script>never ends <p>x", []),
    ("<head><title>t</title><p>x", ["x"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><td><p>c</table>d", ["a", "b", "c", "d"]),
    ("<div>a</section></p>b</div>c", ["a", "b", "c"]),
    ("<div><span>a</div>b<button>no</button><select><option>no</select>c", ["a", "bc"]),
    ("<p class=\"x>y\" id='<'>a<p title=\"open>b", ["a", "b"]),
    ("1 < 2 <3 & 4 <> 5", ["1 < 2 <3 & 4 <> 5"]),
    ("<P>Upper<BR/>case</P><SCRIPT>x</SCRIPT >end", ["Upper case", "end"]),
])
def test_blocks(html, want):
    assert texts(html) == want


def test_chains_and_links():
    paths = Paths()
    (p, text, linked), = blocks("<div class='sideBar x2'><ul role=menu><li><a href=/>go on</a> now", paths)
    assert (text, linked) == ("go on now", 5)
    assert paths.seen[p] == {"in div", "in ul", "in li", "in a", "name side", "name bar", "name x", "name menu"}


def test_odd_markup_takes_linear_time():
    for html in ("<a \"" * 50_000, "<" * 200_000, "<div>" * 20_000 + "x", "<p>" * 50_000, "<!--" * 50_000, "<a b='" * 50_000, "&" * 200_000):
        assert len(blocks(html, Paths())) <= 1


def test_forward_backward_and_viterbi_by_enumeration():
    rng = np.random.default_rng(1)
    trans, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    sizes = np.array([3, 1, 0, 5])
    scores = rng.normal(size=9) * 2
    main, pairs, norm = X.forward_backward(scores, sizes, trans, start)
    want_pairs, at = np.zeros((2, 2)), 0
    for n, z in zip(sizes, norm):
        if not n:
            continue
        own = scores[at:at + n]
        values = {y: start[y[0]] + sum(trans[a, b] for a, b in zip(y, y[1:])) + sum(s for s, b in zip(own, y) if b)
                  for y in itertools.product((0, 1), repeat=int(n))}
        total = np.logaddexp.reduce(list(values.values()))
        assert np.isclose(total, z)
        for k in range(n):
            assert np.isclose(main[at + k], sum(np.exp(v - total) for y, v in values.items() if y[k]))
        for y, v in values.items():
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += np.exp(v - total)
        got = X.Field(np.zeros(1), trans, start).viterbi(own.tolist())
        assert tuple(map(int, got)) == max(values, key=values.get)
        at += n
    assert np.allclose(pairs, want_pairs)


def test_held_out_pages_of_the_table(pages, model):
    reader = X.Reader(model)
    for html in pages[120:]:
        assert "\n\n".join(reader.main_blocks(html)) == article(html)


def test_held_out_dressed_pages(pages, model):
    """Blocks of pages in containers of other names, or none, with other parts around and in the article."""
    rng = random.Random(99)
    held = [X.self_labelled(h) for h in pages[120:]]
    prose = [t for p in held for _, t, m in p if m]
    right = total = 0
    for p in held:
        html = X.dressed(p, prose, rng)
        reader = X.Reader(model)
        found = blocks(html, reader.paths)
        got = model.viterbi([reader._path_score(at) + reader._text_score(t, n) for at, t, n in found])
        right += sum(a == bool(reader.paths.main[at]) for a, (at, _, _) in zip(got, found))
        total += len(found)
    assert right > 0.985 * total


PARTS = {
    "menu": "<ul id='top-menu'><li><a href='/a'>Home</a><li><a href='/b'>About</a></ul>",
    "header": "<header class=page-header><a href=/>The site</a></header>",
    "sidebar": "<div class='left sidebar'><p>Some words that are beside the text, in a full sentence.</p></div>",
    "notice": "<div id=cookie-bar><p>We use cookies on this site.</p><a href=#>Accept</a></div>",
    "advert": "<div class='ad-slot'><p>Buy these fine things today, they are cheap and good.</p></div>",
    "form": "<form action=/s><label>Search this site</label><input name=q></form>",
    "comments": "<section id='comments'><h3>2 comments</h3><p>I have read this with joy, it is a good text.</p><p>So have I.</p></section>",
    "footer": "<footer><p>© 2024 The site · Imprint</p></footer>",
}


@pytest.mark.parametrize("container", ["article", "main", "div class=content", "div id=article_text"])
def test_kinds_of_other_parts(model, container):
    """Each kind of part around the article and in it."""
    main = ["A heading of the text", "The first paragraph has a few words, and a second part.", "Another one follows it. It ends here.", "Short."]
    tag = container.split()[0]
    body = [f"<h1>{main[0]}</h1>", *(f"<p>{t}</p>" for t in main[1:])]
    reader = X.Reader(model)
    for name, part in PARTS.items():
        before = f"<body>{part}<{container}>{''.join(body)}</{tag}></body>"
        behind = f"<body><{container}>{''.join(body)}</{tag}>{part}</body>"
        assert reader.main_blocks(before) == reader.main_blocks(behind) == main, name
        if name in ("advert", "comments", "sidebar", "form"):
            assert reader.main_blocks(f"<{container}>{''.join(body[:2])}{part}{''.join(body[2:])}</{tag}>") == main, name


def test_round_trip(model):
    """Text that is written as a page comes back."""
    rng = random.Random(2)
    reader = X.Reader(model)
    for _ in range(50):
        want = [" ".join("".join(rng.choice("abc&<>\"'é;") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(3, 40))) for _ in range(6)]
        html = "<nav><a href=/>x</a></nav><article>" + "".join(f"<p>{escape(t).replace(' ', rng.choice([' ', chr(10), '&#32;', '<br>']))}</p>" for t in want) + "</article>"
        assert reader.main_blocks(html) == want


def test_odd_rows(spark):
    long = "word " * 400_000
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>x y z.</p></article>"), (4, "u", f"<article><p>{long}</p></article>"),
            (4, "u", "<nav>"), (5, "u", "<article><p>x y z.</p></article>"), (5, "u", "<article><p>x y z.</p></article>"), (6, "u", "plain words, no tag at all.")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("text", "n_chars", "h", "id"):
        pages = pages.withColumn(c, F.lit(1))
    got = sorted((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in X.extract(pages, X.train(pages)).collect())
    want = [(1, "u", ""), (2, "", ""), (0, "u", "x y z."), (4, "u", long.strip()), (4, "u", ""), (5, "u", "x y z."), (5, "u", "x y z."),
            (6, "u", "plain words, no tag at all.")]
    assert got == sorted((*w, len(w[2])) for w in want)


def test_empty_table_and_pages_that_label_nothing(spark):
    pages = spark.createDataFrame([], "page_id int, url string, html string")
    assert X.extract(pages, X.train(pages)).count() == 0
    pages = spark.createDataFrame([(1, "u", "<nav><a href=/>Home</a></nav><article></article><div class=content><p>The text of the page, in words.</p></div>")],
                                  "page_id int, url string, html string")
    assert X.extract(pages, X.train(pages)).first()["text"] == "The text of the page, in words."


def test_query_returns_every_page(spark, pages):
    got = {r["page_id"]: r for r in QUERIES["op13_html_extraction"](spark, SF).collect()}
    assert len(got) == len(pages)
    for k, html in enumerate(pages):
        assert got[k]["text"] == article(html) and got[k]["n_chars"] == len(article(html))
