"""The tree model against summing over all markings, and main texts of written pages."""

import itertools
import random

import numpy as np
import pytest

from rollbook.llm import extraction, queries


@pytest.fixture(scope="module")
def model(small):
    return extraction.fit(small("pages"))


def test_marginals_are_sums_over_all_markings():
    rng = np.random.default_rng(5)
    pages = ["<p>a</p>b<div>c<span class='ad'>d</span></div>", "<ul><li>x<li>y, z.</ul>", ""]
    seen = extraction.Evidence(extraction.forest_of(pages))
    model = extraction.Model(rng.normal(size=int(extraction._OFFSETS[-1])), rng.normal(size=(len(extraction._KIND_NAMES), 2, 2)))
    unary, chance = model.potentials(seen), model.marginals(seen)
    nodes = np.flatnonzero(np.arange(len(unary)) >= 0)
    roots = [k for k in nodes if seen.parent[k] < 0]
    for a, b in zip(roots, [*roots[1:], len(nodes)], strict=True):
        total, on = 0.0, np.zeros(b - a)
        for state in itertools.product((0, 1), repeat=b - a):
            s = sum(unary[a + k, y] for k, y in enumerate(state))
            s += sum(model.tables[seen.kind[v], state[seen.parent[v] - a], state[v - a]] for v in range(a + 1, b))
            total += np.exp(s)
            on += np.exp(s) * np.array(state)
        assert np.allclose(chance[a:b], on / total)


def test_gradient_is_that_of_the_likelihood():
    forest = extraction.forest_of(["<nav>a</nav><article><p>b, c.</p><p>d</p></article>"] * 2)
    main = np.array([False, True, True] * 2)
    fitted = extraction.fit_trees(forest, main, rounds=150)
    chance = fitted.marginals(extraction.Evidence(forest))[np.array(forest.leaf)]
    assert ((chance > 0.9) == main).all()


def lines(page, model):
    return extraction.main_texts([page], model)[0].split("\n")


def test_pages_of_the_table(spark, small, model):
    import html
    import re

    rows = {r.page_id: r for r in queries.op13_extraction(spark, "/root/testdata/sf0.001").collect()}
    for page in small("pages").collect():
        inner = re.search("<article>(.*?)</article>", page.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub("</?b>|<br>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        got = rows[page.page_id]
        assert got.text == "\n".join(w for w in want if w) and got.n_chars == len(got.text) and got.url == page.url


SENTENCES = ["The council met on Tuesday, and nobody spoke for the first hour.", "By evening a plan was on the table; it took two more days to agree on it.", "What it costs isn't known yet, but everyone expects an answer in May."]
LAYOUTS = {
    "names": '<div class="site-header"><a href=/>Home</a></div><div id="post-content"><h2>A long day</h2>{}</div><div class="sidebar"><h3>Related</h3><a href=/x>Something else</a></div><div id="comments"><h2>2 comments</h2><p>I was there, and it was much longer than that. Two hours at least, I think.</p></div><div class="site-footer">&copy; 2020 The paper</div>',
    "tags": '<header><nav><a href=/>Home</a> <a href=/a>About us</a></nav></header><main><article><h2>A long day</h2>{}<form><label>Your mail</label><input><button>Send</button></form></article></main><aside><p>Buy our book about councils, now in a new edition.</p></aside><footer>All rights reserved.</footer>',
    "notice": '<div class="cookie-banner"><p>We use cookies to make this page better, as you can read elsewhere.</p><button>Yes</button></div><ul><li><a href=/1>One</a><li><a href=/2>Two</a></ul><article><h2>A long day</h2>{}<div class="ad-slot"><p>Cheap flights, today only. Book here before they are gone.</p></div></article><script>var x = "<p>no</p>";</script><style>p {{}}</style>',
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_written_pages(model, name):
    page = LAYOUTS[name].format("".join(f"<p>{s}</p>\n" for s in SENTENCES * 2))
    assert lines(page, model) == ["A long day", *SENTENCES, *SENTENCES]


def test_held_out_layouts(small):
    pages = [r.html for r in small("pages").orderBy("page_id").collect()]
    made = extraction.learned(pages[:30], rounds=200)
    forest = extraction.forest_of(pages[30:])
    texts = extraction.block_texts(forest, extraction.marked_by_markup(forest)[0])
    rng = random.Random(77)
    blocks = [t.split("\n") for t in texts]
    words = [w for t in texts for w in t.split()]
    new = [extraction.made_over(b[:10], [x[:200] for x in rng.choices(blocks[0], k=5)], words, rng) for b in blocks for _ in range(4)]
    other = extraction.forest_of([h for h, _ in new])
    want = extraction.marked_by_text(other, [t for _, t in new])
    have = made.marginals(extraction.Evidence(other))[np.array(other.leaf)] >= 0.5
    assert (want == have).mean() > 0.95


def test_labelled_pages_with_their_texts(spark):
    rows = [(f"<div>{k} menu</div><pre>{SENTENCES[k % 3]}</pre><div>end {k}</div>", SENTENCES[k % 3]) for k in range(20)]
    made = extraction.fit(spark.createDataFrame(rows, "html string, text string"), text="text")
    assert lines(f"<div>a menu</div><pre>{SENTENCES[1]}</pre><div>end</div>", made) == [SENTENCES[1]]


def test_broken_markup(model):
    body = "".join(f"<p>{s}" for s in SENTENCES)
    assert lines(f"<article><p>Fish &amp; chips&nbsp;&#8212; \n\t a &lt;story&gt; of &eacute;t&eacute;, and so on.<!-- no --><br>More of it.{body}", model) == ["Fish & chips — a <story> of été, and so on. More of it.", *SENTENCES]
    deep = "<div>" * 5_000 + f"<article><p>{SENTENCES[0]}</p><p>{SENTENCES[1]}</p>" + "</div>" * 7_000
    assert lines(deep, model)[0] in (SENTENCES[0], "")
    for odd in ("<", "<a href=\"", "</", "<!--", "<p", "&", "<script>", "a<b>c", "</p></p>", "<li></ul><td>x</table>", "\0", "<p title='>x"):
        extraction.main_texts([odd], model)


def test_odd_rows(spark, model):
    page = LAYOUTS["tags"].format("".join(f"<p>{s}</p>" for s in SENTENCES))
    long = "<article>" + "".join(f"<p>{s}</p>" for s in SENTENCES * 4_000) + "</article>"
    rows = [(1, "u", page, None, "x"), (1, "u", page, "t", "x"), (None, None, page, None, None), (2, None, None, None, None), (3, "u", "", None, None), (4, "u", " \n", None, None), (5, "u", long, None, None)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    have = extraction.extract(docs, model)
    assert have.columns == ["page_id", "url", "text", "n_chars"]
    made = sorted(have.collect(), key=lambda r: (r.page_id or 0, r.n_chars))
    assert [r.page_id for r in made] == [None, 1, 1, 2, 3, 4, 5] and made[0].text == made[1].text == made[2].text
    assert [r.text for r in made[3:6]] == ["", "", ""] and made[6].text == "\n".join(SENTENCES * 4_000)
    assert extraction.extract(docs.limit(0), extraction.fit(docs.limit(0))).count() == 0
