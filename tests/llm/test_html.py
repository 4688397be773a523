import random

import pytest

from trustfold.llm import html

WORDS = "the on éa über and ou tion heed ing erst Ciónue lo".split()


def text(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def page(rnd, i):
    title = text(rnd, 5)
    blocks = [text(rnd, rnd.randrange(1, 60)) for _ in range(rnd.randrange(1, 6))]
    body = "".join(f"<p>{b.replace(' and ', ' <b>and</b> ').replace('on', 'on&amp;')}</p>" for b in blocks)
    nav = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in WORDS[:6])
    html_text = (
        f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        f"<nav><ul>{nav}</ul></nav><!-- ad {i} --><div class='ad banner'>{text(rnd, 9)}</div><article><h1>{title}</h1>{body}"
        f"<aside>{text(rnd, 4)}</aside></article><section id=comments><p>{text(rnd, 30)}</p></section><footer>&copy; {text(rnd, 12)}</footer></body></html>")
    want = "\n".join([title.strip(), *[b.replace("on", "on&") for b in blocks]])
    return html_text, want


def test_whole_articles(spark):
    rnd = random.Random(1)
    made = [page(rnd, i) for i in range(60)]
    rows = [(i, h, "x") for i, (h, _) in enumerate(made)] + [(100, None, "x"), (101, "", "x"), (102, made[0][0], "x"), (103, "plain words only", "x")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, html string, url string").repartition(3)).collect()
    by_id = {r["page_id"]: r for r in got}
    for i, (_, want) in enumerate(made):
        assert by_id[i]["text"] == want and by_id[i]["n_chars"] == len(want)
    assert by_id[100]["text"] == by_id[101]["text"] == "" and by_id[100]["n_chars"] == 0
    assert by_id[102]["text"] == made[0][1] and by_id[103]["text"] == "plain words only"


def test_weights_from_labelled_pages_reach_other_layouts(spark):
    rnd = random.Random(2)
    labelled = spark.createDataFrame([(page(rnd, i)[0],) for i in range(40)], "html string")
    weights, seen = html.learn(labelled)
    assert weights[html.cell("text:article")] > 0 > weights[html.cell("text:footer")]
    other = ("<body><div class=menu><a>one</a><a>two</a></div><div id=content><h2>Head</h2><p>first   block &eacute;</p><p>second<br>line</p></div>"
             "<form>name <input></form><div class='cookie notice'>we use cookies on this site to make it better for all</div></body>")
    assert html.main_text(other, weights, seen) == "Head\nfirst block é\nsecond line"


@pytest.mark.parametrize("scores,want", [([], (0, 0)), ([-1, -2], (0, 0)), ([1, -5, 3, -1, 2, -9], (2, 5)), ([2, -2, 2], (0, 1)), ([0, 1], (1, 2))])
def test_best_run(scores, want):
    assert html.best_run(scores) == want
    best = max([0.0] + [sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)])
    assert sum(scores[slice(*html.best_run(scores))]) == best


def test_broken_markup():
    none = (html.np.zeros(html.CELLS), html.np.zeros(html.CELLS, dtype=bool))
    assert html.main_text("<article><p>open <b>bold <p>next <br", *none) == "open bold\nnext"
    assert html.main_text("<div class=ad><article>kept</article>", *none) == "kept"
    assert html.main_text("<p>a<script>b</p>", *none) == "a"
    assert html.main_text("x " * 50_000, *none) == " ".join(["x"] * 50_000)


def test_empty_table_and_clashing_names(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
    with pytest.raises(ValueError):
        html.extract(spark.createDataFrame([(1, "a", "b")], "page_id long, html string, text string"))


def test_lists_tables_and_adverts_inside_the_article():
    """Menus are lists and articles hold none in the labelled pages; a list, table or advert still cuts nothing off."""
    rnd = random.Random(3)
    menu = "<ul>" + "".join(f"<li><a href=/{w}>{w} {w}</a></li>" for w in WORDS * 3) + "</ul>"
    advert = f"<div class=ad><p>{text(rnd, 40)}</p></div>"
    labelled = [f"<body>{menu}{advert}<article><h1>{text(rnd, 4)}</h1><p>{text(rnd, 80)}</p></article>{menu}</body>" for _ in range(200)]
    inside, outside = html.Counter(), html.Counter()
    for page_text in labelled:
        for t in html.tokens(page_text):
            if t.words or not t.text:
                side = inside if t.inside and not t.boiler else outside
                for kind in (t.kind, *([html.marked(t)] if hasattr(html, "marked") else [])):
                    side[html.cell(kind)] += max(1, t.words)
    weights, seen = html.np.zeros(html.CELLS), html.np.zeros(html.CELLS, dtype=bool)
    for c in {*inside, *outside}:
        w = html.math.log((inside[c] + html.PRIOR) / (outside[c] + html.PRIOR))
        weights[c], seen[c] = max(-html.LIMIT, min(html.LIMIT, w)), True
    a, b, c = text(rnd, 12), text(rnd, 40), text(rnd, 50)
    items = [text(rnd, 6) for _ in range(10)]
    lists = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    table = "<table>" + "".join(f"<tr><td>{x}</td></tr>" for x in items) + "</table>"
    wrap = lambda body: f"<body>{menu}{advert}<article>{body}</article>{menu}</body>"
    for middle in (lists, table):
        assert html.main_text(wrap(f"<p>{b}</p>{middle}<p>{c}</p>"), weights, seen) == "\n".join([b, *items, c])
        assert html.main_text(wrap(f"<p>{b}</p>{middle}"), weights, seen) == "\n".join([b, *items])
    assert html.main_text(wrap(f"<h1>{a}</h1><p>{a}</p>{advert}<p>{c}</p>"), weights, seen) == "\n".join([a, a, c])


def test_content_without_an_article_element(spark):
    """Weights learned where an article element marks the content find it where a plain or named div holds it."""
    rnd = random.Random(4)
    weights, seen = html.learn(spark.createDataFrame([(page(rnd, i)[0],) for i in range(40)], "html string"))
    for tag in ("div", "div class=x9", "section id=search-algorithms", "div class='related-work'"):
        for i in range(30):
            made, want = page(rnd, i)
            made = made.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag.split()[0]}>")
            assert html.main_text(made, weights, seen) == want


def test_lists_adverts_and_named_sections_of_an_article(spark):
    rnd = random.Random(5)
    weights, seen = html.learn(spark.createDataFrame([(page(rnd, i)[0],) for i in range(40)], "html string"))
    menu = "<ul>" + "".join(f"<li><a href=/{w}>{w} {w}</a></li>" for w in WORDS) + "</ul>"
    a, b, c = text(rnd, 20), text(rnd, 30), text(rnd, 25)
    items = [text(rnd, 1 + i % 4) for i in range(9)]
    body = (f"<p>{a}</p><ul>" + "".join(f"<li>{x}</li>" for x in items) + f"</ul><div class='ad banner'><p>{text(rnd, 50)}</p></div>"
            f"<section id='search-algorithms'><p>{b}</p></section><div class='related-work'><p>{c}</p></div>"
            "<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, see <a href=/y>this page</a>.</p>")
    want = "\n".join([a, *items, b, c, "so x=2 holds, see this page."])
    for tag in ("article", "div"):
        made = f"<body>{menu}<{tag}>{body}</{tag}>{menu}<section id=comments><p>{text(rnd, 60)}</p></section></body>"
        assert html.main_text(made, weights, seen) == want


def test_names_are_learned_from_labelled_pages(spark):
    """A name of no list is left out if labelled pages have it outside their content only; a listed one is kept if they have it within."""
    rnd = random.Random(6)
    rows = [(f"<body><div class=zz>{text(rnd, 30)}</div><article><p>{text(rnd, 100)}</p><div class=promo><p>{text(rnd, 200)}</p></div></article></body>",) for _ in range(40)]
    weights, seen = html.learn(spark.createDataFrame(rows, "html string"))
    assert html.main_text("<body><div><p>one two one two</p><div class=zz><p>three</p></div><div class=promo><p>four</p></div></div></body>", weights, seen) == "one two one two\nfour"


def test_the_scan_decides(spark):
    """Teasers and menus without names or boiler tags lie outside the best run; without the scan they would stay."""
    rnd = random.Random(7)
    weights, seen = html.learn(spark.createDataFrame([(page(rnd, i)[0],) for i in range(40)], "html string"))
    menu = "<div>" + "".join(f"<p><a href=/{w}>{w} {w} {w}</a></p>" for w in WORDS * 3) + "</div>"
    body = [text(rnd, 30) for _ in range(3)]
    made = f"<body>{menu}<div>" + "".join(f"<p>{x}</p>" for x in body) + f"</div>{menu}</body>"
    every = html.tokens(made)
    assert not any(html.left_out(t, weights, seen) for t in every) and sum(t.words for t in every) > 90 + 100
    assert html.main_text(made, weights, seen) == "\n".join(body)
