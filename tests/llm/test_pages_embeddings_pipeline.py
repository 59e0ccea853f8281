import itertools
import random
import re
import time

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from sightline.llm import embedding_dedup
from sightline.llm.embedding_dedup import OP3_SQL, CoverTree, near_duplicate_vectors, near_pairs, op3_embedding_dedup
from sightline.llm.html_text import block_weights, blocks, content_side, edges_of, extract_main_text, feature, main_text, op8_html_text, prior_weights
from sightline.llm.url_filters import RULES, best_split, judged_urls, op6_url_filters

SF = "/root/testdata/sf0.001"


def brute_links(rows, threshold):
    good = {}
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault((label, len(v)), []).append((i, np.array(v, np.float64)))
    links = {i: set() for i, _, _ in rows}
    for group in good.values():
        for (i, a), (j, b) in itertools.combinations(group, 2):
            if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), i == min(seen))
    return out


def as_dict(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_op3_against_brute_force_and_sql(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = as_dict(op3_embedding_dedup(spark, SF))
    assert got == brute_links(rows, 0.98)
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert {r[0]: r[1:] for r in c.execute(OP3_SQL).fetchall()} == got


@pytest.mark.parametrize(("cell", "visitors"), [(4096, 8192), (40, 70)])
def test_clusters_hot_vectors_and_bad_vectors(spark, monkeypatch, cell, visitors):
    for name, value in (("CELL", cell), ("VISITORS", visitors), ("VECTORS_A_PIVOT", 30), ("LEAF", 4)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 8))
    rows = []
    for i in range(360):
        k = 0 if i % 3 == 0 else i % 12
        v = base[k] * rng.uniform(0.5, 2) + rng.normal(size=8) * rng.choice([0, 0.05, 0.1, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], None if i % 50 == 49 else int(i % 2)))
    rows += [(1000, None, 0), (1001, [0.0] * 8, 0), (1002, [float("nan")] * 8, 0), (1003, [None] * 8, 0), (1004, [1.0, 2.0], 1), (1005, [], 1), (1006, [float("inf")] * 8, 1), (1007, [2.0, 4.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    assert as_dict(near_duplicate_vectors(df)) == brute_links(rows, 0.98)
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_cover_tree_finds_all_pairs(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAF", 4)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree, other = CoverTree(x[:300]), CoverTree(x[300:])
    for node in range(len(tree.center)):
        own = tree.order[tree.low[node] : tree.high[node]]
        assert np.linalg.norm(x[own] - x[tree.center[node]], axis=1).max() <= tree.radius[node] + 1e-7
    met = [(tree.within(x[i]), other.within(y[j]), sure) for x, y, pairs, sure in near_pairs(tree, other, 0.3) for i, j in np.argwhere(pairs)]
    got = {(i, j) for a, b, _ in met for i in a.tolist() for j in b.tolist()}
    assert sum(len(a) * len(b) for a, b, _ in met) == len(got)
    gap = np.linalg.norm(x[:300, None] - x[None, 300:], axis=2)
    assert {tuple(p) for p in np.argwhere(gap <= 0.3)} <= got and len(got) < gap.size / 2
    assert all((gap[np.ix_(a, b)] <= 0.3).all() for a, b, sure in met if sure)


def test_large_groups_of_equal_and_close_vectors(spark):
    """20,000 equal vectors are one point; 6,000 close ones are taken node by node."""
    rng = np.random.default_rng(1)
    same = rng.normal(size=16).tolist()
    center = rng.normal(size=16)
    rows = [(i, 1, same) for i in range(20_000)] + [(30_000 + i, 1, (center * (1 + i % 7) + 1e-4 * rng.normal(size=16)).tolist()) for i in range(6000)]
    began = time.monotonic()
    out = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(8))
    got = {tuple(r) for r in out.groupBy("n_links", "component_id").count().collect()}
    assert got == {(19_999, 0, 20_000), (5_999, 30_000, 6000)} and time.monotonic() - began < 60


def test_best_split():
    known = {"free": 50, "bets": 20, "bet": 30, "cheap": 40, "pills": 10, "in": 500, "win": 60}
    assert best_split("freebets", known, 1000) == ["free", "bets"]
    assert best_split("cheappills", known, 1000) == ["cheap", "pills"]
    assert best_split("", known, 1000) == [] and best_split("zz", {}, 0) in (["zz"], ["z", "z"])


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))


def test_op6_rules_and_verdicts(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op6_url_filters(spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(urls)
    for r in rows:
        host, path, rule, verdict = brute_url(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_urls_edge_cases_and_learning(spark):
    rows = [(i, f"http://good{i}.example.org.com/en/{i}", "<p>good words here</p>") for i in range(20)]
    rows += [(100 + i, f"http://freebets{i}.net/es/{i}", "<p>free bets today</p>") for i in range(20)]
    rows += [(200, "http://freebets.org/x", ""), (201, "http://good.org/x", None), (202, None, None), (203, "nonsense", "x"), (204, "", ""), (204, "", ""), (205, "HTTP://A.NET?x=1://y", ""), (206, "a://B.Example.COM/en/?q#f", "")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    out = judged_urls(pages).collect()
    got = {r.page_id: r for r in out}
    assert len(out) == len(rows)
    for i, url, _ in rows:
        assert (got[i].host, got[i].path, got[i].rule) == brute_url(url)[:3]
    assert got[200].verdict == "block" and got[201].verdict == "allow"
    assert judged_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in judged_urls(pages.where("page_id between 200 and 204")).collect()} == {"allow"}


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><h2>My site</h2></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><!-- <p>no</p> --><div class="ad">Buy now.</div>
<article><h1>A&amp;B title</h1><p><b>First   paragraph,
with &eacute; and 1 &lt; 2.<br><p>Second <a href="x">link</a> para.</p>{more}<form><label>Name</label><input></form></article>
<aside class="sidebar"><p>Related stories.</p></aside><section class="comments"><p>Nice post, thanks a lot!</p></section>
<footer>&copy; me &middot; all rights</footer></body></html>"""


def test_article_is_kept_and_the_rest_goes(spark):
    body = [f"<p>Sentence number {i}, which is long enough to be text.</p>" for i in range(4)]
    want = "A&B title\n\nFirst paragraph, with é and 1 < 2.\n\nSecond link para."
    more = "".join(f"\n\nSentence number {i}, which is long enough to be text." for i in range(4))
    rows = [(i, "u", ARTICLE.format(more="".join(body) if i % 2 else ""), "old") for i in range(8)] + [(90, "u", None, ""), (91, "u", "", ""), (92, "u", "<p", ""), (92, "u", "<p", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in extract_main_text(pages).collect()}
    for i in range(8):
        assert out[i].text == want + (more if i % 2 else "") and out[i].n_chars == len(out[i].text)
    assert out[90].text == out[91].text == out[92].text == "" and out[90].n_chars == 0
    assert extract_main_text(pages.limit(0)).count() == 0


def test_op8_returns_every_article(spark):
    import html

    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in op8_html_text(spark, SF).collect():
        inside = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", pages[r.page_id].html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?(?:b|br)>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.url == pages[r.page_id].url


def test_broken_markup():
    assert [b.text for b in blocks("a<b>b<p>c</b>d</div>e<script>x</p>")] == ["ab", "cde"]
    assert [b.text for b in blocks("<p>a<svg><path d='x'/>icon</svg>b <button>go</button>c</p>")] == ["ab c"]
    assert [b.text for b in blocks("<a '<p>one</p><p title='x>y'>two</p>")] == ["one", "two"]
    assert [b.text for b in blocks("<a title=it's>one</a><p>it's two")] == ["one", "it's two"]
    assert blocks("<script>only") == [] and blocks("<!-- open") == []
    assert [b.text for b in blocks("1 < 2 & 3")] == ["1 < 2 & 3"]
    assert len(blocks("<div>" * 3000 + "deep")) == 1


def test_minimum_cut_against_all_labellings():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 7)
        cost = np.array([rng.uniform(-3, 3) for _ in range(n)])
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.6]

        def energy(side, cost=cost, edges=edges):
            return sum(c for c, s in zip(cost, side, strict=True) if c > 0 and not s) - sum(c for c, s in zip(cost, side, strict=True) if c < 0 and s) + sum(w for i, j, w in edges if side[i] != side[j])

        best = min(energy(s) for s in itertools.product([False, True], repeat=n))
        assert energy(content_side(cost, edges)) == pytest.approx(best)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.count() > 0 and set(pieces.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} < ids
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert docs.count() == pieces.select("doc_id").distinct().count()


STORY = "".join(f"<p>Sentence {i} of the story goes on, with commas, for quite a few words, and ends here.</p>" for i in range(6))
MENU = "<nav><a href=a>Home</a> <a href=b>Shop</a></nav>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body class='has-sidebar'>{MENU}<article>{STORY}</article></body></html>",
        f"<html><body>{MENU}<div id='content-sidebar-wrap'><main>{STORY}</main></div></body></html>",
        f"<html><body>{MENU}<div class='no-sidebar'><article>{STORY}</article></div></body></html>",
        f"<html><body>{MENU}<form id=page><article class=post>{STORY}</article></form></body></html>",
        f"<html><body>{MENU}<article class='post comments-open'>{STORY}</article></body></html>",
    ],
)
def test_a_name_around_an_article_doesnt_take_its_text(spark, page):
    other = f"<html><body>{MENU}<article>{STORY}</article><div class=sidebar><a href=x>Top ten</a></div><footer>© 2020 | Legal</footer></body></html>"
    rows = [(0, page), *((i, other) for i in range(1, 9))]
    text = extract_main_text(spark.createDataFrame(rows, "page_id long, html string")).where("page_id = 0").first().text
    assert text.count("Sentence") == 6 and "Shop" not in text


def test_labels_of_nested_elements():
    def seeds(page):
        return [b.seed for b in blocks(page)]

    assert seeds("<aside><article>a teaser</article></aside>") == [-1] and seeds("<nav>menu<main>text</main></nav>") == [-1, 1]
    assert seeds("<div class=comments><article class=comment>a comment</article></div>") == [0]
    assert seeds("<article>text<div class=entry-footer>tags</div><div class=share>share</div></article>") == [1, 0, 0]


def test_the_classifier_can_outvote_a_name():
    weights = prior_weights()
    for name in ("no-sidebar", "share-body", "story story-follow-up", "legal"):
        assert main_text(f"{MENU}<div class='{name}'>{STORY}</div><div class=ad>Buy now</div>", weights).count("Sentence") == 6
    weights[feature("in sidebar")] = -9.0
    assert main_text(f"<div class=sidebar>{STORY}</div>", weights) == ""
    line = "<p class=legal>This licence applies to the whole story, and to all that is told in it, in every country.</p>"
    assert "licence" in main_text(f"<article>{STORY}{line}{STORY}</article>", prior_weights())


def test_pages_without_article_and_with_misleading_names(spark):
    """The classifier learns from the pages that have elements, and finds the text of those that have none."""
    taught = f"<html><body>{MENU}<article>{STORY}</article><aside><a href=x>Top ten</a></aside><footer>© 2020 | Legal</footer></body></html>"
    plain = [
        f"<html><body><div class=menu><a href=a>Home</a> <a href=b>Shop</a></div><div class=c1>{STORY}</div><div class=c2><a href=x>Top ten</a></div><div class=c3>© 2020 | Legal</div></body></html>",
        f"<html><body><table><tr><td><a href=a>Home</a> <a href=b>Shop</a><td class=share-body>{STORY}<td>© 2020 | Legal</table></body></html>",
        f"<html><body><ul><li><a href=a>Home</a><li><a href=b>Shop</a></ul><div class='story story-follow-up'>{STORY}</div><p>© 2020 | Legal</body></html>",
    ]
    pages = spark.createDataFrame([(i, p) for i, p in enumerate(plain)] + [(9 + i, taught) for i in range(30)], "page_id long, html string")
    for r in extract_main_text(pages).collect():
        assert r.text.count("Sentence") == 6 and not re.search("Shop|Top ten|Legal", r.text), (r.page_id, r.text)


def test_lists_and_comments_in_articles(spark):
    page = f"<html><body>{MENU}<article>{STORY}<ul><li>The first point, which is made here in some words.</li><li>The second point is made in other words.</li></ul><div class=ad>Buy now.</div><section class=comments><p>Nice post!</p></section></article><footer>© x</footer></body></html>"
    other = f"<html><body>{MENU}<article>{STORY}</article><footer>© x</footer></body></html>"
    text = extract_main_text(spark.createDataFrame([(0, page), *((i, other) for i in range(1, 30))], "page_id long, html string")).where("page_id = 0").first().text
    assert text.count("Sentence") == 6 and text.count("point") == 2 and "Buy" not in text and "Nice" not in text


LONG_PAGES = {
    "nested": "".join(f"<div class='a{i}'>word {i} " for i in range(20_000)), "flat": "".join(f"<p>word {i}, and more.</p>" for i in range(20_000)), "quotes": "<a '" * 50_000, "values": "<a b='" * 50_000,
    "declarations": "<!" * 200_000, "scripts": "<script></script" * 50_000, "comments": "<!--" * 100_000, "inline": "<i>" * 20_000 + "<b>" * 20_000 + "</i>" * 20_000 + "x", "closed": "<p>" + "</div>" * 100_000,
}


@pytest.mark.parametrize("name", LONG_PAGES)
def test_long_pages_take_seconds(name):
    began = time.monotonic()
    main_text(LONG_PAGES[name], prior_weights())
    assert time.monotonic() - began < 10
    if name == "flat":
        found, rng = blocks(LONG_PAGES[name]), random.Random(2)
        assert len(found) == 20_000
        content_side(np.array([rng.uniform(-0.5, 0.5) for _ in found]), edges_of(found))
        assert time.monotonic() - began < 20


def test_a_head_without_end_tag_takes_no_text():
    def texts(page):
        return [b.text for b in blocks(page)]

    assert texts("<html><head><title>t</title><body><article>story</article>") == ["story"]
    assert texts("<head><meta charset=utf-8><noscript><link href=x><body><p>story") == ["story"]
    assert texts("<head><title>t</title><p>story</p></head><p>more") == ["story", "more"]
    assert texts("<head><title>t</title>story<p>more") == ["story", "more"]
    assert texts("<head><head><script>x</script></head><body>story") == ["story"]
    assert texts("<html><head><title>t</title><style>x</style></head><body><header>menu</header>story") == ["menu", "story"]


LONG = "Long text of an article that says much, in many words, and ends here."
MORE = "More text follows after that, again with many words in it, and a stop."
#: The inside of an article, and its blocks.
SHAPES = {
    "links in a list": ("<ul><li><a href=x>Bridges</a></li><li><a href=y>Tunnels</a></li></ul>", ["Bridges", "Tunnels"]),
    "table": ("<table><tr><th>Year</th><th>Count</th></tr><tr><td>2019</td><td>12</td></tr></table>", ["Year", "Count", "2019", "12"]),
    "headings": ("<h2>Notes</h2><h3>1</h3>", ["Notes", "1"]),
    "quote": ("<blockquote>No</blockquote>", ["No"]),
    "definitions": ("<dl><dt>Arch</dt><dd>A curve</dd></dl>", ["Arch", "A curve"]),
    "a link alone": ("<p><a href=x>All of the bridges</a></p>", ["All of the bridges"]),
    "list without links": ("<ol><li>One</li><li>Two</li></ol>", ["One", "Two"]),
}


@pytest.fixture(scope="module")
def learned(spark):
    return block_weights(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main>{}</main>", "<body><nav><a href=/>Home</a></nav><article><div>{}</div></article><footer>About us</footer>"])
@pytest.mark.parametrize("shape", SHAPES)
def test_no_block_of_an_article_is_lost_for_its_shape(learned, frame, shape):
    inside, want = SHAPES[shape]
    for weights in (learned, prior_weights()):
        assert main_text(frame.format(f"<p>{LONG}</p>{inside}<p>{MORE}</p>"), weights).split("\n\n") == [LONG, *want, MORE]


@pytest.mark.parametrize("shape", ["table", "headings", "quote", "definitions", "list without links"])
def test_blocks_of_a_part_that_names_speak_for(learned, shape):
    inside, want = SHAPES[shape]
    page = f"<div class=menu><ul><li><a href=/>Home</a></li></ul></div><div class=content><p>{LONG}</p>{inside}<p>{MORE}</p></div>"
    for weights in (learned, prior_weights()):
        assert main_text(page, weights).split("\n\n") == [LONG, *want, MORE]


def test_a_form_around_the_page_is_no_form():
    page = f"<form id=aspnetForm><input type=hidden name=x><h1>A title of the page</h1><p>{LONG}</p><p>{MORE}</p></form><form><p>Your name</p><input name=n><p>Send us your thoughts about all of this today.</p></form>"
    assert main_text(page, prior_weights()).split("\n\n")[-2:] == [LONG, MORE]
    assert "thoughts" not in main_text(f"<article><p>{LONG}</p><form><p>Send us your thoughts about all of this today.</p></form></article>", prior_weights())
