"""Copies, grades, urls, pages, and the pipeline."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caseloom.llm import html_extract, near_dedup, quality_classifier, url_filter
from caseloom.llm.common import table
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(5000)]


def plain_classes(docs):
    """Least doc_id of each class at a plain similarity of 0.8; docs of one id are one."""
    sets, parent = {}, {}
    for doc_id, text in docs:
        w = brute.folded_words(text)
        sets[doc_id] = frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        parent[doc_id] = doc_id

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    having = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            having[g].append(i)
    for i, s in sets.items():
        for j in {j for g in s for j in having[g] if j > i}:
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}


def test_near_duplicates(spark):
    rng, rows = random.Random(5), []
    for group in range(30):
        words = rng.choices(WORDS, k=rng.randrange(60, 200))
        for copy in range(rng.choice([1, 2, 3, 12])):
            changed = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                changed[rng.randrange(len(changed))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(changed) if copy % 2 else ", ".join(changed).upper()))
    rows += [(1000 + i, t) for i, t in enumerate([None, "", "  ", "!!", "a", "A.", "a b", "a b c d", "A b c D", "b a"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("clash")).repartition(6)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == plain_classes(rows)
    odd = df.unionByName(df.where("doc_id in (0, 1004)")).unionByName(spark.createDataFrame([(None, "a", None)], "doc_id long, text string, class_id string"))
    left = near_dedup.one_per_class(odd)
    assert left.columns == df.columns
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(got.values())) and ids.count(None) == 1
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_texts_that_share_an_id_are_texts_of_their_own(spark):
    """One id with three texts, each with copies or near copies of its own; none goes but for a partner."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=80)) for _ in range(4)]
    near = texts[1].split(" ")
    near[40] = "changed"
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[2]), (7, texts[2]), (3, texts[0].upper()), (9, " ".join(near)), (11, texts[3]), (None, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, near_dedup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(7, 3), (7, 7), (7, 7), (7, 7), (3, 3), (9, 7), (11, 11), (None, None)], key=repr)
    left = sorted(((r.doc_id, r.text) for r in near_dedup.one_per_class(df).collect()), key=repr)
    assert left == sorted([(3, texts[0].upper()), (7, texts[1]), (7, texts[2]), (11, texts[3]), (None, texts[3])], key=repr)


@pytest.mark.parametrize("share", [2, 3])
def test_recall_against_exact_pairs_in_large_groups(spark, share):
    """Half, or a third, of all texts are one group; members at a plain similarity of 0.8 or more of another one
    belong to its class, whatever their weights have become."""
    rng = random.Random(17)
    base, rows = rng.choices(WORDS, k=90), []
    for i in range(240):
        words = list(base) if i % share == 0 else rng.choices(WORDS, k=90)
        if i % share == 0:
            for _ in range(rng.randrange(3)):
                words[rng.randrange(90)] = f"y{i}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_classes(rows)


def test_a_large_group_of_near_copies_stays_together(spark):
    """A third of all rows are near copies, so their shingles are frequent and weigh less."""
    rng = random.Random(9)
    base = rng.choices(WORDS, k=120)
    rows = [(i, " ".join(rng.choices(WORDS, k=100))) for i in range(300)]
    for i in range(150):
        changed = list(base)
        changed[rng.randrange(120)] = f"z{i}"
        rows.append((300 + i, " ".join(changed)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(300, 450)} == {300} and all(got[i] == i for i in range(300))


def test_chains_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 102, 200]], "id long")
    got = {r.id: r.root for r in near_dedup.components(nodes, links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200}


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    sampler = near_dedup.Sampler(3.0, n=400)
    keys = rng.integers(0, 1 << 63, 300, np.uint64)
    one, other = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    other[:200] = one[:200]
    one[::7] = 3.0  # the weight that has a table
    doc = np.repeat([0, 1], 300)
    order = np.argsort(keys)
    got = sampler.of(doc, np.concatenate((keys[order], keys[order])), np.concatenate((one[order], other[order])), 2)
    similarity = np.minimum(one, other).sum() / np.maximum(one, other).sum()
    assert abs((got[0] == got[1]).mean() - similarity) < 0.07


def test_ordinal_model_on_held_out_documents(spark):
    rng, rows = random.Random(2), []
    for i in range(900):
        grade = rng.choice([0, 1, 2])
        words = rng.choices(WORDS[:300], k=40) + rng.choices([["awful", "vile"], ["dull", "grey"], ["fine", "deep"]][grade], k=2)
        rows.append((i, " ".join(words), grade))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = quality_classifier.train(df, df.where("doc_id < 600").select("doc_id", "grade"), n_grades=3)
    assert np.all(np.diff(model.thresholds) > 0)
    scored = quality_classifier.grade_documents(df.where("doc_id >= 600").withColumn("score", F.lit("clash")), model).collect()
    assert np.mean([round(r.expected_grade) == r.grade for r in scored]) > 0.95
    assert all(1 >= r.tails[0] >= r.tails[1] >= 0 for r in scored)
    odd = spark.createDataFrame([(1, None), (1, None), (None, "")], "doc_id long, text string")
    assert [r.score for r in quality_classifier.grade_documents(odd, model).collect()] == [0.0, 0.0, 0.0]
    none = quality_classifier.train(df.limit(0), df.limit(0).select("doc_id", "grade"), n_grades=3)
    assert not none.weights.any() and np.all(np.diff(none.thresholds) > 0)


def test_toxic_documents_are_caught(spark):
    from caseloom.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op1_quality_classifier"](spark, sf).join(table(spark, sf, "labels"), "doc_id").collect()
    clean = [r for r in got if not r.toxic]
    toxic = [r for r in got if r.toxic]
    assert sum(r.kept for r in clean) > 0.98 * len(clean) and sum(not r.kept for r in toxic) > 0.6 * len(toxic)


def ranked_right(scores, truths):
    """Share of pairs, one true and one not, in which the true one scores higher."""
    good, bad = (sorted(s for s, t in zip(scores, truths, strict=True) if bool(t) == side) for side in (True, False))
    return sum(np.searchsorted(bad, g, "left") + np.searchsorted(bad, g, "right") for g in good) / (2 * len(good) * len(bad))


def test_quality_and_toxicity_held_out(spark):
    """Fitted on the rated documents of one half, measured on those of the other."""
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, labels.where(half).select("doc_id", grade.alias("grade")), n_grades=3)
    held = quality_classifier.grade_documents(docs.join(labels.where(~half), "doc_id"), model).select("toxic", "quality", "tails").collect()
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert len(toxic) > 20 and len(clean) > 1000
    assert ranked_right([r.tails[0] for r in held], [not r.toxic for r in held]) > 0.9
    assert ranked_right([r.tails[1] for r in clean], [r.quality == 1 for r in clean]) > 0.75
    assert sum(r.tails[0] >= 0.5 for r in clean) > 0.95 * len(clean) and sum(r.tails[0] < 0.5 for r in toxic) > 0.6 * len(toxic)


def test_the_fit_is_the_likelihood_s_maximum():
    """A plain search, one coordinate at a time, finds no better weights or thresholds on data with one cut and few words."""
    rng = np.random.default_rng(4)
    n, grades = 400, None
    has = rng.random((n, 3)) < 0.5
    grades = (1.5 * has[:, 0] - 1.0 * has[:, 1] + rng.logistic(size=n) > 0.3).astype(np.int64) + (2.5 * has[:, 0] + rng.logistic(size=n) > 2).astype(np.int64)
    words = np.concatenate([np.flatnonzero(row) + 10 for row in has])
    model = quality_classifier.fit(words, has.sum(axis=1), grades, 3, bits=8)
    used = np.flatnonzero(model.weights)
    weight = (n / (3 * np.bincount(grades, minlength=3)))[grades]

    def loss(w, t):
        score = has @ w
        tail = 1 / (1 + np.exp(-(score[:, None] - t[None, :])))
        p = np.select([grades == 0, grades == 1], [1 - tail[:, 0], tail[:, 0] - tail[:, 1]], tail[:, 1])
        return -(weight * np.log(np.maximum(p, 1e-12))).sum() / n + 0.5 * quality_classifier.RIDGE * (w ** 2).sum()

    w, t = model.weights[10:13].astype(float), model.thresholds.copy()
    assert set(used) <= {10, 11, 12} and len(used) >= 1
    free = [k for k in range(3) if w[k]]
    best = loss(w, t)
    for step in (0.5, 0.1, 0.02):
        for _ in range(40):
            for k in (*free, 3, 4):
                for sign in (1, -1):
                    v, u = w.copy(), t.copy()
                    if k < 3:
                        v[k] += sign * step
                    else:
                        u[k - 3] += sign * step
                    if np.all(np.diff(u) > 0) and loss(v, u) < best:
                        w, t, best = v, u, loss(v, u)
    assert loss(model.weights[10:13].astype(float), model.thresholds) < 1.01 * best


URLS = [None, "", "no scheme", "http://", "https://EXAMPLE.net", "https://example.net/", "https://a.Example.NET/en/x?q#f", "https://example.net/en", "https://example.net/english/",
        "x://y.net?/en/", "http://example.com/de/", "http://m.example.com/de/x", "http://example.com/DE/", "http://badexample.com/de/", "http://a.org/fr/x", "http://a.org/frx",
        "http://org/fr/", "http://Ünï.org/fr/", "http://user@a.net:80/", "http://a.net:80/", "://net/", "http://a.net//", "http://a..net/x://b.org/fr/", "a\n://net/\n"]


@pytest.fixture(scope="module")
def urls(spark):
    return spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(3, URLS[3], None)], "page_id long, url string, host string").repartition(3)


@pytest.mark.parametrize("most", [10, 0])
def test_urls(spark, urls, most):
    """The trie, and the join that takes its place for large rule tables."""
    rules = spark.createDataFrame(list(url_filter.RULES), "host string, path string, verdict string")
    rows = url_filter.judge_urls(urls, rules, most_broadcast=most).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == brute.url(r.url), (most, r.url)
    assert url_filter.judge_urls(urls.limit(0)).count() == 0


def test_many_rules_agree_in_both_forms(spark):
    rng = random.Random(4)
    labels, parts = ["a", "b", "net", "org"], ["x", "y", "xy", ""]
    rules = {(".".join(rng.choices(labels, k=rng.randrange(1, 4))), "/" + "/".join(rng.choices(parts, k=rng.randrange(0, 3))), rng.choice(["allow", "block"])) for _ in range(60)}
    rules |= {("net", f"/p{i}", "block") for i in range(12)}
    pages = [(i, "h://" + ".".join(rng.choices(labels, k=rng.randrange(1, 5))) + "/" + "/".join(rng.choices([*parts, "p1", "p11"], k=rng.randrange(0, 4)))) for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    table_of = spark.createDataFrame(sorted(rules), "host string, path string, verdict string")
    trie = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(df, sorted(rules)).collect()}
    joined = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(df, table_of, most_broadcast=3).collect()}
    assert trie == joined
    for i, u in pages:
        host, path = url_filter.split_url(u)
        fits = [(h.count("."), len(p), h + p) for h, p, _ in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert trie[i][0] == (max(fits)[2] if fits else None)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="post"><header>Site</header><nav><ul><li>Home<li>News</ul></nav>
<div id="cookie-notice">We use cookies</div>%s<aside class="sidebar">Side</aside><div class="comments"><p>Nice!</p></div>
<form><label>Mail</label><input name=x></form><footer>&copy; x</footer><script>var a="</p>";</script></body></html>"""


@pytest.mark.parametrize(("body", "text"), [
    ("<article><header><h1>Head &amp; more</h1></header><p>One\n  two<br>three <b>bold<i>x</b></i>.<p>Four<div class=ad>Buy</div><ul><li>a<li>b</ul></article>",
     "Head & more\n\nOne two three boldx.\n\nFour\n\na\n\nb"),
    ("<main><h1>A</h1><table><tr><td>1<td>2<tr><td>3</table><!-- <p>no</p> --><p hidden>no</p><p>5 &lt; 6 &#x1F600;</p></main>", "A\n\n1\n\n2\n\n3\n\n5 < 6 😀"),
    ("<div class=content><p>Only <span class='ad'>no</span>this</p></div>", "Only this"),
    ("<p title='a > b'>Loose</p> text", "Loose\n\ntext"),
    ("", ""),
])
def test_main_text(body, text):
    assert html_extract.main_text(PAGE % body, None) == text


@pytest.mark.parametrize("page", [
    "<div class='site has-sidebar'><article><p>Told</p></article></div>",
    "<div class='no-sidebar'><p>Told</p></div>",
    "<div class='post-with-comments'><main><p>Told</p></main></div><div class='site-footer'>End</div>",
    "<div class='widget'><div><main><p>Told</p></main></div></div>",
    "<article><svg/><p>Told</p><math display='block' /></article><svg><text>no</text></svg>",
    "<article><p>Told</p></article><div class='comments'><article class='comment'><p>Nice</p></article></div>",
    "<article><p>Told</p></article><div hidden><div class='ad'><article>no</article></div></div>",
])
def test_articles_in_boxes_named_after_their_neighbours(page):
    assert html_extract.main_text(page, None) == "Told"


def test_wrapper_drops_what_a_host_repeats(spark):
    def page(i):
        return f"<body><div>Welcome to us</div><div><h2>Title {i}</h2><p>Story {i}</p>{'<p>More</p>' * (i % 3)}</div><div>Call 555</div></body>"
    rows = [(i, "http://h.example/x", page(i)) for i in range(9)] + [(100, None, None), (101, "http://alone.example/", page(1)), (102, "http://alone.example/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).repartition(4)
    for most in (100, 0):
        got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract_pages(df, most_broadcast=most).collect()}
        assert len(got) == len(rows)
        assert got[3] == ("Title 3\n\nStory 3", 16) and got[4][0] == "Title 4\n\nStory 4\n\nMore"
        assert got[100] == ("", 0) and got[102] == ("", 0) and got[101][0].startswith("Welcome")
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_wrapper_decides_inside_an_article_too(spark):
    def page(i, story):
        return f"<nav>N{i}</nav><article><div>Join our club</div><h1>Title {story}</h1><p>Story {story}</p><section>Call 555</section></article><div>Other {i}</div>"
    # the copies of one article alone have a table, and a host of nothing but copies keeps its article
    copied = "<article><h1>Twice told</h1><table><tr><td>cell</table></article>"
    rows = [(i, "http://h.example/x", page(i, i)) for i in range(6)] + [(10 + i, "http://h.example/y", f"<nav>{i}</nav>{copied}") for i in range(4)]
    rows += [(20 + i, "http://copies.example/", page(i, 0)) for i in range(5)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got[3] == "Title 3\n\nStory 3"
    assert all(got[10 + i] == "Twice told\n\ncell" for i in range(4))
    assert all(got[20 + i] == "Join our club\n\nTitle 0\n\nStory 0\n\nCall 555" for i in range(5))


def test_fixed_texts_of_long_pages(spark):
    def page(i):
        rows = "".join(f"<p>Line {i}.{k}</p>{'<pre>code</pre>' * ((i + k) % 3 == 0)}<ul><li>Item {i}.{k}</ul>" for k in range(300))
        return f"<div>Menu</div>{rows}<div>Imprint</div>"
    rows = [(i, "http://h.example/x", page(i)) for i in range(8)]
    for parts in (1, 8):
        for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).collect():
            assert r.text.startswith(f"Line {r.page_id}.0") and r.text.endswith(f"Item {r.page_id}.299")


def extracted(spark, pages, parts=4):
    rows = [(i, "http://h.example/x", page) for i, page in enumerate(pages)]
    return [r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).orderBy("page_id").collect()]


def test_articles_keep_headings_that_all_pages_share(spark):
    pages = [f"<article><h1>Title {i}<p>Story {i}<h2>Conclusion<p>So it ends, {i}" for i in range(6)]
    assert extracted(spark, pages) == [f"Title {i}\n\nStory {i}\n\nConclusion\n\nSo it ends, {i}" for i in range(6)]
    # the same where even the last paragraph is always the same one, and without a container
    pages = [f"<article><h2>Summary</h2><p>In short, {i}</p><h1>Title {i}</h1><p>Story {i}</p><h2>Conclusion</h2><p>To be continued</p></article>" for i in range(6)]
    assert all(x.startswith("Summary\n\nIn short") and "\n\nConclusion" in x for x in extracted(spark, pages))
    pages = [f"<div>Our site</div><h1>Title {i}</h1><p>Story {i}</p><h2>Conclusion</h2><p>It ends, {i}</p><div>Imprint</div>" for i in range(6)]
    assert extracted(spark, pages) == [f"Title {i}\n\nStory {i}\n\nConclusion\n\nIt ends, {i}" for i in range(6)]


@pytest.mark.parametrize("box", ["article", "div"])
def test_few_pages_do_not_make_a_template(spark, box):
    """Three recipes among 200 pages share headings and an ingredient."""
    def page(i):
        recipe = f"<h2>Ingredients</h2><ul><li>salt</li><li>egg {i}</li></ul><h2>Method</h2><p>Stir</p>" if i in (5, 70, 199) else f"<p>More {i}</p>"
        return f"<{box}><h1>Title {i}</h1><p>Story {i}</p>{recipe}<p>Bye {i}</p></{box}>"
    got = extracted(spark, [page(i) for i in range(200)], parts=7)
    assert got[70] == "Title 70\n\nStory 70\n\nIngredients\n\nsalt\n\negg 70\n\nMethod\n\nStir\n\nBye 70"
    assert got[71] == "Title 71\n\nStory 71\n\nMore 71\n\nBye 71"


def test_notices_inside_articles_go(spark):
    """On nearly all pages of the host: at the edges, in a box of their own in the middle, and menus of links."""
    def page(i):
        menu = "<ul><li><a href=a>News</a></li><li><a href=b>About <b>us</b></a></li></ul>"
        ad = "" if i == 3 else "<div>Buy now</div>"
        return (f"<article><p>Reading saves time</p><h1>Title {i}</h1><p>Story {i}</p>{ad}<p>More {i}</p>{menu}<ul><li>Point {i}</li></ul>"
                "<h3>Share this</h3><section>Call 555</section></article>")
    assert extracted(spark, [page(i) for i in range(20)]) == [f"Title {i}\n\nStory {i}\n\nMore {i}\n\nPoint {i}" for i in range(20)]


@pytest.mark.parametrize("box", ["article", "div"])
def test_the_bound_of_wrappers_changes_no_text(spark, monkeypatch, box):
    """500 runs on a page: no group is lost, whether wrappers hold 8 tokens or all."""
    def page(i):
        runs = "".join(f"<p>Line {i}.{k}</p>{'<pre>code</pre>' * ((i + k) % 3 == 0)}<ul><li>Item {i}.{k}<li>Also {k % 7}</ul>" for k in range(170))
        return f"<div>Menu</div><{box}>{runs}</{box}><div>Imprint</div>"
    pages = [page(i) for i in range(8)]
    known = [html_extract.Wrapper(), html_extract.Wrapper()]
    texts = []
    for j, most in enumerate((8, 10**9)):
        monkeypatch.setattr(html_extract, "MOST_TOKENS", most)
        for p in pages:
            known[j] = html_extract.grown(known[j], html_extract.folded(html_extract.parse(p)))
        # the table of places, as the job counts it
        counts = {}
        for p in pages:
            for pair in html_extract.places([t for t, _ in html_extract.folded(html_extract.parse(p))]):
                counts[pair] = counts.get(pair, 0) + 1
        fixed = {}
        for (_, text), n in counts.items():
            if n >= 4:
                fixed[text] = fixed.get(text, False) or n >= 6.4
        texts.append([html_extract.main_text(p, known[j], fixed) for p in pages])
    assert texts[0] == texts[1] and len(known[1].tokens) > 300
    for i, text in enumerate(texts[0]):
        assert all(f"Line {i}.{k}\n\n" in text and f"Item {i}.{k}\n\n" in text for k in range(170))
        assert "Menu" not in text and "Imprint" not in text


def test_wrappers_merge_by_parts():
    def page(i):
        return html_extract.folded(html_extract.parse(f"<div>Menu</div><h1>T{i}</h1>" + "<p>x</p>" * (i % 4) + ("<table><tr><td>opt</table>" if i % 2 else "") + "<div class=f>End</div>"))
    whole, parts = html_extract.Wrapper(), [html_extract.Wrapper() for _ in range(3)]
    for i in range(12):
        whole = html_extract.grown(whole, page(i))
        parts[i % 3] = html_extract.grown(parts[i % 3], page(i))
    merged = html_extract.Wrapper()
    for p in parts:
        merged = html_extract.aligned(merged, html_extract.Wrapper.unpacked(p.packed()))
    assert merged.pages == whole.pages == 12
    for w in (whole, merged):
        kinds = {t.label: t for t in w.tokens}
        assert kinds["div"].text is not None and kinds["h1"].text is None and not kinds["div"].optional
        assert kinds["p"].repeated and kinds["p"].optional and kinds["table/tr/td"].optional


def test_main_text_of_the_supplied_pages(spark):
    import html
    import re

    from caseloom.llm.queries import QUERIES
    pages = {r.page_id: r.html for r in table(spark, SMALL, "pages").collect()}
    for r in QUERIES["op8_html_extraction"](spark, SMALL).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(x for x in parts if x)


def test_pipeline_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL).cache()
        assert after.columns == columns and {f.name: f.dataType for f in after.schema} == {f.name: f.dataType for f in docs.schema}
        new = {r.doc_id: r.text for r in after.collect()}
        if name == "quality_rules":
            assert all(i not in new for i in ids if brute.quality(texts[i])[-1]) and len(new) > 0.7 * len(ids)
        if name == "line_dedup":
            want = brute.shared_lines([(i, t or '') for i, t in texts.items()], keep_first=True, spare_whole=True)
            assert {i: brute.hashlib.sha256(t.encode()).hexdigest() for i, t in new.items()} == {i: w[2] for i, w in want.items()}
        if name == "near_dedup":
            assert set(new) == set(plain_classes(list(texts.items())).values()) | {i for i, t in texts.items() if not brute.folded_words(t)}
        if name == "decontamination":
            items = [tuple(r) for r in table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
            want = brute.contamination(list(texts.items()), items)
            assert set(new) == {i for i in texts if not want[i][4]}
            assert all(v[1] == 0 for v in brute.contamination(list(new.items()), items).values())
        assert all(r.n_chars == len(r.text) for r in after.collect())
        docs, texts = after, new
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(texts)


def test_one_copy_of_every_text_survives_the_pipeline(spark):
    """Thirty copies of a text, twelve of a line, a text that stands in them, and texts of their own."""
    words = [f"word{i}" for i in range(400)]
    copied = "\n".join(" ".join(words[k:k + 20]) for k in range(0, 100, 20))
    own = {100 + i: f"one line that many share, says nobody\n{' '.join(words[(7 * i + 31 * k) % 400] + str(i) for k in range(30))}" for i in range(12)}
    rows = [(i, copied, "en", "a", 0) for i in range(30)] + [(i, t, "en", "a", 0) for i, t in own.items()] + [(200, "", "en", "a", 0), (201, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lines = corpus_pipeline.without_shared_lines(spark, docs, SMALL).cache()
    texts = {r.doc_id: r.text for r in lines.collect()}
    assert {i for i, t in texts.items() if not (t or "").strip()} == {200, 201} and len(texts) == len(rows)
    assert texts[100] == own[100] and all(texts[i] == own[i].split("\n")[1] for i in range(101, 112))
    left = {r.doc_id: r.text for r in corpus_pipeline.without_copies(spark, lines, SMALL).collect()}
    assert [i for i, t in left.items() if t == copied] == [min(i for i in left if i < 30)]
    assert set(left) >= set(own) and sum(i < 30 for i in left) == 1


def test_queries_are_registered():
    from caseloom.llm.queries import ORACLES, QUERIES
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13 and "pipeline" in QUERIES
    assert set(ORACLES) <= set(QUERIES)


def test_native_operators_have_no_python_in_their_plans(spark):
    from caseloom.llm.queries import QUERIES
    for name in ("op4_license_scans", "op9_secret_scans"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_url_query_agrees_with_its_sql(spark):
    from caseloom.llm.queries import ORACLES, QUERIES
    from checks.verify import compare
    good, note = compare(spark, SMALL, "op2_url_filters", QUERIES["op2_url_filters"], ORACLES["op2_url_filters"])
    assert good, note


def test_memory_that_is_free_goes_back_to_the_system():
    """Blocks are freed below others that stay, so that nothing but a trim returns them."""
    import re
    from pathlib import Path

    from caseloom.llm.common import give_back

    def held() -> int:
        return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024

    kept = [np.ones(12_000, np.uint8) for _ in range(8000)]
    del kept[:-1]
    before = held()
    give_back()
    assert before - held() > 50 or before < 250 and held() <= before
