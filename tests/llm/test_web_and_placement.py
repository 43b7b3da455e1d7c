"""Placement (op2), URL lists (op9), page text (op10) and the pipeline."""

import datetime as dt
import html
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from steadyrun.llm import placement, queries, style_tree, url_lists
from tests.conftest import SF


def test_table_follows_the_turns():
    import hashlib

    names, size = ["b", "a", "c"], 11
    want, order = [None] * size, {}
    for name in sorted(names):
        digest = hashlib.sha256(name.encode()).digest()
        offset, step = int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1
        order[name] = [(offset + k * step) % size for k in range(size)]
    while None in want:
        for name in sorted(names):
            free = [s for s in order[name] if want[s] is None]
            if free:
                want[free[0]] = name
    assert placement.lookup_table(names, size) == want


def test_table_is_even_and_stable():
    names = [f"s{k}" for k in range(50)]
    table = placement.lookup_table(names)
    sizes = Counter(table).values()
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == 50
    fewer = placement.lookup_table(names[:-1])
    moved = sum(a != b for a, b in zip(table, fewer) if a != "s49")
    assert moved < 0.06 * len(table)
    heavy = Counter(placement.lookup_table(names, weights={"s3": 4}))
    assert abs(heavy["s3"] / heavy["s4"] - 4) < 0.1
    for bad in (([], 11), (["a"], 10), (["a", "b"], 1)):
        with pytest.raises(ValueError):
            placement.lookup_table(*bad)


def test_placed(spark, tmp_path):
    rows = [(k % 300, f"t{k}", "x") for k in range(900)] + [(None, "t1", "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "key long, text string, slot string")
    names = [f"s{k}" for k in range(7)]
    got = placement.placed(df, F.col("key"), names, size=101, spread_by=F.col("text")).collect()
    table = placement.lookup_table(names, 101)
    assert len(got) == 902 and all(table[r.slot] == r.shard for r in got)
    by = defaultdict(set)
    for r in got:
        by[r.key].add(r.shard)
    assert all(len(v) == 1 for k, v in by.items() if k is not None)
    assert placement.placed(df.where("false"), F.col("key"), names).count() == 0
    placement.write_shards(placement.placed(df, F.col("key"), names), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 902


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_as_of_equals_replay(spark):
    rnd = random.Random(8)
    hosts = ["a.com", "www.a.com", "b.org", "x.y.b.org", "com"]
    listed = hosts + ["a.com/p", "a.com/p/q", "B.ORG"]
    entries = [(rnd.choice(["l1", None]), rnd.choice(listed), rnd.choice(["block", "allow"]), rnd.choice(["add", "remove"]), day(rnd.randint(0, 30))) for _ in range(120)]
    entries += [("l1", None, "block", "add", day(1)), ("l1", "a.com", None, "add", day(1)), ("l1", "a.com", "block", "add", None), ("l1", "a.com", "block", "moved", day(2))]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/p", "/p/q/r?x=1#y", "/pq", ":8080/p")] + ["HTTPS://user@A.com/P", "no url", "", None]
    captures = [(rnd.choice(urls), rnd.choice([day(rnd.randint(0, 40)), None]) if rnd.random() < 0.9 else None, k) for k in range(400)]

    def state(name, pattern, verdict, at):
        days = [(e[4], e[3] == "add") for e in entries if e[:3] == (name, pattern, verdict) and e[3] in ("add", "remove") and e[4] and e[4] <= at]
        return bool(days) and max(days)[1]

    def judge(url, at):
        m = re.match(r"[a-z]+://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?([^?#]*)", (url or "").lower())
        if not m or at is None:
            return None
        labels, parts = m[1].split("."), [p for p in m[2].split("/") if p]
        own = {".".join(labels[k:]) for k in range(len(labels))} | {"/".join([m[1], *parts[:k]]) for k in range(1, len(parts) + 1)}
        hits = [(len(e[1]), e[2] == "block", e[1].lower(), e[2]) for e in entries if e[1] and e[2] and e[4] and e[1].lower() in own
                and any(state(e[0], p, e[2], at) for p in {x[1] for x in entries if x[1] and x[1].lower() == e[1].lower()})]
        return max(hits)[3] if hits else None

    entries = [(a, b.lower() if b else b, c, d, e) for a, b, c, d, e in entries]
    e = spark.createDataFrame(entries, "list_name string, pattern string, verdict string, action string, effective date")
    c = spark.createDataFrame([(u, f, k, True) for u, f, k in captures], "url string, fetched date, n long, kept boolean")
    got = {r.n: (r.verdict, r.kept) for r in url_lists.judged(c, e).collect()}
    want = {k: judge(u, f) for u, f, k in captures}
    assert got == {k: (v, v != "block") for k, v in want.items()}
    assert len(set(want.values())) == 3
    assert url_lists.judged(c.where("false"), e).count() == 0
    assert url_lists.judged(c, e.where("false")).where("kept").count() == len(captures)


def test_very_long_urls(spark):
    long = "http://" + "x." * 30_000 + "a.com/" + "p/" * 50_000
    c = spark.createDataFrame([(long, day(2)), ("http://a.com/p/p/p", day(2))], "url string, fetched date")
    e = spark.createDataFrame([("l", "a.com", "allow", "add", day(1)), ("l", "a.com/p/p", "block", "add", day(1))],
                              "list_name string, pattern string, verdict string, action string, effective date")
    start = time.time()
    got = {r.url: (r.pattern, r.kept) for r in url_lists.judged(c, e).collect()}
    assert got == {long: ("a.com", True), "http://a.com/p/p/p": ("a.com/p/p", False)} and time.time() - start < 60


def test_article_text_of_the_pages(spark):
    rows = {r.page_id: r for r in queries.op10_style_tree(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        text = "\n".join(b for b in blocks if b)
        assert (rows[r.page_id].text, rows[r.page_id].n_chars, rows[r.page_id].url) == (text, len(text), r.url)


def test_tree_removes_what_pages_of_a_host_share(spark):
    def page(k, host):
        story = f"<div class='story'><h2>Title {k}</h2><p>Own words of page {k}, {host}.</p><p>More {k * 7}</p></div>"
        return (k, f"http://{host}/{k}", f"<html><body><div class='top'><p>Welcome to us</p><p>Since 1999</p></div>{story}<div class='low'><p>All rights</p></div></body></html>")

    pages = [page(k, "big.example") for k in range(12)] + [page(50, "lone.example"), (60, None, None), (60, "http://big.example/", ""), (61, "x", "<div>")]
    df = spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in style_tree.extracted(df).collect()}
    assert got[3] == "Title 3\nOwn words of page 3, big.example.\nMore 21"
    assert got[50] == "Welcome to us\nSince 1999\nTitle 50\nOwn words of page 50, lone.example.\nMore 350\nAll rights"
    assert got[60] == "" and got[61] == ""
    assert style_tree.extracted(df.where("false")).count() == 0
    host = F.regexp_extract("url", style_tree.HOST, 1)
    tree = {r.path: r.importance for r in style_tree.style_tree(df.where("url like '%big%'"), host).collect()}
    top, story, low = (tree[style_tree.path_of((n,))] for n in ("div.top", "div.story", "div.low"))
    assert top < 0.1 and story > 0.5 and low < 0.1


def test_copies_of_an_article_stay(spark):
    body = "".join(f"<p>Shared paragraph {n} of the story, with its own words.</p>" for n in range(5))

    def page(k):
        own = f"{body}<p>Line {k}</p>" if k < 6 else f"<p>A story of its own, number {k}.</p><p>It goes on, {k * 3}.</p>"
        return own

    for wrap in ("article", "div"):
        html_of = lambda k: f"<body><p>Top of the site</p><{wrap}>{page(k)}</{wrap}></body>"  # noqa: B023, E731
        df = spark.createDataFrame([(k, f"http://h.example/{k}", html_of(k)) for k in range(10)], "page_id long, url string, html string")
        got = {r.page_id: r.text for r in style_tree.extracted(df).collect()}
        for k in range(10):
            assert got[k] == "\n".join(re.findall("<p>(.*?)</p>", page(k)))


def test_small_hosts_share_a_tree(spark):
    def page(host, k):
        return f"<body><article><h1>Title {host} {k}</h1><p>Words of page {k} of {host}, {k * 31}.</p><p>All rights reserved</p></article></body>"

    rows = [(10 * h + k, f"http://h{h}.example/{k}", page(h, k)) for h in range(5) for k in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in style_tree.extracted(df).collect()}
    assert got[23] == "Title 2 3\nWords of page 3 of 2, 93." and len(got) == 20


def test_all_class_names_tell_a_branch(spark):
    rows = [(k, f"http://h.example/{k}", f"<div class='a b c d {'z' if k % 2 else 'y'}'><p>x{k}</p></div>") for k in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    tree = {r.path: r.pages for r in style_tree.style_tree(df, F.lit("h")).collect()}
    assert tree[style_tree.path_of(["div.a.b.c.d.z"])] == 3 and tree[style_tree.path_of(["div.a.b.c.d.y"])] == 3


@pytest.mark.parametrize("kind", ["div", "sidebar", "text", "stray", "p"])
def test_deep_pages_take_linear_time(kind):
    n = 50_000
    source = {
        "div": "<div>" * n + "deep", "sidebar": "<div class='sidebar'>" * n + "deep", "text": "<div>a" * n, "p": "<p><b>" * n,
        "stray": "<div>" * n + "</span>" * n + "deep",
    }[kind]
    start = time.process_time()
    blocks, layouts = style_tree.parsed(source)
    assert time.process_time() - start < 5 and all(len(b.trail) < 100 for b in blocks)
    assert len(blocks) == (n if kind == "text" else 0 if kind == "p" else 1)


def test_importance_equals_a_plain_tree(spark):
    rnd = random.Random(3)
    texts = ["Home", "About us", "All rights", "Read on"]

    def part(depth):
        name = rnd.choice(["div", "div class='a'", "section", "article"])
        inner = "".join(part(depth + 1) if depth < 3 and rnd.random() < 0.5 else f"<p>{rnd.choice([*texts, str(rnd.random())])}</p>" for _ in range(rnd.randint(0, 3)))
        return f"<{name}>{inner}</{name.split()[0]}>"

    pages = ["<body>" + "".join(part(0) for _ in range(rnd.randint(1, 3))) + "</body>" for _ in range(25)]
    spread, shapes, mains = defaultdict(lambda: defaultdict(Counter)), defaultdict(Counter), defaultdict(bool)
    for k, page in enumerate(pages):
        blocks, layouts = style_tree.parsed(page)
        for b in blocks:
            for branch in b.trail:
                spread[branch][b.text][k] += 1
        own = defaultdict(list)
        for path, children, main in layouts:
            own[path].append(children)
            mains[path] |= main
        for path, found in own.items():
            shapes[path]["|".join(found)] += 1

    def entropy(counts):
        total = sum(counts)
        return -sum(c / total * math.log(c / total) for c in counts)

    whole = sum(bool(style_tree.parsed(p)[0]) for p in pages)
    want = {}
    for path, styles in shapes.items():
        m = sum(styles.values())
        found = [entropy(c.values()) for c in spread[path].values()]
        told = max(0.0, 1 - (sum(found) / len(found) if found else 0.0) / math.log(max(whole if mains[path] else m, m, 2)))
        layout, left = min(entropy(styles.values()) / math.log(max(m, 2)), 1.0), 0.9 ** len(found)
        want[path] = left * layout + (1 - left) * told if m > 1 else 1.0
    df = spark.createDataFrame([(k, "http://h.example/", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.path: r.importance for r in style_tree.style_tree(df.repartition(4), F.lit("h")).collect()}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


@pytest.mark.parametrize(
    "source, want",
    [
        ("<p>a<br>b &amp; c<div class='ad'>x</div>d<ul><li>1<li>2</ul><script>var x='</p>'</script>t <b>q", "a b & c\nd\n1\n2\nt q"),
        ("<body><header>h</header><main><header><h1>T</h1></header><p>x<aside>s</aside>y</p><section class='comments'>c</section></main>f</body>", "T\nx\ny"),
        ("<article>&lt;p&gt; &#x41;&nbsp;&eacute;<form>f</form><!-- c > --> z</article> out", "<p> A é\nz"),
        ("<table><tr><td>a<td>b<tr><td>c</table><select><option>o</select>", "a\nb\nc"),
        ("<p title='a>b'>x</p><textarea><p>no</textarea><svg><text>no</text></svg>y", "x\ny"),
        ("<", "<"), ("a < b", "a < b"), ("</p>", ""), ("<!--", ""), ("<script>x", ""), (None, ""), ("<div>" * 2000 + "deep", "deep"),
    ],
)
def test_odd_markup(source, want):
    assert style_tree.main_text(source) == want


def test_pipeline_stages(spark):
    where = f"{SF}/../sf0.01"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    texts, columns = {r.doc_id: r.text for r in docs.collect()}, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, where).persist()
        assert docs.columns == columns
        rows = {r.doc_id: r for r in docs.collect()}
        assert 0 < len(rows) <= len(texts) and rows.keys() <= texts.keys()
        if name == "personal data":
            assert len(rows) == len(texts) and any(r.text != texts[k] for k, r in rows.items())
            assert all(r.n_chars == len(r.text) for r in rows.values())
        else:
            assert all(r.text == texts[k] for k, r in rows.items())
            assert len(rows) < len(texts)
        texts = {k: r.text for k, r in rows.items()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, where)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == texts.keys()


def test_pipeline_takes_empty_and_odd_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "no id", "en", "s", 5)], docs.schema
    )
    for start in (odd, docs.where("false")):
        now = start
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
        now.collect()


@pytest.mark.parametrize(
    "source, want",
    [
        ("<div class='content has-sidebar'><p>Main words here</p><div class='sidebar'>s</div></div>", "Main words here"),
        ("<div class='no-sidebar'><article><p>Main words</p></article></div>", "Main words"),
        ("<div class='layout sidebar'><article><p>Main words</p></article><p>beside</p></div>", "Main words"),
        ("<article class='post comments-open'><p>Main words</p></article>", "Main words"),
        ("<article class='promo'><p>Main words</p></article>", "Main words"),
        ("<div id='page-header-fixed'><p>Main words</p></div><p>low</p>", "Main words\nlow"),
        ("<body><form action='/'><nav>n</nav><p>Main words here</p><p>More</p></form></body>", "Main words here\nMore"),
        ("<form><main><p>Main words</p><form class='search'>f</form></main></form>", "Main words"),
        ("<main><div class='widget'><p>Most of the words</p></div><p>few</p></main>", "Most of the words\nfew"),
        ("<div id='page-header-fixed'><article>Own</article><div class='comments'><article class='comment'>Theirs, longer</article></div></div>", "Own"),
        ("<article>Own</article><div class='comments'><p>Many words of others, longer than the article</p></div>", "Own"),
        ("<div class='widget'>a</div><div class='promo'>b</div>", "a\nb"),
    ],
)
def test_names_do_not_remove_the_main_text(source, want):
    assert style_tree.main_text(source) == want


def test_tree_within_declared_parts(spark):
    def page(k, host="big.example"):
        quote = "<p>A quote of three articles</p>" if k < 3 else ""
        story = f"<article><h1>Title {k}</h1><p>Own words of {k}, {k * 7}.</p>{quote}<div><p>Share this page</p></div><p>All rights reserved</p></article>"
        return (k, f"http://{host}/{k}", f"<body><p>Welcome</p>{story}<p>beside {k}</p></body>")

    def teasers(k):
        cards = "".join(f"<article><p>Teaser {n}</p></article>" for n in range(3))
        return (100 + k, f"http://cards.example/{k}", f"<body><div><h1>Story {k}</h1><p>The long main text of story {k} is beside the teasers.</p></div>{cards}</body>")

    rows = [page(k) for k in range(12)] + [teasers(k) for k in range(8)]
    rows += [(300, "http://often.example/", page(1)[2])] * 6 + [(200, "http://lone.example/", page(5)[2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in style_tree.extracted(df).collect()}
    assert got[7] == "Title 7\nOwn words of 7, 49."
    assert got[1] == "Title 1\nOwn words of 1, 7.\nA quote of three articles"
    assert got[103] == "Story 3\nThe long main text of story 3 is beside the teasers."
    assert got[200] == "Title 5\nOwn words of 5, 35.\nShare this page\nAll rights reserved"
    assert got[300].startswith("Title 1\nOwn words of 1, 7.\nA quote") and "beside" not in got[300]
