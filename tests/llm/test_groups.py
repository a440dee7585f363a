"""MinHash near-dedup, suffix-array dedup, HTML extraction and the pipeline."""

import collections
import hashlib
import html.parser
import random
import time

import numpy as np
from pyspark.sql import functions as F

from pairgauge.llm import html_extract, minhash, suffix


def _components(rows, k, percent):
    sets = []
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append((d, frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets)]


def test_near_duplicates(spark, docs, nothing, rows):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 3, 85).collect()), key=repr)
    assert got == sorted(_components(rows, 3, 85), key=repr)
    assert minhash.near_duplicates(nothing).count() == 0
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    parts = {c for d, n, c in _components(rows, 5, 80) if n and d is not None}
    assert {r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None and rows[r.doc_id][1] and rows[r.doc_id][1].strip()} == parts


def test_chain_of_near_copies(spark):
    """Each text is like the next but not like those far away: one component by links in a row."""
    rnd = random.Random(1)
    w = [f"t{rnd.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(w)))
        for _ in range(2):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(10**6)}"
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    want = {d: c for d, _, c in _components(rows, 3, 85)}
    assert {r.doc_id: r.component_id for r in got} == want


def _changed(rnd, base, n, tag):
    w = list(base)
    for j in rnd.sample(range(len(w)), n):
        w[j] = f"{tag}{rnd.randrange(10**6)}"
    return " ".join(w)


def test_equal_and_null_ids(spark):
    """Two texts under each of 40 ids, and rows without an id that have near copies with one."""
    rnd = random.Random(4)
    prose = lambda n: [f"p{rnd.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(40):
        a, b = prose(100), prose(90)
        rows += [(i, " ".join(a)), (i, " ".join(b)), (100 + i, _changed(rnd, b, 1, "n"))]
    for i in (1001, 1002, 1003):
        a = prose(80)
        rows += [(None, " ".join(a)), (i, " ".join([*a, "end"]))]
    rows += [(None, "one two three"), (None, "one two three"), (None, ""), (5000, None), (5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 3, 85).collect()), key=repr)
    assert got == sorted(_components(rows, 3, 85), key=repr)
    wide = df.select("doc_id", "text", F.lit(1).alias("_id"), F.expr("rand(3) as `gone`"))
    left = minhash.keep_first(wide, 3, 85)
    assert left.columns == wide.columns
    left = left.collect()
    # one row of each group: 80 with an id shared by two texts, 3 with a null id, one of the repeated rows; three without words
    assert len(left) == 80 + 3 + 1 + 3 and sum(r.doc_id is None for r in left) == 2
    assert {r.doc_id for r in left if r.doc_id and r.doc_id >= 100} == {1001, 1002, 1003, 5000}


def test_alike_but_not_near(spark, monkeypatch):
    """A bucket of texts that share most of a template, few of them linked: finer bands, then blocks."""
    rnd = random.Random(6)
    base = [f"b{i}" for i in range(300)]
    texts = [_changed(rnd, base, 12, "x") for _ in range(40)]
    texts += [_changed(rnd, t.split(), 3, "y") for t in texts[:10]] + [_changed(rnd, base, 4, "z") for _ in range(12)]
    rows = list(enumerate(texts))
    want = sorted(_components(rows, 3, 85))
    assert 5 < len({c for *_, c in want}) < 55
    for block, direct in ((minhash.BLOCK, minhash.DIRECT), (700, 10**6), (700, 0)):
        monkeypatch.setattr(minhash, "BLOCK", block)
        monkeypatch.setattr(minhash, "DIRECT", direct)
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_classes_that_share_a_name(spark):
    """Equal first halves of different digests are told apart."""
    rows = [(1, 10, 3, 7, 1, [5]), (2, 11, 3, 7, 2, [6]), (3, 12, 3, 7, 1, [5]), (4, 13, 3, 8, 1, [5])]
    d, classes = minhash._classes(spark.createDataFrame(rows, "doc_id long, x long, n long, node long, mark long, bands array<long>"))
    node = {r.doc_id: r.node for r in d.collect()}
    assert node[1] == node[3] != node[2] and len(set(node.values())) == 3
    assert sorted((r.node == node[r.rep], r.bands) for r in classes.collect()) == [(True, [5]), (True, [5]), (True, [6])]


def test_sketch_agrees_with_jaccard():
    rnd = np.random.default_rng(3)
    x = np.unique(rnd.integers(0, 2**63, 500).astype(np.uint64))
    a, b = x[:450], x[50:]
    s = minhash.sketches([a, b, x[:2], x[:0]], 1024)
    assert (s[:3] != np.uint64(2**64 - 1)).all() and (s[3] == np.uint64(2**64 - 1)).all()
    assert abs((s[0] == s[1]).mean() - 400 / len(x)) < 0.06


def test_maximal_repeats():
    rnd = random.Random(3)
    for _ in range(60):
        texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(60))) for _ in range(rnd.randrange(1, 6))]
        places = collections.defaultdict(list)
        for k, t in enumerate(texts):
            for i in range(len(t) - 7):
                places[t[i : i + 8]].append((k, i))
        want = {(k, j) for p in places.values() if len(p) > 1 for k, i in p for j in range(i, i + 8)}
        got = set()
        for n, ks, ss in suffix.maximal_repeats(texts, 8):
            (one,) = {texts[k][s : s + n] for k, s in zip(ks, ss)}
            assert len(one) == n and len(ks) == sum(t[i : i + n] == one for t in texts for i in range(len(t) - n + 1)) > 1
            # no longer to the left or right in all places
            for side in (-1, n):
                assert len({texts[k][s + side] if 0 <= s + side < len(texts[k]) else (k, s) for k, s in zip(ks.tolist(), ss.tolist())}) > 1
            got |= {(k, j) for k, s in zip(ks.tolist(), ss.tolist()) for j in range(s, s + n)}
        assert got == want


def test_suffix_dedup(docs, nothing, rows):
    n = 120
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    count = collections.Counter(t[i : i + n] for _, t in texts for i in range(len(t) - n + 1))
    want = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        want.append((d, len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    for hot in (suffix.HOT, 1):
        assert sorted(map(tuple, suffix.remove_repeats(docs, n, hot).collect()), key=repr) == sorted(want, key=repr)
    assert suffix.remove_repeats(nothing).count() == 0
    assert "removed" in suffix.remove_repeats(docs, n, with_spans=True).columns


PAGE = """<!DOCTYPE html><html><body><nav><a href=/>Home</a></nav><div class="ad">Buy</div><article><h1>T{i} &amp; co</h1>
<p>Text  {i} of<br>the page <b>bold</b>.<p>More {i}<div>Shared box text</div></article><script>if(a<b)document.write("<p>x</p>")</script>
<section class="comments"><p>nice</p></section><footer>&copy; host</footer></body>"""


def test_html(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(i=i)) for i in range(8)] + [(20, "http://b.example/", PAGE.format(i=0)), (21, None, None), (22, "x", ""), (None, "http://a.example/0", PAGE.format(i=0)), (20, "http://b.example/", PAGE.format(i=0))]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = html_extract.extract(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r.page_id if r.page_id is not None and r.page_id < 20 else 0
        if r.page_id in (21, 22):
            assert (r.text, r.n_chars) == ("", 0)
            continue
        box = [] if r.url.startswith("http://a.") else ["Shared box text"]
        assert r.text == "\n".join([f"T{i} & co", f"Text {i} of the page bold.", f"More {i}", *box]), r
        assert r.n_chars == len(r.text)
    assert html_extract.extract(pages.filter("false")).count() == 0


def test_html_copies_are_no_template(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(i=1)) for i in range(30)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"T1 & co\nText 1 of the page bold.\nMore 1\nShared box text"}


PLAIN = """<html><body><div><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></div><div><h1>T{i}</h1><p>Text {i} of the page</div>
<table><tr><td>Imprint of the host</td></tr></table><script>end()</script></body></html>"""


def test_html_templates_without_a_root(spark):
    """Unmarked menu and footer of pages without article or main, which all end in the same element; copies of one page stay."""
    rows = [(i, f"http://a.example/{i}", PLAIN.format(i=i)) for i in range(6)] + [(10 + i, f"http://b.example/{i}", PLAIN.format(i=1)) for i in range(6)]
    # copies that differ in an excluded part only
    rows += [(20 + i, f"http://c.example/{i}", PLAIN.format(i=1).replace("<script>", f"<nav>{i}</nav><script>")) for i in range(6)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = f"T{r.page_id}\nText {r.page_id} of the page" if r.page_id < 10 else "Home\nNews\nT1\nText 1 of the page\nImprint of the host"
        assert r.text == want, r


def test_html_templates_of_a_large_host(spark):
    """A box on 4 pages is a template beside 4 pages of its host and beside 400."""
    for n in (4, 400):
        rows = [(i, f"http://a.example/{i}", PAGE.format(i=i) if i < 4 else f"<div>Number {i}</div><article><p>Page {i}</article>") for i in range(n)]
        got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
        assert {r.page_id: r.text for r in got.filter("page_id < 4").collect()} == {i: f"T{i} & co\nText {i} of the page bold.\nMore {i}" for i in range(4)}, n


def test_unmarked_pages():
    text, _ = html_extract.main_text("<p>one<p>two &lt;3<ul><li>a<li>b</ul><!-- c --><form><input>no</form>tail &nbsp; end")
    assert text == "one\ntwo <3\na\nb\ntail end"


def test_html_wrappers_and_attributes():
    """A name hides no article around it or in it; attribute values end where HTML ends them."""
    of = lambda x: html_extract.main_text(x)[0]
    assert of('<div class="has-sidebar"><article><p>hello world</p></article></div>') == "hello world"
    assert of('<div class="related-layout"><main><p>hello</p></main></div><div>menu</div>') == "hello"
    assert of('<div class="sidebar"><p>all of the text of a page</p></div><p>x</p>') == "all of the text of a page\nx"
    assert of("<p>a</p><p title=it's>keep this</p><p>and don't lose it</p>") == "a\nkeep this\nand don't lose it"
    assert of("<p data-x='>' title=\"a>b\" hidden=>gone</p><p =x a = \"'\">left</p>") == "left"
    assert of('<article><p>some text of the article</p><div class="share-price">12 dollars</div><div class="share">mail</div></article>') == "some text of the article\n12 dollars"
    assert of("<div role=main><p>hi</p></div><div>other</div>") == "hi"
    assert of("<html><head><title>x</title><body><p>hi <button>share</button> there <span hidden>no</span>") == "hi there"
    assert of('<article><p>one two</p><section class="comments"><article><p>many words of a reader and more</p></article></section></article>') == "one two"
    assert of("a < b </ > c <!-- x --> d <!doctype html> e <?x?> f <p") == "a < b c d e f"
    assert of("<!--" * 3) == of("<p>" * 3) == of("<script>x") == ""


def test_html_is_linear():
    """Tags without an end, deep nesting and stray end tags take a pass each."""
    start = time.process_time()
    for x in ("<a " * 300_000, "<div>" * 100_000 + "x", "<b>" * 50_000 + "</i>" * 50_000, "<b><article>" + "<div>" * 30_000 + "</b>" * 50_000, "<b>" * 30_000 + "<li>x</li>" * 30_000, '<a b="' * 100_000, "<div>x" * 30_000, "<!--" * 100_000):
        html_extract.main_text(x)
    assert time.process_time() - start < 15
    assert html_extract.main_text("<div>x" * 30_000)[0].count("x") == 30_000


class _Tree(html.parser.HTMLParser):
    """A plain tree of well-formed pages: [tag, attributes, children]."""

    def __init__(self, page):
        super().__init__()
        self.top = self.at = ["", {}, []]
        self.path = [self.top]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.path[-1][2].append(node)
        if tag not in html_extract.VOID:
            self.path.append(node)

    def handle_endtag(self, tag):
        if any(n[0] == tag for n in self.path[1:]):
            while self.path.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.path[-1][2].append(data)


def test_html_against_plain_counts(spark):
    """A whole table: the article's blocks without subtrees that plain Python counts on 4 pages or more of the host."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    pages, places = [], collections.defaultdict(set)
    box = "<section><p>Read our paper</p></section>"

    def shown(node):
        return node if isinstance(node, str) else f"<{node[0]}>" + "".join(map(shown, node[2])) + "</>"

    def find(node, tag):
        for c in node[2]:
            if not isinstance(c, str):
                yield from [c] if c[0] == tag else find(c, tag)

    for r in rows:
        html_ = r.html.replace("</article>", box + "</article>") if r.page_id % 2 else r.html
        (article,) = find(_Tree(html_).top, "article")
        host = html_extract.host_of(r.url)
        pages.append((r.page_id, r.url, html_, host, article))
        for tag in html_extract.CONTAINERS:
            for c in find(article, tag):
                places[host, shown(c)].add(shown(article))

    def blocks(node, host, out):
        for c in node[2]:
            if isinstance(c, str):
                out[-1] += c
            elif c[0] not in html_extract.CONTAINERS or len(places[host, shown(c)]) < 4:
                breaks = c[0] in html_extract.BLOCK
                out += [""] * breaks
                out[-1] += " " * (c[0] == "br")
                # a paragraph left open ends at the next one, and so does what it left open
                blocks(c, host, out)
                out += [""] * breaks
        return out

    want = {p: "\n".join(t for b in blocks(article, host, [""]) if (t := " ".join(b.split()))) for p, _, _, host, article in pages}
    assert sum("Read our paper" in t for t in want.values()) not in (0, len([p for p in want if p % 2]))
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")).collect()}
    assert got == want


def test_html_templates_recur():
    """Menus, adverts and footers of most pages are found to recur."""
    page = '<div class="ad">Buy {i}</div><article><p>The text number {i} of many pages</p></article><footer>Host</footer>'
    found = [html_extract.Page(page.format(i=i)).content() for i in range(3)]
    assert len({p for _, _, p in found}) == 3
    shared = set.intersection(*({h for h, *_ in c} for _, c, _ in found))
    assert len(shared) == 1 and html_extract.main_text(page.format(i=9), shared) == ("The text number 9 of many pages", 1)
