"""Main text extraction: structure, templates of a host against counting, broken and odd pages."""

import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import html_extract
from factorloom.llm.html_blocks import AROUND, BODY, MAIN, blocks


def main_text(html):
    return "\n\n".join(t for kind, t in blocks(html) if kind == MAIN)


@pytest.mark.parametrize(
    "html, want",
    [
        ("<article><h1>A &amp; B</h1><p>one\n two<br>three<p><b>bold</article>", "A & B\n\none two three\n\nbold"),
        ("<nav>menu<article><p>x</p></article>", "x"),
        ("<header>top</header><main><header><h1>T</h1></header><p>x</main><footer>f</footer>", "T\n\nx"),
        ("<article><p>x<aside>side</aside><p>y<form>mail <input></form><div class='share-bar'>z</div></article>", "x\n\ny"),
        ("<article><p>x</p><section id=comments><article><p>c</p></article></section></article>", "x"),
        ("<article><script>var a='</p><p>no</p>';</script><style>p{}</style><p>1 < 2 > 0</p></article>", "1 < 2 > 0"),
        ("<article><!-- <p>no</p> --><p>a<!-- x -->b</p><p hidden>h</p><p style='display: none'>h</p></article>", "ab"),
        ("<div class='layout-sidebar'><article><p>x</p></article><p>side</p></div>", "x"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><pre>e  f</pre></article>", "a\n\nb\n\nc\n\nd\n\ne f"),
        ("<article><p>caf&eacute;&nbsp;&#233;&#x41; &unknown; &lt;p&gt;</p></article>", "café éA &unknown; <p>"),
        ("<div role=main><p title='a > b'>x</p></div><div>y</div>", "x"),
        ("<article><p>cut <b", "cut <b"),
        ("<article class='post ad-free'><p>x</article>", "x"),
        ("<div class='search-results'><article><p>x</article></div>", "x"),
        ("<article><p>x</p><div class='comments-area'><p>c</div><div id='related-posts'>r</div></article>", "x"),
        ("<article><div class='notice'><div>n</div><p>m</div><p>x</article>", "x"),
        ("", ""),
    ],
)
def test_structure(html, want):
    assert main_text(html) == want


def test_kinds():
    found = blocks("<head><title>t</title></head><body class='has-menu'><ul class=menu><li>m</ul><p>b</p></body>")
    assert found == [(AROUND, "m"), (BODY, "b")]


BROKEN = [
    '<a href="x" ', "<a '", "<a \"'>", "<", "<a ", "</div>", "&#", "<!--", "<!x ", "<div>", "<p>", "<article>", "<script>", "<title>x</title>",
    "<div></p>", "<nav><article></article>", "<div " + "a" * 50 + " ", '<div class="ad-', "&#99999999999", "<a      ", "<div x='", "<li>",
]


@pytest.mark.parametrize("piece", BROKEN)
def test_time_follows_the_length_of_broken_pages(piece):
    times = []
    for size in (300_000, 1_200_000):
        begin = time.process_time()
        blocks(piece * (size // len(piece)))
        times.append(time.process_time() - begin)
    assert times[1] < 12 * times[0] + 0.5, times


def test_ten_megabytes_without_an_end():
    begin = time.process_time()
    assert blocks("<article><p>text " + '<a href="x" ' * 800_000)[0][1].startswith("text <a")
    assert time.process_time() - begin < 20
    assert main_text("<article><p>&#" + "9" * 1_000_000 + "; end") == "\ufffd end"


def brute(rows):
    """Text of every page, runs and contents counted one by one."""
    pages = []
    for page_id, url, html in rows:
        host = re.match(r"^[A-Za-z][\w+.-]*://([^/?#]+)", url or "")
        pages.append((page_id, host[1].lower() if host else "", blocks(html or "")))

    def runs_of(text):
        words = text.split(" ")
        n = html_extract.RUN
        return [tuple(words)] if len(words) < n else [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]

    def page_runs(found):
        # Runs of a page cross block borders; short blocks are runs of their own.
        words = [w for _, t in found for w in t.split(" ")]
        n = html_extract.RUN
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} | {tuple(t.split(" ")) for _, t in found if len(t.split(" ")) < n}

    held, contents = defaultdict(set), defaultdict(set)
    for _, host, found in pages:
        content = " ".join(t for _, t in found)
        contents[host].add(content)
        for run in page_runs(found):
            held[host, run].add(content)
    out = []
    for page_id, host, found in pages:
        k = len(contents[host])
        plain = max(html_extract.LEAST_PAGES, html_extract.LEAST_SHARE * k)
        most = max(html_extract.UNIVERSAL_PAGES, html_extract.UNIVERSAL_SHARE * k)
        words = [w for _, t in found for w in t.split(" ")]
        n = html_extract.RUN

        def share(least):
            cover = [False] * len(words)
            for i in range(len(words) - n + 1):
                if len(held[host, tuple(words[i : i + n])]) >= least:
                    cover[i : i + n] = [True] * n
            at, shares = 0, []
            for _, t in found:
                size = len(t.split(" "))
                shares.append(1.0 if size < n and len(held[host, tuple(t.split(" "))]) >= least else sum(cover[at : at + size]) / size)
                at += size
            return shares

        by_plain, by_most = share(plain), share(most)
        main = any(kind == MAIN for kind, _ in found)
        kept = []
        for j, (kind, text) in enumerate(found):
            if kind == (MAIN if main else BODY):
                brief = len(text.split(" ")) < n
                kept.append((text, (by_most if main or brief else by_plain)[j] >= html_extract.COVERED))
        if main:
            while kept and kept[0][1]:
                kept.pop(0)
            while kept and kept[-1][1]:
                kept.pop()
            kept = [(t, False) for t, _ in kept]
        out.append((str(page_id), "\n\n".join(t for t, gone in kept if not gone)))
    return sorted(out)


def sites(seed):
    """Hosts with and without declared articles; notices on all, many and few pages; copies of pages; odd rows."""
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}é" for i in range(3000)])
    prose = lambda n: " ".join(rng.choice(words, n))
    rows, true = [], {}
    for host, pages, declared in (("a.example", 60, True), ("b.example", 60, False), ("c.example", 7, False), ("d.example", 2, True), ("e.example", 200, False)):
        top, end, syndicated, line, rare = prose(9), prose(14), prose(30), prose(3), prose(8)
        for i in range(pages):
            own = [prose(int(rng.integers(2, 40))) for _ in range(3)]
            inner = [f"<p>{t}</p>" for t in own]
            kept = list(own)
            if i % 9 == 0:
                inner.insert(2, f"<p>{syndicated}</p>")
                kept.insert(2, syndicated)
            if i % 41 == 0:
                inner.insert(1, f"<p>{rare}</p>")
                kept.insert(1, rare)
            inner = [f"<div>{top}</div>", *inner, f"<p>{end}</p>", f"<p>{line}</p>"]
            body = "".join(inner)
            html = f"<nav>menu of the site</nav><article>{body}</article><footer>{end}</footer>" if declared else f"<body>{body}"
            rows.append((len(rows), f"https://{host}/{i}", html))
            true[len(rows) - 1] = (host, kept, syndicated)
    rows += [(1000 + i, "https://b.example/copy", rows[65][2]) for i in range(30)]
    rows += [(2000, None, None), (2001, "x", ""), (None, "https://a.example/", "<p>  </p>"), (2002, "https://a.example/", "<article>" + "<p>long text here</p>" * 30_000)]
    return rows, true


def test_equals_counting_one_by_one(spark):
    rows, _ = sites(3)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "n": F.lit(1)})
    got = sorted((str(r.page_id), r.text) for r in html_extract.extract(pages.repartition(5)).collect())
    assert got == brute(rows)


def test_array_takes_notices_inside_articles_and_spares_prose(spark):
    rows, true = sites(4)
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}

    def f1(texts, hosts):
        hits = found = wanted = 0
        for page, (host, kept, _) in true.items():
            if host in hosts:
                a, b = texts(page).split(), " ".join(kept).split()
                hits += sum((Counter(a) & Counter(b)).values())
                found, wanted = found + len(a), wanted + len(b)
        return 2 * hits / (found + wanted)

    def structure(page):
        found = blocks(rows[page][2])
        return "\n\n".join(t for k, t in found if k == (MAIN if any(m == MAIN for m, _ in found) else BODY))

    declared, others = {"a.example"}, {"b.example", "c.example", "e.example"}
    assert f1(lambda p: got[p].text, declared) == 1.0 and f1(structure, declared) < 0.85
    # Without a declared article syndicated prose cannot be told from a notice.
    assert f1(lambda p: got[p].text, others) > 0.95 > f1(structure, others)
    assert all(got[p].n_blocks_taken == 3 for p, (h, _, _) in true.items() if h == "a.example")
    assert all(s in got[p].text for p, (h, kept, s) in true.items() if h == "a.example" and s in kept)


def test_sketch_is_an_upper_bound():
    rng = np.random.default_rng(1)
    for spread in (50, 5000, 1_000_000):
        places = np.unique(rng.integers(0, spread, 400))
        n = rng.integers(1, 4, len(places))
        back = html_extract.unpacked(*html_extract.packed(places, n))
        assert (back[0] == places).all() and (back[1] == n).all()


TEMPLATE = (
    "<body><div><div>Home World Sport Culture Weather About Us Contact</div><div>{own}</div>"
    "<div>All rights reserved by the example press of nowhere</div></div>"
)


def test_templates_without_structure(spark):
    rng = np.random.default_rng(2)
    letters = np.array(list("abcdefghijklmnopqrst"))
    own = [" ".join("".join(rng.choice(letters, 5)) for _ in range(30)) for _ in range(12)]
    rows = [(i, f"https://Site.example/{i}", TEMPLATE.format(own=t)) for i, t in enumerate(own)]
    rows += [(100, "https://other.example/1", TEMPLATE.format(own="alone"))]
    rows += [(207, None, None), (None, "nonsense", ""), (208, None, "<p>  </p>"), (209, "x://y", "<article><p>k</article>" * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r.page_id: r for r in html_extract.extract(pages.withColumn("host", F.lit("x"))).collect()}
    for i, text in enumerate(own):
        assert got[i].text == text
        assert got[i].n_words_covered == 17 and got[i].n_blocks_taken == 2
    # A template that one page alone shows can't be told from its text.
    assert got[100].text.startswith("Home") and "alone" in got[100].text
    assert got[207].text == got[None].text == got[208].text == ""
    assert got[209].text == "k\n\nk" and got[209].n_chars == 4
    assert html_extract.extract(pages.limit(0)).count() == 0
