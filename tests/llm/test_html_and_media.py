import hashlib
import html
import re
import zlib

import pytest
from helpers import documents

from rosterloom.llm import common, html_text, media

PAGE = (
    '<html><head><title>x</title><script>if(a<b){"</p>"}</script></head><body class="page has-sidebar"><header>Top</header><nav><a href=x>m</a></nav><div class="cookie-notice">We use cookies</div>'
    '<div id=main><article class="post"><header><h1>Title &amp; more</h1></header><p>Hi.</p><p><b>First<br>line &nbsp;x<p>{0}</p><div class="ad">BUY</div><blockquote>quote</blockquote>'
    '<ul><li>one</li><li>two <a href=y>link</a></li></ul><p>End.</p><footer>by me</footer></article><section class="comments"><p>{1}</p></section></div><aside>side</aside><form>Search</form><footer>&copy;</footer></body></html>'
).replace("{0}", "word " * 60).replace("{1}", "great " * 40)
WANT = "\n\n".join(["Title & more", "Hi.", "First line x", ("word " * 60).strip(), "quote", "one", "two link", "End."])


def test_article_and_bare_pages():
    assert html_text.main_text(PAGE) == WANT
    bare = PAGE.replace('<article class="post">', '<div class="post">').replace("</article>", "</div>").replace("<header><h1>", "<h1>").replace("</h1></header>", "</h1>")
    assert html_text.main_text(bare) == WANT
    for page, text in (("<p>Only.</p>", "Only."), ("", ""), (None, ""), ("just text", "just text"), ("<article></article>", ""), ("<p>a &lt;b&gt; &#233;", "a <b> é"), ("<!-- x --><p>y<!--", "y"), ("<nav>a<article><p>t</p></article>", "t")):
        assert html_text.main_text(page) == text, page


def test_regions_keep_all_their_lines():
    long, more = ("word " * 40).strip(), ("more " * 40).strip()
    pages = [
        (f"<body><div>{long}</div><div>Short.</div><div>{more}</div>", [long, "Short.", more]),  # a division for each paragraph
        (f"<div><div>{long}</div><div>Short.</div><div>{more}</div><div>End.</div></div>", [long, "Short.", more, "End."]),
        (f"<h1>Title</h1><div>{long}</div>", ["Title", long]),  # a title outside the division of the text
        (f"<div><h1>Title</h1><div>{long}</div></div>", ["Title", long]),
        (f"<p>{long}</p><div class=ad>BUY</div><p>End.</p>", [long, "End."]),  # a short paragraph behind an advert
        (f"<div><p>{long}</p></div><div class=ad>BUY</div><div><p>End.</p></div>", [long, "End."]),
        (f"<article><p>{long}</p></article><p>between</p><article><p>Short.</p></article>", [long, "Short."]),  # several articles
        (f"<article>a</article><article>b</article><article>c</article><article>{long}</article>", ["a", "b", "c", long]),
        (f"<div>{long}</div><nav>1</nav><nav>2</nav><nav>3</nav><div>far</div>", [long]),  # the sums dive before the last line
    ]
    for page, want in pages:
        assert html_text.main_text(page) == "\n\n".join(want), page


def test_names_are_weights_and_states_mean_nothing():
    words = lambda n: " ".join(["word"] * n)
    a, b = words(80), words(60)
    pages = [
        (f'<div class="content no-sidebar"><p>{a}</p><p>{b}</p></div>', [a, b]),
        (f'<div class="post comments-open has-sidebar"><p>{a}</p></div>', [a]),
        (f'<article><div class="entry-header"><h1>Title</h1></div><p>{a}</p></article>', ["Title", a]),
        (f'<article><p>{a}</p><div class="social history"><p>{b}</p></div><p>End.</p></article>', [a, b, "End."]),
        (f'<article><p>{a}</p><div class="social"><a href=x>Share this</a> <a href=y>Tell all</a></div><p>End.</p></article>', [a, "End."]),
        (f'<article><p>{a}</p><div class="ad-slot">{b}</div><div class=promo>{b}</div><div class=newsletter>{b}</div><p>End.</p></article>', [a, "End."]),
        (f'<div><p>{a}</p></div><div class="related">{words(20)}</div><div class="comment-list"><p>{b}</p></div>', [a]),
        (f'<div class="masthead">The Paper of Record</div><div><div><h1>T</h1><p>{a}</p></div></div>', ["T", a]),
        ('<p title="Bob"s">text here</p>', ["text here"]),
        (f"<p>a < b & c <3 d</p><p>{a}</p>", ["a < b & c <3 d", a]),
    ]
    for page, want in pages:
        assert html_text.main_text(page) == "\n\n".join(want), page


def test_surge_and_dive_bound_the_text():
    """What is kept depends on the window and the threshold, not on the containers alone."""
    long, short = " ".join(["word"] * 60), "A short remark."
    page = f"<div><p>{long}</p></div><nav>m</nav><nav>n</nav><div><p>{short}</p></div>"
    assert html_text.main_text(page) == f"{long}\n\n{short}"
    assert html_text.main_text(page, window=1) == long and html_text.main_text(page, window=2) == long
    assert html_text.main_text(page, window=1, threshold=10) == f"{long}\n\n{short}"
    far = f"<div><div><div><div><p>{short}</p></div></div></div></div><div><div><div><div><p>{long}</p></div></div></div></div>"
    assert html_text.main_text(far) == long and html_text.main_text(far, window=9) == f"{short}\n\n{long}"


@pytest.mark.parametrize("unit", ["<a ", "<div>", "<div>x", "< ", '<a b="', "<a b='x", "<p>x</div>", "<nav>x", "<article><nav>", "<div class=social>x", "<x", "</", "<!--", "&#x", "<a x=1 "])
def test_odd_pages_take_time_in_proportion(unit):
    import time

    page = unit * (1_000_000 // len(unit))
    began = time.monotonic()
    html_text.main_text(page)
    assert time.monotonic() - began < 30


def test_varied_pages():
    """Pages built from known parts; what must come out is known from the building, not from another reading of the page."""
    import random

    rnd = random.Random(11)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n)).capitalize() + "."
    for _ in range(300):
        blocks = [("h1", prose(5)), *[(rnd.choice(["p", "p", "h2", "blockquote", "li"]), prose(rnd.choice([1, 4, 25, 60]))) for _ in range(rnd.randint(2, 9))]]
        blocks.insert(2, ("p", prose(50)))
        noise = ['<div class="ad">Buy now</div>', "<script>if(a<b){x='<p>no</p>'}</script>", "<!-- <p>hidden</p> -->", '<aside><p>' + prose(30) + "</p></aside>", "<form><input><button>Go</button></form>", "<figure></figure>"]
        body = "".join(f"<{t}{rnd.choice(['', ' class=x', ' id=\"a b\"'])}>{x.replace(' ', rnd.choice([' ', '  ', chr(10), '<br>', ' <b> ']), 1).replace('<b>', '<b></b>')}</{t}>" + (rnd.choice(noise) if rnd.random() < 0.25 else "") for t, x in blocks)
        tag = rnd.choice(["article", "main", "div", 'div class="post"', 'section id="content"'])
        name = tag.split()[0]
        top = rnd.choice(["", "<header><a href=/>Site</a></header>", '<div class="site-header">The Site</div>']) + "<nav><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></nav>" + rnd.choice(["", '<div id="cookie-consent">' + prose(30) + "</div>"])
        foot = rnd.choice(["", '<div class="comments"><p>' + prose(40) + "</p></div>", '<section id="comments"><div><p>' + prose(60) + "</p></div></section>"]) + "<footer>&copy; me</footer>"
        page = f"<html><head><title>t</title></head><body class='has-sidebar'>{top}<{tag}>{body}</{name}>{foot}</body></html>"
        assert html_text.main_text(page).split("\n\n") == [x for _, x in blocks], page


def test_pages_of_the_table(spark, sf_dir):
    """Brute force: the pages' articles hold headings and paragraphs and nothing else."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r["page_id"]: r for r in html_text.op6_html_text(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        inner = re.sub("</?b>", "", re.sub("<br>", " ", re.search("(?s)<article>(.*?)</article>", r["html"])[1]))
        blocks = (" ".join(html.unescape(x).split()) for x in re.split("</?(?:p|h1)>", inner))
        want = "\n\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


def test_extract_odd_tables(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, None, "<p>a</p>", "y"), (None, "v", "", "z")], "page_id long, url string, html string, text string")
    assert sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_text.extract(df).collect()), key=str) == [(1, "u", "", 0), (1, None, "a", 1), (None, "v", "", 0)]
    assert html_text.extract(df.limit(0)).collect() == []


def test_sequences_keep_order_and_captions(spark):
    page = '<p>a</p><figure><img src="media:ab" alt="z"><figcaption>cap</figcaption></figure><p>b<img src=media:cd alt="q&amp;r">c</p>'
    df = spark.createDataFrame([(5, page), (6, None)], "doc_id long, html string")
    store = spark.createDataFrame([("ab", 7)], "digest string, n long")
    got = media.resolve(media.sequences(df), store).orderBy("position").collect()
    assert [(r["position"], r["kind"], r["content"], r["caption"], r["n"]) for r in got] == [(0, "text", "a", "", None), (1, "media", "ab", "cap", 7), (2, "text", "b", "", None), (3, "media", "cd", "q&r", None), (4, "text", "c", "", None)]


def test_round_trip(spark):
    texts = ["", None, "abc", "abc", "é" * 288, "x" * 577, "🎉 <p>&amp;</p> </figure> media:zz \"q\"\n\n", "y" * 100_000]
    ids = [1, 2, 3, 4, 5, 6, 7, 7]
    docs = documents(spark, texts, ids, extra=("digest string, feature string", ("d", "f")))
    media_rows = media.sequences(media.as_pages(docs)).filter("kind = 'media'")
    got = sorted(media.resolve(media_rows, media.read_store(media.store_texts(docs))).collect(), key=lambda r: (r["doc_id"], r["n_bytes"]))
    assert len(got) == 8
    for r, (i, t) in zip(got, zip(ids, texts, strict=True), strict=True):
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        stored = media.encode_media(payload)
        assert media.decode_media(stored) == payload and r["doc_id"] == i
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"], r["content"]) == (len(stored), hashlib.sha256(stored).hexdigest(), hashlib.sha256(stored).hexdigest())
    assert got[2]["feature"] == got[3]["feature"] and media.store_texts(docs).count() == 6
    assert media.store_texts(docs.limit(0)).collect() == [] and media.as_pages(docs.limit(0)).collect() == []


@pytest.mark.parametrize("limit", [0, 10**6])
def test_query_reads_a_written_store(spark, tmp_path, monkeypatch, limit):
    """The store is a table of files with each payload once, and the query's features come from it."""
    texts = ["a", None, "b", "a", "", "c", "a", "b"]
    documents(spark, texts).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    found = media.op7_media(spark, str(tmp_path))
    files = [f for f in found.inputFiles() if "media-store" in f]
    store = spark.read.parquet(*files).collect()
    assert sorted(r["digest"] for r in store) == sorted(hashlib.sha256(media.encode_media(media.to_payload(t))).hexdigest() for t in ("", "a", "b", "c"))
    assert all(hashlib.sha256(r["media"]).hexdigest() == r["digest"] for r in store)
    assert sorted((r["doc_id"], r["n_bytes"]) for r in found.collect()) == [(i, len(t or "")) for i, t in enumerate(texts)]
