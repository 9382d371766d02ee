"""HTML extraction and token counts."""

import math
import random
import re

import numpy as np
import pytest

from retention.llm import htmltext as H
from retention.llm import tokencount as K

LONG = "Words of the story go on and on for quite a while, as stories do when nobody stops them. " * 3
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var t="</p><p>no";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
{{}}
<aside>Aside</aside><div id="comments"><p>{LONG}</p></div><form><label>Mail</label><input><button>Go</button></form>
<footer>&copy; foot</footer></body></html>"""


def test_article():
    body = f"<article><header><h1>Title &amp; more</h1></header><p><b>{LONG}<br>next<p>Les.<p>a\n b&nbsp;&eacute;</p></article>"
    words = " ".join(LONG.split())
    assert H.main_text(PAGE.replace("{}", body)) == f"Title & more\n{words} next\nLes.\na b é"


def test_page_without_article():
    body = f"<div class=content><h2>Head</h2><p>{LONG}</p><p>Short.</p><div><p>{LONG}</p></div></div>"
    words = " ".join(LONG.split())
    assert H.main_text(PAGE.replace("{}", body)) == f"Head\n{words}\nShort.\n{words}"


def test_names_of_boilerplate():
    words = " ".join(LONG.split())
    for name in ("cookieBanner", "site-notice", "reader_comments", "AdSlot ad", "sideBar sidebar"):
        body = f'<main><div class="article-header"><h1>H</h1></div><div id="{name}"><p>{LONG}</p></div><p>{LONG}</p></main>'
        assert H.main_text(PAGE.replace("{}", body)) == f"H\n{words}", name
    assert H.main_text(f'<div class="page-header">x</div><div><p>{LONG}</p></div>') == words


def test_comments_inside_an_article_go():
    body = f'<article><p>{LONG}</p><section class="comment-list"><p>{LONG}</p></section></article>'
    assert H.main_text(PAGE.replace("{}", body)) == " ".join(LONG.split())


@pytest.mark.parametrize("open_,close", [
    ('<main class="with-sidebar">', "</main>"), ('<article class="post tag-ads comments-open">', "</article>"),
    ('<div class="layout no-sidebar">', "</div>"), ('<div class="page menu-open">', "</div>"),
    ('<div class="widget share"><article>', "</article></div>"), ('<div id="related"><main>', "</main></div>"),
    ('<div class="social widget">', "</div>"), ('<article id="share">', "</article>")])
def test_names_never_lose_an_article(open_, close):
    words = " ".join(LONG.split())
    assert H.main_text(f"<body><nav>menu</nav>{open_}<p>{LONG}</p><p>{LONG}</p>{close}</body>") == f"{words}\n{words}"


def test_other_articles_and_formulas():
    words = " ".join(LONG.split())
    body = (f"<article><p>{LONG}</p><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math>, <label>see</label></p></article>"
            f'<div id="comments"><article><p>{LONG}</p></article></div>')
    assert H.main_text(PAGE.replace("{}", body)) == f"{words}\nso x=1,"


def naive_high(texts, tags):
    """Ratio, Gaussian mean of the neighbours and the two-level threshold, line by line."""
    x = [math.log1p(min(len(t) / max(1, n), H.PLENTY)) for t, n in zip(texts, tags)]
    smooth = []
    for i in range(len(x)):
        near = [(math.exp(-0.5 * ((i - j) / H.SIGMA) ** 2), x[j]) for j in range(len(x)) if abs(i - j) <= math.ceil(3 * H.SIGMA)]
        smooth.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    t = sum(smooth) / len(smooth)
    for _ in range(50):
        low, high = [v for v in smooth if v < t], [v for v in smooth if v >= t]
        if not low:
            return [True] * len(x)
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - t) < 1e-9:
            break
        t = new
    high = [v >= t for v in smooth]
    up = [v for v, h in zip(smooth, high) if h]
    down = [v for v, h in zip(smooth, high) if not h]
    return high if sum(up) / len(up) - sum(down) / len(down) >= H.APART else [True] * len(x)


def test_clustering_against_naive():
    g = random.Random(3)
    for _ in range(200):
        lines = [("x" * g.choice([5, 20, 80, 400]), g.randint(0, 9)) for _ in range(g.randint(1, 30))]
        assert H.high_lines(lines).tolist() == naive_high(*zip(*lines))


def test_the_clustering_chooses_the_region(monkeypatch):
    links = "".join(f"<div><a href=#><b>go</b></a> <a href=#><i>to {i}</i></a></div>" for i in range(8))
    words = " ".join(LONG.split())
    pages = [f"<body><div>{links}</div><div><p>{LONG}</p><p>{LONG}</p></div><div>{links}</div></body>",
             f"<body><article>{links}</article><div><p>{LONG}</p><p>{LONG}</p></div></body>",
             f"<body><article><p>{LONG}</p></article><article><p>{LONG}</p></article><article>{links}</article></body>"]
    for page in pages:
        assert H.main_text(page) == f"{words}\n{words}"
    for turn in (lambda lines: np.zeros(len(lines), dtype=bool), lambda lines: np.array(["go" in x[0] for x in lines], dtype=bool)):
        monkeypatch.setattr(H, "high_lines", turn)
        assert all(H.main_text(page) != f"{words}\n{words}" for page in pages)


@pytest.mark.parametrize("page", [
    "<article><p>{}</p><div id=comments><p>%s</p></div></article>", "<div><p>{}</p></div><div class=comments><p>%s</p></div>",
    "<article><p>{}</p><p class=notice>%s</p></article>", "<article><p>{}</p><button>%s</button><label>%s</label></article>"])
def test_length_makes_no_content(page):
    text = " ".join("word" for _ in range(20))
    assert H.main_text("<body>" + page.replace("{}", text).replace("%s", "chatter " * 150) + "</body>") == text


def test_pages_of_sf001_with_other_tags(spark):
    """The clustering alone gives what the article elements give."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    plain = [re.sub(r"<(/?)(article|main)\b", r"<\1div", p) for p in pages]
    assert sum(H.main_text(a) == H.main_text(b) for a, b in zip(pages, plain)) >= 0.99 * len(pages)


def test_kept_names_must_not_clash(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "t")], "page_id int, url string, html string, text string")
    with pytest.raises(ValueError):
        H.extract(pages, keep=("page_id", "text"))


def test_no_part_of_the_content_is_lost():
    def p(n, c):
        return f"<p>{' '.join([c * 5] * (n // 6))}</p>"

    menu = "<div>" + "".join(f"<li><a href=x>link{i}</a>" for i in range(12)) + "</div>"
    for parts in ([p(300, "a"), p(600, "b") + p(500, "c")], [p(400, "a"), p(400, "b")], [p(300, "a"), p(20_000, "b"), p(300, "c")]):
        for around in ("<div class=content>{}</div>", "{}"):
            body = around.format("".join(f"<div>{x}</div>" for x in parts))
            text = H.main_text(f"<body>{menu}{body}{menu}</body>")
            assert [x for x in "abc" if x * 5 in text] == [x for x in "abc" if x * 5 in body] and "link" not in text
    body = f"<main><h1>Title</h1><p>Intro.</p><article>{p(3000, 'a')}</article><article><p>Brief.</p></article></main>"
    assert H.main_text(f"<body>{menu}{body}</body>").split("\n") == ["Title", "Intro.", p(3000, "a")[3:-4], "Brief."]


@pytest.mark.parametrize("html,text", [(None, ""), ("", ""), ("plain &lt;text", "plain <text"), ("<p", ""), ("<p>a<p>b", "a\nb"),
                                       ("<article><p>x</article", "x"), ("<script>x</script>", ""), ("</div></p>a", "a"),
                                       ("<nav>only menu</nav>", ""), ("<article>" + "<b>" * 3000 + "deep", "deep")])
def test_odd_pages(html, text):
    assert H.main_text(html) == text


def test_extract_keeps_rows(spark):
    rows = [(1, "u", "<p>x", "e"), (1, "u", "<p>x", "e"), (None, None, None, None), (2, "v", "<p>" + "word " * 100_000, "t")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = H.extract(pages).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in got) == [(0, "", 0), (1, "u", 1), (1, "u", 1), (2, "v", 499_999)]
    assert H.extract(pages.limit(0)).count() == 0


TEXTS = ["", "a", "two words\nthree more words\n\n\nend", "日本語 ünï €\n𝄞 clef", " \n ", "x" * 5000, "tab\tand\r\nbreak"]


@pytest.fixture(scope="module")
def tokenizer():
    return K.Tokenizer()


def test_spans_are_those_of_the_tokens(tokenizer):
    for t in TEXTS:
        ids, first, end = tokenizer.spans(t)
        assert tokenizer.ready().decode(ids.tolist()) == t
        at, raw = 0, t.encode()
        for n, a, b in zip(ids, first, end):
            size = len(tokenizer.ready().decode_single_token_bytes(int(n)))
            assert a == len(raw[:at + 1].decode(errors="ignore")) - (raw[at] & 0xC0 != 0x80 and raw[at] < 0x80) or (
                t[a:b].encode().find(raw[at:at + size]) >= 0)
            at += size
        assert not len(end) or end[-1] == len(t)


@pytest.mark.parametrize("rule", K.RULES)
def test_attribution_against_naive(rule):
    g = np.random.default_rng(1)
    for _ in range(200):
        cuts = np.unique(g.integers(0, 40, g.integers(0, 12)))
        spans = np.array([(a, b) for a, b in zip(cuts, cuts[1:]) if g.random() < 0.8] or np.zeros((0, 2)), dtype=np.int64)
        ends = np.unique(np.r_[g.integers(1, 45, 15)])
        first, end = np.r_[0, ends[:-1]], ends
        want = []
        for a, b in zip(first, end):
            held = [max(0, min(b, y) - max(a, x)) for x, y in spans]
            some = [i for i, n in enumerate(held) if n]
            want.append(-1 if not some else some[0] if rule == "start" else max(some, key=lambda i: (held[i], -i)))
        assert K.attribute(first, end, spans.reshape(-1, 2), rule).tolist() == want


def test_counts_add_up(make_docs, odd_rows, tokenizer):
    docs = make_docs(odd_rows + [(50 + i, t) for i, t in enumerate(TEXTS)])
    got = K.count_tokens(docs, tokenizer).collect()
    assert all(r.section >= 0 for r in got)
    for i, t in enumerate(TEXTS):
        own = sorted((r for r in got if r.doc_id == 50 + i), key=lambda r: r.section)
        assert sum(r.n_tokens for r in own) == len(tokenizer.ready().encode_ordinary(t))
        assert "".join(t[r.first_char:r.end_char] for r in own) == t
    assert K.count_tokens(make_docs([]), tokenizer).count() == 0


def test_fields(spark, tokenizer):
    rows = spark.createDataFrame([(1, "hello world", None), (1, "", "b"), (None, None, None)], "id bigint, a string, b string")
    got = K.count_fields(rows, ["a", "b"], tokenizer, "id").collect()
    assert len(got) == 9
    assert sorted((r.field, r.n_tokens) for r in got if r.id is None) == [(-1, 1), (0, 0), (1, 0)]
    total = sum(r.n_tokens for r in got)
    assert total == sum(len(tokenizer.ready().encode_ordinary(t)) for t in ("hello world\n", "\nb", "\n"))
