"""HTML text, personal data and toxicity."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docmerge.llm import pages, pii, toxicity

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><a href=/>Home</a> Site name</header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><div class="ad">Buy this now, it is a long advert text</div>
%s<aside>Side text that is quite long as well</aside><div id="cookie-notice">We use cookies everywhere</div><form>Name <input></form>
<footer>&copy; Me</footer></body></html>"""
ARTICLE = "<h1>Head &amp; more</h1><p>First <b>bold</b>  text,\n with <a href=x>a link</a> in it.<p>Second&nbsp;one<br>next line</p><ul><li>item<li>more</ul><pre>a\n  b</pre>"
LINES = "Head & more\n\nFirst bold text, with a link in it.\n\nSecond one\n\nnext line\n\nitem\n\nmore\n\na b"
COMMENTS = '<section class="comments"><p>I do not like this article at all, said a reader at length.</p></section>'


@pytest.mark.parametrize("body", [
    f"<article>{ARTICLE}</article>", f"<article>{ARTICLE}{COMMENTS}</article>", f"<main><div>{ARTICLE}</div>{COMMENTS}</main>", f"<div class=content>{ARTICLE}{COMMENTS}</div>",
    f"<div><div>{ARTICLE}</div></div>", f"<article><header>{ARTICLE.split('<p>')[0]}</header><p>{ARTICLE.split('<p>', 1)[1]}</article>",
])
def test_article_without_the_rest(body):
    assert pages.main_text(PAGE % body) == LINES


def test_density_prefers_text_to_links():
    links = "<div>" + "".join(f"<p><a href=/{i}>link number {i}</a></p>" for i in range(30)) + "</div>"
    text = "<div><p>" + "plain sentence here. " * 10 + "</p><p>" + "another sentence. " * 10 + "</p></div>"
    assert pages.main_text(f"<body>{links}{text}</body>") == ("plain sentence here. " * 10).strip() + "\n\n" + ("another sentence. " * 10).strip()


@pytest.mark.parametrize("wrap", [
    '<div class="layout has-sidebar">%s</div>', '<div class="post no-comments">%s</div>', '<div class="with-banner">%s</div>', '<div class="sidebar-layout">%s</div>', '<div class="page sidebar">%s</div>',
    '<div title="hidden valley" data-x=\'class="ad"\'>%s</div>', '<div data-note="the hidden cost" data-class=ad>%s</div>', '<section id="overlay"><div class=widget>%s</div></section>',
])
@pytest.mark.parametrize("body", ["<article>%s</article>", "<div>%s</div>", "<div>%s" + COMMENTS + "</div>"])
def test_wrappers_and_other_attributes_drop_no_article(wrap, body):
    assert pages.main_text(PAGE % (wrap % (body % ARTICLE))) == LINES


def test_named_articles_beside_the_article_go():
    comments = '<div id="comments"><article class="comment-body"><p>First of the replies.</p></article><article><p>Another one of them.</p></article></div>'
    assert pages.main_text(PAGE % f"<article>{ARTICLE}</article>{comments}") == LINES
    teasers = '<div><article>Short</article></div>'
    assert LINES in pages.main_text(PAGE % f'<div class="right-sidebar"><article>{ARTICLE}</article></div>{teasers}')


@pytest.mark.parametrize("token,marks", [
    ('<p title="hidden valley">', {"title": "hidden valley"}), ("<p a=1 HIDDEN class='x y'/>", {"a": "1", "hidden": "", "class": "x y"}), ('<p class = "a"class=b>', {"class": "a"}),
    ("<p/>", {}), ('<p class="x', {"class": '"x'}), ("<p " + " " * 100_000 + "id=x>", {"id": "x"}),
])
def test_attributes_are_read_in_turn(token, marks):
    assert pages._attributes(token, "p") == marks


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p>", ""), ("plain < text", "plain < text"), ("<p>a<p>b", "a\n\nb"), ("</div></p>x", "x"), ("<article>x", "x"), ("<b><i>x</b>y", "xy"),
    ("<p>a &amp b &#65;&bogus;</p>", "a & b A&bogus;"), ("<script>x<p>y", ""), ("<p title='>'>q</p>", "q"), ("<!-- <p>c</p> --><p>d</p>", "d"), ("<p hidden>h</p><p>s</p>", "s"), ('<p class="x', ""),
])
def test_odd_pages(page, text):
    assert pages.main_text(page) == text


def test_deep_and_long_pages():
    assert pages.main_text("<article><h1>T</h1><p>a</p><p>b</p></article>") == "T\n\na\n\nb"
    for tag in ("div", "address", "b", "section", "span", "blockquote"):
        assert pages.main_text(f"<{tag}>" * 50_000 + "x") == "x"
    assert pages.main_text("<article>" + "<div><header>" * 50_000 + "x") == "x"
    assert pages.main_text("<div>" * 50_000 + "</b>" * 50_000 + "x") == "x"
    assert pages.main_text("<div><p>" * 50_000 + "</li>" * 1_000 + "x") == "x"
    assert len(pages.main_text("<article><p>" + "word " * 200_000)) == 999_999


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<a href=x>", "</a>", "<li>", "<table><tr><td>", "<article>", "</article>", "<nav>", "<", ">", '"', "text ", "&amp;", "<!--", "<script>", "<br/>"]), max_size=30))
def test_any_markup_gives_text(parts):
    assert isinstance(pages.main_text("".join(parts)), str)


def slow_densities(nodes):
    """Densities by the definition: every node walks its whole subtree, links and all."""

    def below(node):
        for child in node.children:
            if isinstance(child, str):
                yield child
            elif not child.skipped:
                yield child
                yield from below(child)

    def numbers(node):
        inner = list(below(node))
        chars = lambda items: sum(len(" ".join(i.split())) for i in items if isinstance(i, str))
        tops = [node] if node.tag == "a" else [i for i in inner if not isinstance(i, str) and i.tag == "a" and not within_link(i, node)]
        links = sum(chars(list(below(a))) for a in tops)
        return chars(inner), sum(not isinstance(i, str) for i in inner), links, sum(not isinstance(i, str) and i.tag == "a" for i in inner)

    def within_link(node, top):
        while node.parent is not top:
            node = node.parent
            if node.tag == "a":
                return True
        return False

    whole = numbers(nodes[0])
    found = {}
    for node in (n for n in nodes if not n.skipped):
        c, t, lc, lt = numbers(node)
        if c:
            base = np.log(c / max(1, c - lc) * lc + whole[2] / max(1, whole[0]) * c + np.e)
            found[id(node)] = max(0.0, c / max(1, t) * np.log(max(c / max(1, lc) * max(1, t) / max(1, lt), 1e-9)) / base)
    return found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<a href=x>", "</a>", "<li>", "<section>", "</section>", "<b>", "</b>", "some text ", "a longer sentence of words. ", "<br>", "</main>"]), max_size=30))
def test_densities_by_a_second_reading(parts):
    nodes = pages.parse("".join(parts))
    pages._measure(nodes)
    slow = slow_densities(nodes)
    assert {id(n) for n in nodes if n.chars and not n.skipped} == set(slow)
    for node in nodes:
        if id(node) in slow:
            assert node.density == pytest.approx(slow[id(node)])
        own = [c for c in node.children if not isinstance(c, str) and c.tag in pages.BLOCKS]
        assert node.total == pytest.approx(sum(slow.get(id(c), 0.0) for c in own))


def test_pages_frame(spark):
    rows = [(1, "u", PAGE % ARTICLE, "x"), (1, "u", PAGE % ARTICLE, "x"), (None, None, None, "x")]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got.collect()) == [(0, 0), (1, len(LINES)), (1, len(LINES))]
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd = [int(d) for d in digits[-1::-2]]
    even = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def brute_spans(text):
    checks = {
        "email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 13 <= sum(map(str.isdigit, m)) <= 19 and luhn([c for c in m if c.isdigit()]), "phone": lambda m: 9 <= sum(map(str.isdigit, m)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, kind in enumerate(BASE) for m in re.finditer(BASE[kind], text) if checks[kind](m.group())]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b1", "@", ".", "+", "4111 1111 1111 1111", "4111111111111111", "10", "255", "256", "1.2.3.4", "-", " ", "é", "(555)", "%", "+49 30 1234567", "٣", "00000000001"]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    assert sorted(pii.base_spans(text)) == sorted(brute_spans(text))


@pytest.mark.parametrize("text,kind,found", [
    ("write john (at) example (dot) com now", "email", "john (at) example (dot) com"),
    ("mail a.b at example dot org", "email", "a.b at example dot org"),
    ("to x [AT] y.example.net.", "email", "x [AT] y.example.net"),
    ("so: x＠y.com", "email", "x＠y.com"),
    ("so: jan@ex​ample.com!", "email", "jan@ex​ample.com"),
    ("jо@example.com", "email", "jо@example.com"),
    ("call five five five one two three four five six seven", "phone", "five five five one two three four five six seven"),
    ("or +1 five five five, 123 4567 890", "phone", "+1 five five five, 123 4567 890"),
    ("ip one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
    ("pay four one one one 1111 1111 1111 ok", "card", "four one one one 1111 1111 1111"),
    ("４111 1111 1111 1111", "card", "４111 1111 1111 1111"),
])
def test_disguises_map_back(text, kind, found):
    base, every = pii.all_spans(text)
    assert (kind, found) in [(pii.KINDS[k], text[s:e]) for k, s, e in every]
    assert set(base) <= set(every) and base == sorted(brute_spans(text))


@pytest.mark.parametrize("text,kind,found", [
    *((f"ask jane at example dot {last} soon", "email", f"jane at example dot {last}") for last in ("jp", "app", "pl", "in", "museum", "com")),
    ("jane at mail.example dot com", "email", "jane at mail.example dot com"), ("jane at example dot co.jp!", "email", "jane at example dot co.jp"), ("jane at the dot com", "email", "jane at the dot com"),
    ("call +49 30 one two 34567 89", "phone", "+49 30 one two 34567 89"), ("card 4111 1111 one 111 1111 ok", "card", "4111 1111 one 111 1111"), ("ip 192.168.one.5", "ip", "192.168.one.5"),
    ("dial +49 30 oh 1234567", "phone", "+49 30 oh 1234567"), ("jαne@site.org", "email", "jαne@site.org"), ("𝐣𝐚𝐧𝐞@site.org", "email", "𝐣𝐚𝐧𝐞@site.org"), ("𝛂nna@site.org", "email", "𝛂nna@site.org"),
    ("٤١١١ ١١١١ ١١١١ ١١١١", "card", "٤١١١ ١١١١ ١١١١ ١١١١"), ("to ѡ гоѕа@site.org", "email", "гоѕа@site.org"), ("oﬃce@site.org", "email", "oﬃce@site.org"),
])
def test_disguises_of_any_ending_digit_and_alphabet(text, kind, found):
    base, every = pii.all_spans(text)
    assert (kind, found) in [(pii.KINDS[k], text[s:e]) for k, s, e in every]
    assert base == sorted(brute_spans(text))


@pytest.mark.parametrize("text", ["+49 30 1234567 one of us", "4111 1111 1111 1111, one of two", "ip 192.168.1.1 one", "1 one 20", "at a dot near", "x² and ½, one 2"])
def test_few_digit_words_add_nothing_to_complete_numbers(text):
    base, every = pii.all_spans(text)
    assert every == base == sorted(brute_spans(text))


@pytest.mark.parametrize("text", ["look at the dot on the wall", "meet at noon", "one two three", "one, two and five six", "a (at) b", "dot dot dot at dot", "привет", "<at> <dot>"])
def test_plain_texts_have_no_finds(text):
    assert pii.all_spans(text) == ([], [])


@pytest.mark.parametrize("text", ["at (" + " " * 400_000 + "x", " " * 400_000 + "(at) b.co dot", "a (dot)" + " " * 400_000 + "at (", "x at y" + "\t" * 400_000 + "dot (", "(at)" * 50_000 + "dot"])
def test_long_white_space_is_read_once(text):
    import time

    start = time.perf_counter()
    pii.all_spans(text)
    assert time.perf_counter() - start < 3


@pytest.mark.parametrize("text,found", [("jane (at)  (dot) b.co", []), ("jane  ( at )  site ( dot ) org x", ["jane  ( at )  site ( dot ) org"]), ("a (at) b (dot) c.de (at) x.org", ["a (at) b (dot) c.de"])])
def test_marks_take_the_white_space_around_them(text, found):
    assert [text[s:e] for k, s, e in pii.all_spans(text)[1] if k == 0] == found


def test_pii_frame_and_redaction(spark):
    rows = [(1, "a@b.co, +49 30 1234567", 0), (2, None, 0), (2, None, 0), (None, "9" * 100_000 + " @" * 50_000, 0), (4, "é a (at) b.co", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert got[1]["spans"] == "email:0:6,phone:8:22" and (got[1]["n_email"], got[1]["n_phone"]) == (1, 1)
    assert got[1]["base_sha256"] == hashlib.sha256(b"email:0:6,phone:8:22").hexdigest()
    assert got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[4]["n_email"] == 0 and got[4]["n_added"] == 1
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    texts = {r["doc_id"]: r for r in clean.collect()}
    assert texts[1]["text"] == "[EMAIL], [PHONE]" and texts[1]["n_chars"] == 16 and texts[2]["text"] is None and texts[4]["text"] == "é [EMAIL]"
    assert pii.find(docs.limit(0)).count() == 0


def labelled(n=400, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ten", "sur") for b in ("ra", "do", "vi", "pel", "nor", "zu")]
    rows = []
    for i in range(n):
        sentences = [" ".join(rng.choice(words, 8)) for _ in range(rng.integers(1, 12))]
        if toxic := int(rng.random() < 0.3):
            at = rng.integers(len(sentences))
            sentences[at] += " " + rng.choice(["vileword", "nastyword", f"badstem{rng.choice(list('abcdefgh'))}"])
        rows.append((i, ". ".join(sentences) + ".", toxic))
    return rows


def test_toxicity_learns_from_documents_and_locates_sentences(spark):
    rows = labelled()
    train, test = rows[:300], rows[300:]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in train], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert np.mean([got[i]["predicted"] == y for i, _, y in test]) >= 0.97
    for i, text, y in test:
        if y and got[i]["predicted"]:
            assert re.search("vileword|nastyword|badstem", text[got[i]["start"] : got[i]["end"]])


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "s"), (1, "", "s"), (None, "word " * 50_000, "s")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    weights = toxicity.fit(docs, none)
    got = toxicity.score(docs, weights).collect()
    assert len(got) == 3 and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 for r in got)
    assert toxicity.score(docs.limit(0), weights).count() == 0


def test_an_id_with_many_texts_is_one_row_of_the_sample(spark):
    rows = labelled()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    chosen = min(((i, t) for i, t, y in rows if y), key=lambda r: r[0])
    again = docs.unionByName(spark.createDataFrame([chosen] * 300, docs.schema))
    assert toxicity.fit(again, labels) == toxicity.fit(docs, labels)


def test_noisy_or():
    scorer = toxicity.Scorer({toxicity.BIAS: -1.0, "bad": 2.0})
    one = lambda z: 1 / (1 + np.exp(-z))
    assert scorer.score("so bad. fine then!")[0] == pytest.approx(1 - (1 - one(1.0)) * (1 - one(-1.0)))
    assert scorer.score("fine then! so bad bad. ok")[1:3] == (10, 22)
