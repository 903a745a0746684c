"""Main text of pages against the texts that the pages were made of."""

import html
import random
import re

import pytest

from tickloom.llm import templates

SF_DIR = "/root/testdata/sf0.01"


def test_registered_query(spark):
    """The test pages mark their articles: what is between the marks, cut at the tags of blocks."""
    from tickloom.llm.queries import QUERIES

    rows = spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op12_main_text"](spark, SF_DIR).collect()}
    assert len(got) == len(rows)
    for r in rows:
        inside = re.search("<article>(.*)</article>", r.html, re.S)[1]
        parts = re.split("</?(?:h1|p)>", inside.replace("<br>", "\n").replace("<b>", "").replace("</b>", ""))
        want = "\n\n".join(x for p in parts if (x := " ".join(html.unescape(p).split())))
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def site(rng, host, k, shape):
    """A page of a host and its main text."""
    words = [f"word{i}" for i in range(200)] + ["Köln", "a<b", "R&D", "x > y"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    blocks = [say(rng.randrange(4, 9))] + [say(rng.randrange(10, 60)) for _ in range(rng.randrange(2, 9))]
    esc = [html.escape(b) for b in blocks]
    body = f"<h2>{esc[0]}</h2>" + "".join(rng.choice([f"<p>{b}</p>", f"<p>{b}", f"<blockquote>{b}</blockquote>", f"<ul><li>{b}</ul>", f"<P CLASS='lead'>{b.replace(' ', '  <i> ', 1)}</i></P>"]) for b in esc[1:])
    if shape == "plain":
        page = f"""<html><head><title>{esc[0]}</title><style>p{{}}</style></head><body class="home"><div class="top"><div id=logo>{host}</div><ul><li>Home<li>About us</ul></div>
        <div class="outer"><div class="story">{body}</div><div class="box"><span>Most read today</span><p>{say(3)}</p></div></div>
        <div class="end">All rights reserved by {host}, do not copy any of this</div><script>if (a<b) {{ x = "</div>" }}</script></body></html>"""
    elif shape == "article":
        page = f"""<!DOCTYPE html><HTML><body><header><h1>{host}</h1></header><nav><a href="?a>b">{say(2)}</a></nav><div class="cookie-notice">We use cookies</div><main><article class="post">
        {body}<div class="share-buttons">Share this</div><form><input value="<p>">Your mail</form><section id="comments"><article class="comment"><p>{say(20)}</p></article></section></article>
        <aside>{say(30)}</aside></main><div class="ad">{say(12)}</div><footer>&copy; {host}</footer>"""
    else:
        page = f"""<body><div role="navigation">{say(4)}</div><div role="main" class="has-sidebar">{body}<!-- <p>{say(5)}</p> --></div><div id="sidebar-left">{say(40)}</div><noscript>Turn it on</noscript>"""
    return page, "\n\n".join(" ".join(b.split()) for b in blocks)


@pytest.mark.parametrize("bytes_", [templates.BROADCAST_BYTES, 0])
def test_sites(spark, monkeypatch, bytes_):
    """Hosts of three kinds; the plain one marks nothing, so its template must tell."""
    monkeypatch.setattr(templates, "BROADCAST_BYTES", bytes_)
    rng = random.Random(3)
    rows, want = [], {}
    for host, shape, n in (("plain.example", "plain", 40), ("news.example", "article", 30), ("other.example", "role", 12), ("one.example", "article", 1)):
        for k in range(n):
            page, text = site(rng, host, k, shape)
            for copy in range(3 if k == 0 else 1):
                i = len(rows)
                rows.append((i, f"https://{host.upper()}/{k}?c={copy}#x", page))
                want[i] = text
    odd = [(None, None), ("", ""), ("not an address", "<p>Only &amp; this"), ("http://odd.example/", "<p>a<b>b</p> c <script>never closed"), ("http://odd.example/2", "1 < 2 <<>> </x> <!-- open")]
    for (url, page), text in zip(odd, ["", "", "Only & this", "ab\n\nc", "1 < 2 <<>>"]):
        want[len(rows)] = text
        rows.append((len(rows), url, page))
    want[len(rows)] = "long " * 300_000 + "end"
    rows.append((len(rows), "http://long.example/", "<article>" + "<b>" * 2000 + "long " * 300_000 + "<i " * 2000 + "</article>" + "<article>end"))
    table = spark.createDataFrame([(*r, "?", 1, "?") for r in rows], "page_id long, url string, html string, host string, row int, text string").repartition(4)
    got = {r.page_id: r for r in templates.extracted(table).collect()}
    assert len(got) == len(rows)
    bad = [i for i, text in want.items() if got[i].text != text and i != len(rows) - 1]
    assert not bad, (bad[:5], got[bad[0]].text, want[bad[0]])
    assert got[len(rows) - 1].text.startswith("long " * 1000) and all(r.n_chars == len(r.text) and r.url == rows[i][1] for i, r in got.items())
    assert templates.extracted(table.limit(0)).count() == 0


def test_template_tells_slots(spark):
    """The deduced template of the unmarked host: its fixed texts are template, its stories are not."""
    rng = random.Random(4)
    pages = [site(rng, "plain.example", k, "plain") for k in range(25)]
    table = spark.createDataFrame([("plain.example", p, k) for k, (p, _) in enumerate(pages)], "host string, html string, row int")
    (row,) = templates.templates(table).collect()
    main, fixed = templates._template(row.template)
    page = templates.parsed(pages[0][0])
    words = {templates.plain(r.text): r for r in page.runs if templates.plain(r.text)}
    known = {w for w, r in words.items() if templates._signed(templates.token(r)) in fixed}
    assert {"About us", "Most read today", "All rights reserved by plain.example, do not copy any of this"} <= known
    story = [r for w, r in words.items() if len(w) > 40 and "rights" not in w]
    assert story and all(main in map(templates._signed, r.node.within) for r in story)
